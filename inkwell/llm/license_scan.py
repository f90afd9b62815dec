"""License scans by a positional rare-token index.

The templates are indexed by word: (word, template, position). An alignment (a
template, and where in the file it would start) counts if the template's
mandatory key phrase stands at its place and at least ``min_score`` of the
template's words do. So each template is looked up by the word of its key phrase
that has the highest inverse document frequency (over the whole table): every
place of that word in a file proposes an alignment, and no other can count,
however many notices the file holds.

Beside it, the base phrases are counted at every place where their words stand
consecutively; each is a template of its own, so a file that has one scores 1.
Defined results: null and empty texts have no words, empty labels and score 0;
very long texts are scanned whole; overlapping places count each; repeated rows
are files of their own; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, text_of

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label, notice (lower-cased words, as published), mandatory key phrase.
TEMPLATES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "source and binary forms"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", "associated cc0 with"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it under the terms of the gnu general public license", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    ("reserved", "copyright all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "without any express or implied warranty"),
]
MIN_SCORE = 0.5


def license_words(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(text_of(text)), SEPARATORS, -1), "")


def _phrase_starts(words: Column, phrase: str) -> Column:
    """Starts of every place where the phrase's words stand consecutively."""
    parts = phrase.split()
    here = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(words, i + k) == p, F.lit(False)) for k, p in enumerate(parts)])
    there = reduce(lambda a, b: a & b, [F.array_contains(words, p) for p in parts])
    none = F.array().cast("array<int>")
    return F.when(there, F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)).otherwise(none)


def _index() -> tuple[list[tuple[str, int, int]], Column]:
    """Postings (word, template, position) of the key phrases' words, and the templates."""
    starts = [len(notice[: re.search(rf"\b{key}\b", notice).start()].split()) for _, notice, key in TEMPLATES]
    postings = [
        (w, t, at + k)
        for t, ((_, _, key), at) in enumerate(zip(TEMPLATES, starts, strict=True)) for k, w in enumerate(key.split())
    ]
    lit = lambda words: F.array(*[F.lit(w) for w in words])
    templates = F.array(*[
        F.struct(
            F.lit(label).alias("label"), lit(notice.split()).alias("words"),
            lit(key.split()).alias("key"), F.lit(at).alias("at"),
        )
        for (label, notice, key), at in zip(TEMPLATES, starts, strict=True)
    ])
    return postings, templates


def rare_postings(worded: DataFrame, postings: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of each template the posting of its rarest word; at most one row for each word of the key phrases is collected."""
    known = F.array(*[F.lit(w) for w in sorted({w for w, *_ in postings})])
    rows = (
        worded.select(F.explode(F.array_intersect(known, "_ik_words")).alias("w"))
        .groupBy("w").agg(F.count("*").alias("df")).collect()
    )
    df = {r["w"]: r["df"] for r in rows}
    return [min((p for p in postings if p[1] == t), key=lambda p: (df.get(p[0], 0), p)) for t in range(len(TEMPLATES))]


def scan_licenses(files: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """One row a file: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    worded = files.select("doc_id", license_words(F.col("text")).alias("_ik_words"))
    postings, templates = _index()
    rare = rare_postings(worded, postings)
    postings = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("t"), F.lit(k).alias("k")) for w, t, k in rare])
    words = F.col("_ik_words")
    known = F.array(*[F.lit(w) for w in sorted({w for w, *_ in rare})])

    def proposed(i: Column) -> Column:
        """Alignments that the word at i proposes."""
        own = F.filter(postings, lambda p: p["word"] == F.get(words, i))
        return F.transform(own, lambda p: F.struct(p["t"].alias("t"), (i - p["k"]).alias("start")))

    def scored(c: Column) -> Column:
        t = F.get(templates, c["t"])
        key_at = c["start"] + t["at"]
        whole = (key_at >= 0) & (F.slice(words, F.greatest(key_at + 1, F.lit(1)), F.size(t["key"])) == t["key"])
        hits = F.size(F.filter(t["words"], lambda w, j: F.coalesce(F.get(words, c["start"] + j) == w, F.lit(False))))
        return F.when(whole, F.struct(t["label"].alias("label"), (hits / F.size(t["words"])).alias("score")))

    nothing = F.array().cast("array<struct<label:string,score:double>>")
    looked_up = worded.withColumn("_ik_rare", F.array_intersect(known, words))
    looked_up = looked_up.withColumn(
        "_ik_places",
        F.when(F.size("_ik_rare") > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains("_ik_rare", F.get(words, i))))
        .otherwise(F.array().cast("array<int>")),
    )
    for k, phrase in enumerate(BASE):
        looked_up = looked_up.withColumn(f"_ik_base{k}", _phrase_starts(words, phrase))
    found = F.when(
        F.size("_ik_places") > 0,
        F.filter(
            F.transform(F.flatten(F.transform("_ik_places", proposed)), scored),
            lambda x: x.isNotNull() & (x["score"] >= min_score),
        ),
    ).otherwise(nothing)
    bases = [F.col(f"_ik_base{k}") for k in range(len(BASE))]
    labels = F.filter(
        F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, label in zip(bases, BASE.values(), strict=True)]),
        lambda x: x.isNotNull(),
    )
    out = looked_up.select("doc_id", F.size(words).cast("long").alias("n_words"), F.flatten(F.array(*bases)).alias("_ik_starts"), labels.alias("_ik_labels"), found.alias("_ik_found"))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.select(
        "doc_id", "n_words", F.size("_ik_starts").cast("long").alias("n_base"),
        F.array_min("_ik_starts").cast("long").alias("first_word"), F.array_max("_ik_starts").cast("long").alias("last_word"),
        joined(F.col("_ik_labels")).alias("base_labels"),
        joined(F.concat("_ik_labels", F.transform("_ik_found", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("_ik_starts") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_ik_found", lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )
