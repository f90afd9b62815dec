import math
import random
import re
from collections import Counter

import pytest

from inkwell.llm.license_scan import BASE, MIN_SCORE, TEMPLATES, scan_licenses
from inkwell.llm.quality_rules import GAMMA, PRIOR, filter_quality, quality_report
from inkwell.llm.warc_revisits import canonical_url, records_of_pages, resolve_revisits

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOTICES = [
    "Licensed under CC BY 4.0", "cc by cc by; CC-BY", "all rights reserved All Rights Reserved.", "the GNU General Public License, version 3",
    "This program is free software: you can redistribute it under the terms of the GNU General Public License",
    "Released under the MIT license.", "all rights are reserved", "general public licenses", "ccby", "éall rights reserved",
]


def base(text):
    words = TERM.findall((text or "").translate(LOWER))
    found = [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


@pytest.fixture(scope="module")
def notices(spark, rows):
    more = [(90_000 + k, f"{rows[20 + k][1] or ''} {t} tail words", "en", "web", 0) for k, t in enumerate(NOTICES)]
    return [*rows, *more], spark.createDataFrame([*rows, *more], "doc_id long, text string, lang string, source string, n_chars int")


def test_base_phrases(notices):
    rows, df = notices
    got = {r["doc_id"]: r for r in scan_licenses(df).collect()}
    for i, text, *_ in rows:
        r = got[i]
        assert tuple(r)[:6] == (i, *base(text))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    assert got[90_005]["labels"] == "mit" and got[90_003]["labels"] == "gpl" and got[90_006]["labels"] == ""
    assert got[90_000]["labels"] == "cc-by" and got[90_000]["score"] == 1


def scan(text):
    """Labels and best score, by every alignment of every template."""
    words, found = TERM.findall((text or "").translate(LOWER)), []
    for label, notice, key in TEMPLATES:
        notice, key = notice.split(), key.split()
        at = next(k for k in range(len(notice)) if notice[k : k + len(key)] == key)
        for start in range(-at, len(words)):
            if words[start + at : start + at + len(key)] == key:
                hits = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(notice))
                found += [(hits / len(notice), label)] if hits >= MIN_SCORE * len(notice) else []
    labels = {x for _, x in found} | set(filter(None, base(text)[-1].split(",")))
    return ",".join(sorted(labels)), 1.0 if base(text)[1] else max([s for s, _ in found], default=0.0)


def test_files_of_several_notices(spark):
    gpl, mit = next(n for label, n, _ in TEMPLATES if label == "gpl"), "Released under the MIT license."
    every = [notice for _, notice, _ in TEMPLATES]
    texts = [
        f"{gpl}. {mit}", f"{mit} {gpl}", ". ".join(every), ". ".join(every[::-1]), ". ".join(every * 2), None, "",
        "; ".join(" ".join(n.split()[2:]) for n in every),
        "; ".join(f"{a} {b}" for a in every for b in (mit, "prose of the public and general kind")),
        *[f"{a}, {b}" for a in every[::2] for b in every[::3]], "Permission is hereby granted, free of charge", "the boost software license",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(df).collect()}
    assert got == {k: scan(t) for k, t in enumerate(texts)}
    assert got[0][0] == "gpl,mit" and set(got[2][0].split(",")) == {label for label, *_ in TEMPLATES}


def test_scan_of_odd_and_empty_tables(odd, nothing):
    assert scan_licenses(odd).count() == odd.count() and scan_licenses(nothing).count() == 0


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for k in range(len(words) - 4):
        seen.setdefault(tuple(words[k : k + 5]), []).append(k)
    repeated = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeated), n < 10 or 100 * len(repeated) > 20 * n)


def test_quality_counts(docs, rows):
    got = {r["doc_id"]: r for r in quality_report(docs).collect()}
    for i, text, *_ in rows:
        assert tuple(got[i])[1:7] == counts(text), i
        assert not (got[i]["kept"] and got[i]["base_failed"])
    kept = {i for i, r in got.items() if r["kept"]}
    assert {r["doc_id"] for r in filter_quality(docs).collect()} == kept


def verdicts(rows):
    """kept of each row, from weighted values instead of running sums."""
    bucket = lambda x: -math.inf if x <= 0 else math.ceil(round(math.log(x) / math.log(GAMMA), 9))
    middle = lambda b: 0.0 if b == -math.inf else 2 * GAMMA**b / (GAMMA + 1)
    measured, kept = [], []
    for _, text, lang, source, *_ in rows:
        n, chars, symbols, dup, _, failed = counts(text)
        lines = sum(bool(WORD.search(line)) for line in (text or "").split("\n"))
        measured.append((lang, source, n, chars, symbols, dup, lines, failed, (symbols / chars if chars else 0, dup / lines if lines else 0, chars / n if n else 0)))
    for lang, source, n, chars, symbols, dup, lines, failed, values in measured:
        limits = []
        for m in range(3):
            everywhere = Counter(bucket(x[-1][m]) for x in measured if x[0] == lang)
            weights = Counter(bucket(x[-1][m]) for x in measured if x[:2] == (lang, source))
            for b, k in everywhere.items():
                weights[b] += PRIOR * k / everywhere.total()
            order = sorted(weights)
            upto = [sum(weights[b] for b in order[: k + 1]) for k in range(len(order))]
            q1, q2, q3 = (middle(next(b for b, u in zip(order, upto, strict=True) if u >= q * upto[-1] - 1e-6)) for q in (0.25, 0.5, 0.75))
            scale = max((q3 - q1) / 1.349, sum(weights[b] * abs(middle(b) - q2) for b in order) / upto[-1])
            limits.append((q2 - 4 * scale, q2 + 4 * scale))
        low = lambda c, of: (c - 2 * c**0.5) / of if of else 0
        spread = 1 / max(n, 1) ** 0.5
        kept.append(
            not failed and low(symbols, chars) <= limits[0][1] + 1e-9 and low(dup, lines) <= limits[1][1] + 1e-9
            and values[2] * (1 - spread) <= limits[2][1] + 1e-9 and values[2] * (1 + spread) >= limits[2][0] - 1e-9
        )
    return kept


def test_quality_verdicts(spark, rows):
    r = random.Random(6)
    junk = [(70_000 + k, " ".join(r.choices(["#$%", "word", "||", "other", "longerwordsthanusual" * 2], k=30)) + f" {k}", r.choice(["en", "de", None]), r.choice(["web", "code"]), 0) for k in range(20)]
    lists = [(80_000 + k, "\n".join([f"line of some words {j % (3 + k)} {k}" for j in range(40)]), "en", "web", 0) for k in range(6)]
    every = [*rows, *junk, *lists]
    got = {x["doc_id"]: x["kept"] for x in quality_report(spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars int").repartition(5)).collect()}
    want = {row[0]: k for row, k in zip(every, verdicts(every), strict=True)}
    assert got == want and any(want.values()) and sum(not k for (i, *_), k in zip(every, want.values(), strict=True) if i >= 70_000) > 5


def test_quality_thresholds_adapt(spark):
    """A text of symbols fails among prose and passes where its source is like that."""
    prose = "these are plain words of a text that goes on and on for quite some while number"
    code = "if a < b && c > d | e { x = y * 2 & 3 } # comment with % and $ signs <<>> v"
    rows = [(k, f"{prose} {k}", "en", "web") for k in range(100)] + [(200 + k, f"{code}{k}", "en", "code") for k in range(100)]
    df = spark.createDataFrame([*rows, (500, f"{code}500", "en", "web")], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in filter_quality(df).collect()}
    assert kept == {k for k, *_ in rows}


def test_quality_of_odd_and_empty_tables(odd, nothing):
    assert quality_report(odd).count() == odd.count() and quality_report(nothing).count() == 0
    assert filter_quality(odd).columns == odd.columns and filter_quality(nothing).count() == 0


RECORD = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers map<string,string>, digest string, length long"


def test_revisits(spark):
    r = random.Random(2)
    urls = ["http://A.example/x?b=2&a=1#f", "https://a.example/x/?a=1&b=2&utm_source=z", "a.example:80/y", None]
    rows = []
    for k in range(400):
        kind = r.choice(["response", "revisit"])
        etag = r.choice(['"1"', 'W/"1"', '"2"', None])
        rows.append((k, r.choice(urls), r.choice([None, *range(60)]), kind, etag, r.choice(["d1", "d2", None]), {"ETag": etag or "", "X-Id": str(k), "Content-Length": "9"} if k % 5 else None, f"sha{k}" if kind == "response" else None, 9))
    canon = {urls[0]: "a.example/x?a=1&b=2", urls[1]: "a.example/x?a=1&b=2", urls[2]: "a.example/y", None: None}
    low = -(1 << 62)
    at = lambda x: (low if x[2] is None else x[2], x[0])
    want = {}
    for x in rows:
        if x[3] != "revisit":
            continue
        before = [y for y in rows if y[3] == "response" and canon[y[1]] == canon[x[1]] and at(y)[0] <= at(x)[0]]
        of = max(before, key=at, default=None)
        if of is None:
            want[x[0]] = (None, "no_antecedent")
            continue
        tags = x[4] is not None and of[4] is not None
        same = x[4].removeprefix("W/") == of[4].removeprefix("W/") if tags else x[5] is not None and x[5] == of[5]
        want[x[0]] = (of[0], "resolved" if same else "mismatch")
    df = spark.createDataFrame(rows, RECORD)
    for buckets in (1, 7, 4096):
        got = {y["record_id"]: y for y in resolve_revisits(df, buckets).collect()}
        assert {k: (y["refers_to"], y["status"]) for k, y in got.items()} == want
    for k, y in got.items():
        assert y["canonical"] == canon[rows[k][1]]
        if y["status"] == "resolved":
            assert y["digest"] == f"sha{y['refers_to']}"
            merged = dict(line.split(": ", 1) for line in y["headers"].split("\n") if line)
            if k % 5:
                assert merged["x-id"] == str(k)
            assert ("content-length" in merged) == (y["refers_to"] % 5 > 0)


def test_canonical_urls(spark):
    url = spark.createDataFrame([("HTTP://Host.Example:80/A/?z=1&utm_x=2&b=#q",), ("",), (None,)], "u string")
    assert [r[0] for r in url.select(canonical_url(url["u"])).collect()] == ["host.example/A?b=&z=1", "", None]


def test_revisits_of_odd_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>"), (1, "http://a/", "<p>"), (2, None, None), (None, "x", "y")], "page_id long, url string, html string")
    assert resolve_revisits(records_of_pages(pages)).count() == 4
    assert resolve_revisits(records_of_pages(pages.limit(0))).count() == 0
