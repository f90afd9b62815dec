"""Quality rules with thresholds that adapt to each language and source.

Every document gets measures; their distributions are kept as mergeable
quantile sketches per (lang, source): counts of logarithmic buckets, whose
values have a relative error of at most ``ERROR``. Counts add up over partitions
in any order, so results never depend on the order of the data. Each group's
sketch is merged with that of its language, which counts as ``PRIOR`` documents
more: the fewer documents a group has, the more its language decides.

A measure may lie ``spread`` scales from its group's median; the scale is the
interquartile range (as standard deviations) or the mean distance from the
median, whichever is more, so no threshold is a constant. A document fails where
a measure lies beyond even when chance is allowed for: ``CHANCE`` standard
errors of its count, or of the mean length of its words.

Defined results: a null or blank text has no words, all measures 0, and fails
the base rule (fewer than 10 words). A null language or source is a group of
its own. Repeated rows count each. Extra columns are carried by
``filter_quality`` and ignored by ``quality_report``; columns of the same name
as a measure are replaced in the report. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, text_of, words_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Whether too low values of a measure fail too.
MEASURES = {"symbol_share": False, "dup_line_share": False, "word_length": True}
#: Relative error of the sketches, and the bucket of 0.
ERROR = 0.005
GAMMA = (1 + ERROR) / (1 - ERROR)
ZERO = -1_000_000
SPREAD, PRIOR, CHANCE = 4.0, 20, 2.0
#: Interquartile range of a normal distribution, in standard deviations.
QUARTILES_APART = 1.349
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _tied_starts(pairs: Column) -> Column:
    """Starts, in order, of the windows whose hash equals a neighbour's in the sorted pairs."""
    starts = F.transform(
        pairs,
        lambda e, j: F.when(
            F.coalesce(e["h"] == F.get(pairs, j - 1)["h"], F.lit(False))
            | F.coalesce(e["h"] == F.get(pairs, j + 1)["h"], F.lit(False)),
            e["i"],
        ),
    )
    return F.array_sort(F.filter(starts, lambda x: x.isNotNull()))


def _covered(starts: Column) -> Column:
    """Words that windows at these starts cover."""
    widths = F.transform(
        starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW)))
    )
    return F.aggregate(widths, F.lit(0), lambda a, b: a + b)


def repeated_words(windows: Column) -> Column:
    """Words in windows whose hash stands twice or more in the array ``windows``.

    One-element arrays bind the sorted pairs and the starts, so that each is
    made once; texts without a repeated window skip all of it.
    """
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    bound = F.transform(F.array(pairs), _tied_starts)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        F.get(F.transform(bound, _covered), 0)
    )


def with_measures(docs: DataFrame) -> DataFrame:
    """``docs`` as ``_ik_row`` beside the counts, ``n_lines`` and the measures."""
    text = text_of(F.col("text"))
    blankless = F.length(F.translate(text, WHITE, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(WHITE)) != "")
    out = docs.select(
        F.struct("*").alias("_ik_row"), "lang", "source",
        words_of(F.col("text")).alias("_ik_words"),
        lines.alias("_ik_lines"),
        blankless.cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    n = F.size("_ik_words")
    out = out.withColumns({"_ik_hashes": F.transform("_ik_words", lambda w: F.xxhash64(w)), "n_words": n.cast("long")})
    windows = F.when(
        F.col("n_words") > WINDOW,
        F.transform(
            F.slice("_ik_hashes", F.lit(1), F.col("n_words").cast("int") - WINDOW + 1),
            lambda h, i: F.xxhash64(h, *[F.get("_ik_hashes", i + k) for k in range(1, WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<long>"))
    out = out.withColumn("_ik_windows", windows)
    out = out.withColumns({
        "n_lines": F.size("_ik_lines").cast("long"),
        "n_dup_lines": (F.size("_ik_lines") - F.size(F.array_distinct("_ik_lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_ik_windows")).cast("long"),
    }).drop("_ik_words", "_ik_lines", "_ik_hashes", "_ik_windows")
    some = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "symbol_share": some("n_symbols", "word_chars"),
        "dup_line_share": some("n_dup_lines", "n_lines"),
        "word_length": some("word_chars", "n_words"),
    })


def bucket_of(x: Column) -> Column:
    return F.when(x > 0, F.ceil(F.round(F.log(x) / math.log(GAMMA), 9)).cast("int")).otherwise(F.lit(ZERO))


def value_of(bucket: Column) -> Column:
    """The middle of a bucket, from which no value in it is further than ``ERROR``."""
    return F.when(bucket == ZERO, F.lit(0.0)).otherwise(F.exp(bucket * math.log(GAMMA)) * (2 / (GAMMA + 1)))


def sketches(measured: DataFrame) -> DataFrame:
    """Quantile sketches: (lang, source, measure, bucket, n), mergeable by adding n."""
    buckets = F.array(*[F.struct(F.lit(m).alias("measure"), bucket_of(F.col(m)).alias("bucket")) for m in MEASURES])
    return (
        measured.select("lang", "source", F.explode(buckets).alias("b"))
        .groupBy("lang", "source", "b.measure", "b.bucket").agg(F.count("*").alias("n"))
    )


def thresholds(sketch: DataFrame, spread: float = SPREAD, prior: float = PRIOR) -> DataFrame:
    """One row a (lang, source) with ``low_``/``high_`` limits of every measure."""
    language = Window.partitionBy("lang", "measure")
    wide = sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    wide = wide.select(
        F.col("lang").alias("_ik_lang"), F.col("measure").alias("_ik_measure"), "bucket",
        (prior * F.col("n") / F.sum("n").over(language)).alias("weight"),
    )
    groups = sketch.select("lang", "source", "measure").distinct()
    shared = groups.join(wide, groups["lang"].eqNullSafe(wide["_ik_lang"]) & (groups["measure"] == wide["_ik_measure"]))
    own = sketch.select("lang", "source", "measure", "bucket", F.col("n").cast("double").alias("weight"))
    merged = own.unionByName(shared.select(*own.columns)).groupBy("lang", "source", "measure", "bucket").agg(F.sum("weight").alias("weight"))

    group = Window.partitionBy("lang", "source", "measure")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"upto": F.sum("weight").over(upto), "all": F.sum("weight").over(group)})
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q - 1e-6, value_of(F.col("bucket")))).over(group)
    ranked = ranked.withColumns({"q1": at(0.25), "median": at(0.5), "q3": at(0.75)})
    away = F.sum(F.col("weight") * F.abs(value_of(F.col("bucket")) - F.col("median"))) / F.max("all")
    scales = ranked.groupBy("lang", "source", "measure").agg(
        F.max("median").alias("median"), F.greatest((F.max("q3") - F.max("q1")) / QUARTILES_APART, away).alias("scale")
    )
    limits = []
    for m, low in MEASURES.items():
        mine = F.col("measure") == m
        limits.append(F.max(F.when(mine, F.col("median") + spread * F.col("scale"))).alias(f"high_{m}"))
        if low:
            limits.append(F.max(F.when(mine, F.col("median") - spread * F.col("scale"))).alias(f"low_{m}"))
    return scales.groupBy("lang", "source").agg(*limits)


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` with ``kept``. Limits are a row a group; Spark picks the join by their size."""
    limits = limits.withColumnsRenamed({"lang": "_ik_lang", "source": "_ik_source"})
    joined = measured.join(
        limits,
        measured["lang"].eqNullSafe(limits["_ik_lang"]) & measured["source"].eqNullSafe(limits["_ik_source"]),
    )
    # What is left of a measure when chance is allowed for; words vary by half their mean length.
    least = lambda count: F.col(count) - CHANCE * F.sqrt(count)
    some = lambda a, b: F.when(F.col(b) > 0, a / F.col(b)).otherwise(F.lit(0.0))
    chance = CHANCE / 2 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    fine = (
        (some(least("n_symbols"), "word_chars") <= F.col("high_symbol_share") + 1e-9)
        & (some(least("n_dup_lines"), "n_lines") <= F.col("high_dup_line_share") + 1e-9)
        & (F.col("word_length") * (1 - chance) <= F.col("high_word_length") + 1e-9)
        & (F.col("word_length") * (1 + chance) >= F.col("low_word_length") - 1e-9)
    )
    return joined.withColumn("kept", ~F.col("base_failed") & fine)


def quality_report(docs: DataFrame, spread: float = SPREAD, prior: float = PRIOR) -> DataFrame:
    """One row a document: doc_id, the counts, base_failed, kept and the measures.

    The measures are written first, so texts are read and split once.
    """
    slim = written(
        with_measures(docs).select(
            F.col("_ik_row.doc_id").alias("doc_id"), "lang", "source", *COUNTS, "n_lines", "base_failed", *MEASURES
        ),
        "measures",
    )
    out = judged(slim, thresholds(sketches(slim), spread, prior))
    return out.select("doc_id", *COUNTS, "base_failed", "kept", *MEASURES)


def filter_quality(docs: DataFrame, spread: float = SPREAD, prior: float = PRIOR) -> DataFrame:
    """The documents that pass, with all their columns.

    Documents and measures are written together: each text is measured once and
    never shuffled, and the filter can't be pushed below the measures.
    """
    measured = written(with_measures(docs), "measured")
    limits = thresholds(sketches(measured), spread, prior)
    return judged(measured, limits).where("kept").select("_ik_row.*")
