"""Mixing sources to target weights.

Each document gets a hash-random key; each source is range-sorted by it into
buckets; prefix sums of the sizes run over the buckets and then inside them,
so no task holds a source. Every source is cut at its exact budget: the words
``[0, budget)`` of the sorted source, read again from its start when the
budget is larger than the source.

Targets: the sources, by code point with null last, weigh 3, 1, 2, repeating,
and share ``share`` of all sizes. A target stops at ``cap`` times its source;
what is over goes to the others by weight, until none is above. That fixed
point is ``min(cap * source_size, level * weight)`` for one level, which a
running sum over the sources (sorted by the level at which they are full)
finds without iteration.

Defined results: null and blank texts have size 0 and nothing taken; a null
doc_id is keyed by its text; repeated rows are documents of their own; if
all sizes are 0, so are the targets; extra columns are carried by
``mixed_documents`` and ignored by ``mix``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_RUN, running_sum, text_of, words_of, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
ROWS_A_BUCKET = 500
MAX_BUCKETS = 20_000
OUTPUTS = ["size", "source_size", "target", "taken"]


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n), a row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    full_at = F.col("cap") / F.col("weight")
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    ahead = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = sizes.withColumn("weight", weight).withColumn("cap", (cap * F.col("source_size")).cast("double"))
    s = s.withColumn("full_at", full_at).withColumns({
        "capped": F.coalesce(F.sum("cap").over(ahead), F.lit(0.0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)),
        "all": F.sum("source_size").over(every) * share,
    })
    s = s.withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
    # The level is that of the first source which it doesn't fill.
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(every)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return s.select("source", "source_size", "n", target.alias("target"))


def mix(docs: DataFrame, seed: str = "mix", **law) -> DataFrame:
    """``_ik_row`` (the document), doc_id, size, source_size, target and taken.

    ``taken`` counts the words that the mix takes from the document, repeats
    counted. The taken words of a source are its target, rounded down. Sizes and
    keys are written first, so texts are read and split once.
    """
    size = F.size(words_of(F.col("text"))).cast("long")
    sized = docs.select(
        F.struct("*").alias("_ik_row"), "doc_id", "source", size.alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of(F.col("text"))))).alias("_ik_key"),
    )
    sized = written(sized, "sizes")
    sums = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), **law)
    sums = sums.withColumnRenamed("source", "_ik_source")
    rows = F.greatest(F.lit(ROWS_A_BUCKET), F.sum("n").over(Window.partitionBy()) / MAX_BUCKETS)
    sums = sums.withColumn("_ik_buckets", F.ceil(F.col("n") / rows))
    placed = sized.join(sums, sized["source"].eqNullSafe(sums["_ik_source"]))
    share = F.conv(F.substring("_ik_key", 1, 8), 16, 10).cast("long")
    placed = placed.withColumn("_ik_bucket", F.floor(share * F.col("_ik_buckets") / (1 << 32)).cast("long"))
    placed = running_sum(placed, "_ik_source", ["_ik_key"], "_ik_bucket", "size", "_ik_start")

    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_ik_start")))
    return placed.withColumn("taken", (whole * F.col("size") + part).cast("long")).select(
        "_ik_row", "doc_id", *OUTPUTS
    )


def mix_report(docs: DataFrame, **law) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken. Texts are not shuffled."""
    return mix(docs.select("doc_id", "text", "source"), **law).select("doc_id", *OUTPUTS)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    kept = F.slice(words_of(text), F.lit(1), n.cast("int"))
    return F.array_join(kept, " ")


def mixed_documents(docs: DataFrame, **law) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, with its columns.

    The document at a source's cut gives its first words, joined by single
    spaces; documents without words are not taken.
    """
    taken, size = F.col("taken"), F.col("size")
    copies = F.ceil(taken / F.greatest(size, F.lit(1))).cast("int")
    mixed = mix(docs, **law).where("taken > 0").withColumn("_ik_copy", F.explode(F.sequence(F.lit(1), copies)))
    rest = taken - (F.col("_ik_copy") - 1) * size
    text = F.when(rest >= size, F.col("_ik_row.text")).otherwise(first_words(F.col("_ik_row.text"), rest))
    columns = [text.alias(c) if c == "text" else F.col(f"_ik_row.`{c}`").alias(c) for c in docs.columns]
    return mixed.select(*columns)
