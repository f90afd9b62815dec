"""Recognition metrics: one row each, from reference and hypothesis columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(c: Column) -> Column:
    """Half-even, two decimals."""
    return F.bround(100.0 * c, 2)


def exact_match(df: DataFrame, ref: str, hyp: str, fold: bool = False) -> DataFrame:
    a, b = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    same = F.lower(a) == F.lower(b) if fold else a == b
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(same.cast("long")), F.lit(0)).alias("n_same"), percent(F.avg(same.cast("double"))).alias("percent"))


def cer(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Character errors over reference characters; an empty reference counts one."""
    a, b = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    return df.agg(
        F.sum(F.levenshtein(a, b)).cast("long").alias("edits"), F.sum(F.greatest(F.lit(1), F.length(a))).cast("long").alias("length"),
    ).withColumn("percent", percent(F.col("edits") / F.col("length")))


def tokens_of(c: str) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != "")


def token_edits(ref: str, hyp: str) -> Column:
    """Word edit distance: each distinct word of the pair becomes a code point of its own.

    There are 1.1 million of these, past the surrogates; a pair of more
    distinct words fails, its table of distances could not be held either.
    """
    r, h = tokens_of(ref), tokens_of(hyp)

    def distance(vocabulary: Column) -> Column:
        def coded(words: Column) -> Column:
            place = lambda x: F.array_position(vocabulary, x)
            point = lambda x: F.lpad(F.hex(place(x) + F.when(place(x) < 0xD800, 0).otherwise(0x800)), 8, "0")
            return F.decode(F.unhex(F.array_join(F.transform(words, point), "")), "UTF-32")

        return F.levenshtein(coded(r), coded(h))

    return F.get(F.transform(F.array(F.array_union(r, h)), distance), 0)


def wer(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Word errors over reference words; an empty reference counts one."""
    return df.agg(
        F.sum(token_edits(ref, hyp)).cast("long").alias("edits"), F.sum(F.greatest(F.lit(1), F.size(tokens_of(ref)))).cast("long").alias("length"),
    ).withColumn("percent", percent(F.col("edits") / F.col("length")))
