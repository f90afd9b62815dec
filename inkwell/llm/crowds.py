"""Candidate pairs inside a crowd: many alike texts, few or none of which are links.

Among texts made from one template nearly all pairs look alike, so bands of their
sets can't tell the pairs above the threshold from those just below. What tells
them apart is how each differs from what they share. A crowd has a pivot, the
shingles that more than half of ``SAMPLED`` members hold, and each member x
becomes D(x), its difference from the pivot. For any pivot

    |x - y| + |y - x| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|,

so the pivot decides how well links stand out, never what is one. Sets x and y
are linked if |x - y| + |y - x| is at most t = (|x| + |y|) (100 - percent) / (100 +
percent), which leaves two kinds of links.

Either |D(x)| + |D(y)| <= t, and no common entry is needed. Then 180 |D| - 20 |.|
(for 80 percent) of both adds up to zero or less, and both are linked with the
member of the crowd for which it is least: a star round it joins them all.

Or they must have a common entry of D. Entries that one member alone has can't be
common; the others of a member are taken rarest first. Of the two, the one with the
smaller D lacks at most t / 2 of the other's entries, its own included, so that
the rarest common entry is among its first t / 2 - own + 1. Members meet in the
lists of these entries, filtered by size and by the places of the entry in both,
and what is left is counted in full before it is confirmed on the texts.

Lists of more than ``LISTED`` members are met in parts: members fall into as many
parts as the list needs by their hash, and each pair of parts is a group of its own,
so a group stays within bounds, every pair of the list is looked at, and a long
list is the work of many tasks. That work grows with the square of the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, given_back, written
from .hashing import LOWER
from .minhash import shingle_sets

#: Members whose majority is the pivot of a crowd; any pivot gives right results.
SAMPLED = 15
#: Members of a bucket up to which all of them are paired without a crowd.
LEAF = 12
#: Members with an entry, up to which all of them meet in one group.
LISTED = 256


def lowered(texts) -> list[bytes]:
    return [(t or "").encode().translate(LOWER) for t in texts]


def _pivot(width: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sets = shingle_sets(lowered(frame["text"]), width)
        shingles, n = np.unique(np.concatenate(sets), return_counts=True)
        return pd.DataFrame({"crowd": frame["crowd"].iloc[:1], "pivot": [shingles[2 * n > len(sets)].tobytes()]})

    return run


def _differences(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pivots = [np.frombuffer(p, np.uint64) for p in frame["pivot"]]
            sets = shingle_sets(lowered(frame["text"]), width)
            sizes = [len(s) for s in sets]
            each = [np.setxor1d(s, p, assume_unique=True) for s, p in zip(sets, pivots, strict=True)]
            yield frame[["crowd", "rep", "part"]].assign(n=sizes, differ=[d.view(np.int64) for d in each])

    return given_back(run)


def apart_at_most(total: Column, percent: int) -> Column:
    """Shingles that two linked sets of ``total`` shingles don't share, at most."""
    return F.floor(total * F.lit(100 - percent) / F.lit(100 + percent))


def listed_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that common entries may make links.

    ``members``: crowd, member, rep, part, n shingles, size of the difference, own
    entries of it, and ``shared``, the others with their members, rarest first.
    """
    ends = members.groupBy("crowd").agg(F.max("n").alias("most"), F.min("own").alias("least_own"))
    bound = apart_at_most(F.col("n") + F.least("most", F.floor(F.col("n") * 100 / F.lit(percent))), percent)
    sized = members.join(ends, "crowd").withColumns({"first": F.floor(bound / 2) - F.col("own") + 1, "all": bound - F.col("own") - F.col("least_own") + 1})
    taken = F.slice("shared", F.lit(1), F.greatest(F.lit(0), F.col("all")).cast("int"))
    entries = sized.select("crowd", "member", "part", "n", "size", "own", "first", F.size("shared").alias("held"), F.posexplode(taken).alias("at", "of"))
    entries = entries.select("*", "of.entry", "of.members").drop("of")
    # A member of part p of a list stands in the groups (p, q) and (q, p) of all parts q; a short list has one part.
    parts = F.ceil(F.col("members") / F.lit(LISTED)).cast("int")
    dealt = entries.withColumns({"mine": F.pmod(F.xxhash64("member"), parts).cast("int"), "other": F.explode(F.sequence(F.lit(0), parts - 1))}).drop("members")
    other = dealt.drop("first").select("crowd", "entry", F.col("mine").alias("other"), F.col("other").alias("mine"), *[F.col(c).alias(f"{c}_b") for c in ("member", "part", "n", "size", "own", "held", "at")])
    bound = apart_at_most(F.col("n") + F.col("n_b"), percent)
    fits = (
        (F.struct("size", "member") < F.struct(F.col("size_b").alias("size"), F.col("member_b").alias("member"))) & (F.col("part") != F.col("part_b"))
        & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))
        & (F.col("at") + F.col("own") + F.col("at_b") + F.col("own_b") <= bound)
        & (F.col("size") + F.col("size_b") - 2 * F.least(F.col("held") - F.col("at"), F.col("held_b") - F.col("at_b")) <= bound)
    )
    met = dealt.where(F.col("at") < F.col("first")).join(other, ["crowd", "entry", "mine", "other"]).where(fits).select("member", "member_b").distinct()
    one = members.select("member", "rep", "n", "size", F.col("shared.entry").alias("entries"))
    two = one.select(*[F.col(c).alias(f"{c}_b") for c in one.columns])
    counted = met.join(one, "member").join(two, "member_b").where(
        F.col("size") + F.col("size_b") - 2 * F.size(F.array_intersect("entries", "entries_b")) <= bound
    )
    return counted.select(F.least("rep", "rep_b").alias("a"), F.greatest("rep", "rep_b").alias("b"))


def crowd_pairs(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of the members (crowd, rep, part), whose texts are (doc_id, text); a rep of two texts is two members."""
    some = members.withColumn("_ik_n", F.row_number().over(Window.partitionBy("crowd").orderBy(F.xxhash64("rep"), "rep"))).where(F.col("_ik_n") <= SAMPLED)
    stored = texts.select(F.col("doc_id").alias("rep"), "text")
    pivots = written(some.join(stored, "rep").select("crowd", "text").groupBy("crowd").applyInPandas(_pivot(width), "crowd long, pivot binary"), "pivots")
    differ = members.join(stored, "rep").join(pivots, "crowd").select("crowd", "rep", "part", "text", "pivot").mapInPandas(
        _differences(width), "crowd long, rep long, part long, n long, differ array<long>"
    )
    differ = written(differ.withColumns({"member": F.monotonically_increasing_id(), "size": F.size("differ")}), "differences")

    weight = (100 + percent) * F.col("size") - (100 - percent) * F.col("n")
    least = differ.groupBy("crowd").agg(F.min(F.struct(weight.alias("weight"), "rep", "part")).alias("near"))
    stars = differ.join(least, "crowd").where((F.col("part") != F.col("near.part")) & (weight + F.col("near.weight") <= 0))
    stars = stars.select(F.least("rep", "near.rep").alias("a"), F.greatest("rep", "near.rep").alias("b"))

    entries = differ.select("crowd", "member", F.explode("differ").alias("entry"))
    repeated = entries.groupBy("crowd", "entry").agg(F.count("*").alias("members")).where("members > 1")
    shared = entries.join(repeated, ["crowd", "entry"]).groupBy("member").agg(F.sort_array(F.collect_list(F.struct("members", "entry"))).alias("shared"))
    held = differ.drop("differ").join(shared, "member").withColumn("own", F.col("size") - F.size("shared"))
    held = written(held, "shared")
    found = written(listed_pairs(held, percent).union(stars).distinct(), "pairs")
    discard(pivots, differ, held)
    return found
