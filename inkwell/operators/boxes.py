"""Ordered operators on boxes and profiles: islands, merges, bands, attachments.

Merges that depend on the box grown so far are folds over sorted arrays, which
stay in the JVM; a group is the boxes of one region or line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import layout as L


def islands(profile: DataFrame, group: str, at: str, hit: Column, min_length: int = 1) -> DataFrame:
    """(group, first, last): maximal runs of places where ``hit`` holds, of ``min_length`` at least.

    ``last`` is the place after the run, or the last place of the profile where
    the run goes to its end. Places are consecutive from 0.
    """
    order = Window.partitionBy(group).orderBy(at)
    ends = profile.withColumn("_end", F.max(at).over(Window.partitionBy(group)))
    runs = ends.where(hit).withColumn("_run", F.col(at) - F.row_number().over(order)).groupBy(group, "_run").agg(
        F.min(at).alias("first"), F.max(at).alias("_last"), F.max("_end").alias("_end")
    )
    long = F.col("_last") - F.col("first") + 1 >= min_length
    return runs.where(long).select(group, "first", F.least(F.col("_last") + 1, F.col("_end")).alias("last"))


def merge_spans(spans: DataFrame, group: str, gap: int) -> DataFrame:
    """Spans (first, last) at most ``gap`` apart become one."""
    order = Window.partitionBy(group).orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("first") - reach <= gap, 0).otherwise(1)
    numbered = spans.withColumn("_new", new).withColumn("_span", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(group, "_span").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_span")


def _collected(boxes: DataFrame, group: str, first: str, second: str) -> DataFrame:
    rest = [c for c in ("x1", "y1", "x2", "y2") if c not in (first, second)]
    order = [first, second, *rest]
    sorted_boxes = F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in order])))
    as_box = lambda b: F.struct(*[b[c].alias(c) for c in ("x1", "y1", "x2", "y2")])
    return boxes.groupBy(group).agg(sorted_boxes.alias("_b")).select(group, F.transform("_b", as_box).alias("boxes"))


def _exploded(rows: DataFrame, group: str, boxes: Column) -> DataFrame:
    return rows.select(group, F.explode(boxes).alias("b")).select(group, "b.*")


def merge_bands(boxes: DataFrame, group: str, gap: int) -> DataFrame:
    """Line boxes by (y1, x1) that overlap the last band vertically, or whose middles are near, join it."""
    return _exploded(_collected(boxes, group, "y1", "x1"), group, L.bands(F.col("boxes"), F.lit(gap)))


def merge_words(boxes: DataFrame, group: str, gap: int) -> DataFrame:
    """Components by (x1, y1) within ``gap`` of the last word and close to it vertically join it."""
    return _exploded(_collected(boxes, group, "x1", "y1"), group, L.runs_of_words(F.col("boxes"), F.lit(gap)))


def band_components(boxes: DataFrame, group: str, tolerance: int) -> DataFrame:
    """Components by (middle, x1) each join the first of all bands whose middle is near."""
    return _exploded(_collected(boxes, group, "y1", "x1"), group, L.first_fit(F.col("boxes"), F.lit(tolerance)))


def refine_lines(boxes: DataFrame, profiles: DataFrame, group: str) -> DataFrame:
    """Line boxes cut apart at the row of least ink between neighbours.

    ``profiles`` has for each group row_ink (array), height and median_height.
    """
    joined = _collected(boxes, group, "y1", "x1").join(profiles.select(group, "row_ink", "height", "median_height"), group)
    return _exploded(joined, group, L.refined(F.col("boxes"), F.col("row_ink"), F.col("median_height"), F.col("height")))


def choose_candidates(sets: DataFrame, group: str, height: Column) -> DataFrame:
    """The best candidate set of each region: rows (group, method, seq, x1..y2); none without boxes.

    Sets score by boxes less twice the giant ones, then even heights, then a
    share of the region near 0.32; the first wins ties.
    """
    h = F.greatest(F.lit(1), F.col("y2") - F.col("y1")).cast("double")
    scored = sets.groupBy(group, "method", "seq").agg(
        F.count("*").alias("n"), F.count_if(h > 0.32 * height).alias("giant"), F.stddev_pop(h).alias("spread"), (F.sum(h) / F.max(height)).alias("share")
    )
    rank = F.struct(
        (F.col("n") - 2 * F.col("giant")).alias("a"), (-F.bround("spread", 9)).alias("b"), (-F.abs(F.bround(F.col("share") - 0.32, 9))).alias("c"), (-F.col("seq")).alias("d")
    )
    return scored.groupBy(group).agg(F.max_by(F.struct("method", "n"), rank).alias("m")).select(group, "m.method", "m.n")


def attach_small(words: DataFrame, small: DataFrame, group: str, distance: int) -> DataFrame:
    """Small boxes, by (x1, y1), each go to the nearest word within ``distance``, which grows before the next one.

    Near is the gap from the box's middle to the word's x-interval and 0.35 of
    the gap of their middles; the first word wins ties. Words stand by (x1, y1).
    """
    few = _collected(small, group, "x1", "y1").withColumnRenamed("boxes", "small")
    joined = _collected(words, group, "x1", "y1").join(few, group, "left")
    return _exploded(joined, group, L.with_small(F.col("boxes"), F.coalesce("small", L.none()), F.lit(distance)))
