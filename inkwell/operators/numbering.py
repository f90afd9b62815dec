"""Global row numbers without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Rows that one task sorts, and the bits of a row number that count inside a partition.
TASK_ROWS, ROW_BITS = 1_000_000, 33


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """``rows`` with ``out``: 0, 1, ... in this order, nulls first; rows equal in it stand in any order.

    Ranges of the order, one for each ``TASK_ROWS``, are sorted by Spark and
    written once; each row gets its place in its range and the rows of all ranges
    ahead. Of the ranges themselves there is one row each.
    """
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("_range", F.shiftright("_place", ROW_BITS))
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy(F.col("_range").alias("_of")).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    ranges = ranges.select("_of", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_ahead"))
    joined = ranged.join(ranges, F.col("_range") == F.col("_of"))
    return joined.withColumn(out, F.col("_place") + F.col("_ahead")).drop("_place", "_range", "_of", "_ahead")
