"""Pieces that several operators share: words, folders, sizes, running sums.

Internal columns start with ``_ik_``; an input column of such a name is not
supported, every other extra column is carried or ignored as the operator says.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word contracts: U+0020 and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = "[ \\t-\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words_of(c: Column) -> Column:
    """White-space separated words; null and blank texts give an empty array."""
    t = F.trim(text_of(c), F.lit(WHITE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE_RUN, -1))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set and all tasks run here."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = shared or tempfile.mkdtemp(prefix="inkwell-")
        sc.setCheckpointDir(shared)
    return shared or sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for a written table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/inkwell-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage: a lost executor costs its own tasks only.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._ik_path = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._ik_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def given_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; at its end the memory that Arrow's pool keeps free goes back to the system.

    Workers outlive their tasks and count with their executor while later stages
    run; what the pool keeps would add to all of them.
    """

    def task(found: Iterator) -> Iterator:
        try:
            yield from run(found)
        finally:
            pa.default_memory_pool().release_unused()

    return task


def running_sum(
    df: DataFrame, group: str, order: list[str], bucket: str, value: str, out: str
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in its group.

    Rows are in order of ``bucket`` and then ``order``. Two levels, so that no
    task holds a whole group: one window a bucket, and one over the sums of the
    buckets. ``group`` may be null.
    """
    part = Window.partitionBy(group, bucket)
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_ik_sum"))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col(group).alias("_ik_g"), F.col(bucket).alias("_ik_b"),
        F.coalesce(F.sum("_ik_sum").over(ahead), F.lit(0)).alias("_ik_ahead"),
    )
    inner = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_ik_local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = local.join(sums, local[group].eqNullSafe(sums["_ik_g"]) & (local[bucket] == sums["_ik_b"]))
    return joined.withColumn(out, F.col("_ik_local") + F.col("_ik_ahead")).drop(
        "_ik_local", "_ik_ahead", "_ik_g", "_ik_b"
    )
