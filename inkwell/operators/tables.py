"""Tables that are written once to the shared folder, so that later steps neither repeat nor lose the work before."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set and all tasks run here."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and known.isDefined():
        folder = known.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inkwell-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written as Parquet and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._path = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def once_each(rows: DataFrame, column: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``f`` adds to a table of the different values of a column: equal values are worked on once.

    The rows are written once, since they are read twice and may come from a model.
    """
    kept = written(rows, "rows")
    found = written(f(kept.select(column).distinct()), "found").withColumnRenamed(column, "_of")
    return kept.join(found, kept[column].eqNullSafe(found["_of"])).drop("_of")
