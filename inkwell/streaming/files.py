"""Incremental runs: new image or table files go through the same stateless stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def follow(spark: SparkSession, path: str, schema: str, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """Each batch of new files through ``stage`` and appended to ``out``, once each; ends when all there is was read."""
    stream = spark.readStream.schema(schema).format(file_format).load(path)
    return (
        stream.writeStream.foreachBatch(lambda df, _: stage(df).write.mode("append").parquet(out))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
