"""Random shards by a two-pass external shuffle.

Pass one scatters the records by a seeded hash into buckets of about
``bucket_bytes``; pass two shuffles each bucket in memory (Spark's ``shuffle``
is a Fisher-Yates shuffle) and writes it. The shards are equal parts of the
resulting global order, so a bucket goes to one shard or a few and is not dealt
again. Law ``rows``: shard counts differ by one at most.

Rows that stand ``HEAVY`` times or more are numbered and scattered copy by copy,
so that no bucket holds all of them; every row stays itself.

Defined results: null texts count no bytes (crc 0 of the empty text); repeated
rows are separate records; a null doc_id is a value like any other; extra
columns are carried, but for those named like an output column, which are
replaced; an empty table gives an empty result. Every run over the same rows, in
any order, gives the same shards: two hashes cover all columns, maps by their
sorted entries, buckets are sorted before they are shuffled and the shuffle is
seeded by partition, whose number is fixed. Rows that are equal in all columns
are interchangeable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running_sum, text_of, written

OVERHEAD = 16
HEAVY = 1000
#: Buckets whose sums are run over in one window, and bits of a row number that count inside a partition.
BLOCK, ROW_BITS = 4096, 33
OUTPUTS = ["size", "bucket", "shard", "slot"]


def hashable(c: Column, kind: T.DataType) -> Column:
    """The column with its maps, wherever they are nested, as sorted arrays of their entries, which have a hash."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(hashable(e["key"], kind.keyType).alias("k"), hashable(e["value"], kind.valueType).alias("v"))
        return F.array_sort(F.transform(F.map_entries(c), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: hashable(x, kind.elementType)) if nests_maps(kind) else c
    if isinstance(kind, T.StructType) and nests_maps(kind):
        return F.when(c.isNotNull(), F.struct(*[hashable(c.getField(f.name), f.dataType).alias(f"f{k}") for k, f in enumerate(kind)]))
    return c


def nests_maps(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(nests_maps(f.dataType) for f in kind)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and nests_maps(kind.elementType)


def row_hash(seed: int, columns: list[Column]) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def numbered_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with copy: 1, 2, ... among those of equal hashes h and g, of which one pair may have most of them.

    They are written once with their places; a task numbers those of one pair and
    one partition, and adds how many there are in the partitions before.
    """
    placed = written(rows.withColumn("at", F.monotonically_increasing_id()), "heavy").withColumn("part", F.shiftright("at", ROW_BITS))
    before = Window.partitionBy("_ik_h", "_ik_g").orderBy("_ik_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(F.col("h").alias("_ik_h"), F.col("g").alias("_ik_g"), F.col("part").alias("_ik_part")).agg(F.count("*").alias("_ik_n"))
    parts = parts.withColumn("_ik_before", F.coalesce(F.sum("_ik_n").over(before), F.lit(0))).drop("_ik_n")
    inside = F.row_number().over(Window.partitionBy("h", "g", "part").orderBy("at"))
    joined = placed.withColumn("_ik_inside", inside).join(parts, (F.col("h") == F.col("_ik_h")) & (F.col("g") == F.col("_ik_g")) & (F.col("part") == F.col("_ik_part")))
    return joined.select("h", "g", "r", (F.col("_ik_before") + F.col("_ik_inside")).alias("copy"))


def shuffle_into_shards(
    docs: DataFrame, n_shards: int = 40, seed: int = 20, bucket_bytes: int = 8 << 20, min_buckets: int = 16
) -> DataFrame:
    """``docs`` with size, bucket, shard and slot (gapless from 0 in each shard)."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in OUTPUTS])
    sized = docs.withColumn("size", F.octet_length(text_of(F.col("text"))).cast("long") + OVERHEAD)
    columns = [hashable(F.col(f"`{f.name}`"), f.dataType) for f in docs.schema]
    row = F.struct(*[F.col(f"`{c}`") for c in sized.columns]).alias("r")
    rows = sized.select(row_hash(seed, columns).alias("h"), row_hash(seed + 2, columns).alias("g"), row)
    # One pass for all that is counted: rows and bytes of each pair of hashes.
    counts = written(rows.groupBy("h", "g").agg(F.count("*").alias("n"), F.sum("r.size").alias("size")), "counts")
    total, n_rows = counts.agg(F.sum("size"), F.sum("n")).first()
    n_rows, n_buckets = n_rows or 0, max(min_buckets, math.ceil((total or 0) / bucket_bytes))
    bucket_of = lambda h: F.pmod(h, F.lit(n_buckets)).cast("int").alias("bucket")
    dealt, dealt_counts = rows.select("h", "g", "r"), counts.where(F.col("n") < HEAVY).select(bucket_of(F.col("h")), "n")
    heavy = counts.where(F.col("n") >= HEAVY).select("h", "g")
    if not heavy.isEmpty():
        copies = numbered_copies(dealt.join(heavy, ["h", "g"], "left_semi")).withColumn("h", F.xxhash64("h", "copy"))
        dealt = dealt.join(heavy, ["h", "g"], "left_anti").unionByName(copies.drop("copy"))
        dealt_counts = dealt_counts.union(copies.select(bucket_of(F.col("h")), F.lit(1).cast("long")))
    scattered = dealt.select("h", "g", "r", bucket_of(F.col("h")))
    # The first record of each bucket, by running sums in two levels.
    per_bucket = dealt_counts.groupBy("bucket").agg(F.sum("n").alias("n")).withColumns({"every": F.lit(0), "block": F.expr(f"bucket div {BLOCK}")})
    starts = running_sum(per_bucket, "every", ["bucket"], "block", "n", "_ik_first").select(F.col("bucket").alias("_ik_bucket"), "_ik_first")
    by_key = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).when(a["g"] < b["g"], -1).when(a["g"] > b["g"], 1).otherwise(0)
    buckets = (
        scattered
        .select("bucket", F.struct(F.xxhash64(F.lit(seed + 1), "h").alias("k"), "g", "r").alias("_ik_e"))
        .repartition(n_buckets, "bucket")
        .groupBy("bucket").agg(F.array_sort(F.collect_list("_ik_e"), by_key).alias("_ik_all"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.posexplode(F.shuffle("_ik_all", seed)).alias("_ik_pos", "_ik_e"))
    )
    placed = buckets.join(starts, F.col("bucket") == F.col("_ik_bucket")).withColumn("_ik_place", F.col("_ik_first") + F.col("_ik_pos"))
    placed = placed.withColumn("shard", F.expr(f"_ik_place * {n_shards} div {max(n_rows, 1)}").cast("int"))
    # The first place of a shard: the least one of which this gives the shard.
    slot = F.expr(f"_ik_place - (shard * {n_rows}L + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("slot", slot.cast("long")).select("_ik_e.r.*", "bucket", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder a shard, with a file for each bucket that it has a part of, in order of slot."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of all shards; ``schema`` is that of the table that was written."""
    return spark.read.schema(schema).parquet(path)


def shard_digest(sharded: DataFrame) -> DataFrame:
    """One row a record: the columns that a shard's reader can check."""
    return sharded.select(
        "doc_id", "size", F.crc32(text_of(F.col("text")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "bucket",
    )
