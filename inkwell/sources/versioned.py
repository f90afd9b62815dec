"""Tables that are edited while others read them: versions with an atomic pointer.

A version is one small file that names the folder of each bucket of keys. Rows
are written first, then the file of the next version appears at once, or not at
all if another writer was faster. So readers see a whole version, the old one or
the new; of two writers who start from one version, one gets an error and leaves
nothing. An edit writes the buckets of its keys alone.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.annotate import first_rows, now, upsert

LOG, DATA, BUCKETS = "_versions", "data", 64


class Conflict(RuntimeError):
    """Another writer has made the version that this one would have made."""


def _store(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last version; 0 where there is none."""
    fs, make = _store(spark, path)
    log = make(f"{path}/{LOG}")
    names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/{LOG}/{version:09d}", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Make the file of a version, with all its content or not at all."""
    fs, make = _store(spark, path)
    draft, final = (f"{path}/{LOG}/{name}" for name in (f".draft-{uuid.uuid4().hex}", f"{version:09d}"))
    out = fs.create(make(draft), True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.getScheme() == "file":
        # A rename would replace; a second link to a name is refused.
        local = [fs.makeQualified(make(p)).toUri().getPath() for p in (draft, final)]
        try:
            os.link(*local)
            made = True
        except FileExistsError:
            made = False
        fs.delete(make(draft), False)
    else:
        made = not fs.exists(make(final)) and fs.rename(make(draft), make(final))
        if not made:
            fs.delete(make(draft), False)
    if not made:
        raise Conflict(f"version {version} of {path} exists")


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _commit(rows: DataFrame, path: str, key: str, version: int, kept: dict, schema: StructType) -> None:
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    fs, make = _store(spark, path)
    rows.select(*schema.names, _bucket(key).alias("_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{DATA}/{folder}")
    found = [f.getPath().getName() for f in fs.listStatus(make(f"{path}/{DATA}/{folder}")) if f.isDirectory()]
    folders = kept | {name.partition("=")[2]: folder for name in found}
    try:
        _publish(spark, path, version, {"key": key, "schema": schema.json(), "folders": folders})
    except Conflict:
        fs.delete(make(f"{path}/{DATA}/{folder}"), True)
        raise


def create(rows: DataFrame, path: str, key: str) -> int:
    """The first version of a table, whose rows have different keys."""
    _commit(rows, path, key, 1, {}, rows.schema)
    return 1


def _rows(spark: SparkSession, path: str, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    paths = [f"{path}/{DATA}/{folder}/_bucket={b}" for b, folder in manifest["folders"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table, the last one if none is given."""
    version = version or latest(spark, path)
    if not version:
        raise ValueError(f"{path} has no version")
    return _rows(spark, path, _manifest(spark, path, version))


def edit(spark: SparkSession, path: str, edits: DataFrame, order: list[str], base: int | None = None) -> int:
    """A new version with the edits; the last one of a key wins, what it leaves null stays, new keys are added.

    Rows that are edited get the time in updated_at, where the table has it.
    ``base`` is the version that the edits were made from; the last, if none is given.
    """
    base = base or latest(spark, path)
    manifest = _manifest(spark, path, base)
    key, schema = manifest["key"], StructType.fromJson(json.loads(manifest["schema"]))
    if "updated_at" in schema.names and "updated_at" not in edits.columns:
        edits = edits.withColumn("updated_at", now())
    touched = {str(r[0]) for r in edits.where(F.col(key).isNotNull()).select(_bucket(key)).distinct().collect()}
    before = _rows(spark, path, manifest, touched)
    last = first_rows(edits.where(F.col(key).isNotNull()), key, order)
    new = last.join(before.select(key), key, "left_anti")
    added = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    kept = {b: folder for b, folder in manifest["folders"].items() if b not in touched}
    _commit(upsert(before, edits, key, order).union(added), path, key, base + 1, kept, schema)
    return base + 1
