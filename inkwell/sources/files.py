"""A sink that writes a file for each name, for tools that read files: images, labels beside them, lists.

Each task stages its files and moves them into place when it has all of them; a
task that fails leaves nothing, one that is repeated writes the same names again,
and a job that fails removes its folder. Paths are local, or of any store that
Arrow reaches.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT, STAGED, DONE = "inkwell_files", "_temporary", "_SUCCESS"


def store_of(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


def make_below(store: arrow_fs.FileSystem, root: str, folder: str) -> None:
    """A folder below the root, level by level: where a job has been given up and its root removed, tasks that are late don't bring it back."""
    for name in folder.split("/") if folder else []:
        root = posixpath.join(root, name)
        store.create_dir(root, recursive=False)


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path
        store, root = store_of(path)
        store.create_dir(posixpath.join(root, STAGED), recursive=True)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = store_of(self.path)
        own = posixpath.join(root, STAGED, uuid.uuid4().hex)
        store.create_dir(own, recursive=False)
        names: list[str] = []
        size, out = 0, None
        try:
            for row in iterator:
                if not names or row["name"] != names[-1]:
                    if out:
                        out.close()
                    if not row["name"] or posixpath.isabs(row["name"]) or ".." in row["name"].split("/"):
                        raise ValueError(f"not a name inside the folder: {row['name']!r}")
                    names.append(row["name"])
                    out = store.open_output_stream(posixpath.join(own, str(len(names))))
                out.write(row["content"] or b"")
                size += len(row["content"] or b"")
            if out:
                out.close()
            for folder in {posixpath.dirname(n) for n in names}:
                make_below(store, root, folder)
            for k, name in enumerate(names):
                store.move(posixpath.join(own, str(k + 1)), posixpath.join(root, name))
        finally:
            if store.get_file_info(own).type != arrow_fs.FileType.NotFound:
                store.delete_dir(own)
        return Written(len(names), size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.path)
        some = [m for m in messages if m is not None]
        if store.get_file_info(posixpath.join(root, STAGED)).type != arrow_fs.FileType.NotFound:
            store.delete_dir(posixpath.join(root, STAGED))
        store.create_dir(root, recursive=True)
        with store.open_output_stream(posixpath.join(root, DONE)) as out:
            out.write(json.dumps({"files": sum(m.files for m in some), "bytes": sum(m.size for m in some)}).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.path)
        if store.get_file_info(root).type != arrow_fs.FileType.NotFound:
            store.delete_dir(root)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_files(rows: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A file for each name of ``rows`` (name, content) in a new folder.

    Names differ, or with ``order`` the rows of a name are parts of one file, in
    that order; they pass one task, which holds one of them at a time.
    """
    if exists(rows.sparkSession, path):
        raise ValueError(f"{path} exists")
    if order:
        rows = rows.repartition("name").sortWithinPartitions("name", *order)
    rows.sparkSession.dataSource.register(Files)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format(FORMAT).mode("append").option("path", path).save()
