"""Layouts of data sets as one table of samples, and pages given as folders of regions or texts.

A root that isn't there gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import png
from ..functions.text import compose_id, file_stem, normalize_text, safe_id
from ..operators.datasets import adapted, union_sources
from ..operators.numbering import numbered
from .files import exists
from .readers import images, manifest

SAMPLES = "image string, label string, source_image string, source_dataset string"
# Folders, label files and columns of the layouts that are read.
TREE = {
    "bd_training": ("Training/training_labels.csv", "Training/training_words"), "bd_validation": ("Validation/validation_labels.csv", "Validation/validation_words"),
    "bd_testing": ("Testing/testing_labels.csv", "Testing/testing_words"),
}
TREE_COLUMNS = ("IMAGE", "MEDICINE_NAME")
FLAT = {
    "rxhand": ("Prescription_Labels.csv", "RxHand-Handwritten Prescription Word Image Dataset", "Images", "Text"),
    "archive_doctor_handwriting": ("doctor_handwriting_labels.csv", "img/img", "filename", "label"),
}


def _samples(spark: SparkSession, root: str, labels: str, folder: str, image: str, label: str) -> DataFrame | None:
    """Labelled images of a folder; labels whose image isn't there go."""
    root = root.rstrip("/")
    if not (exists(spark, f"{root}/{labels}") and exists(spark, f"{root}/{folder}")):
        return None
    rows = adapted(manifest(spark, f"{root}/{labels}", required=[image, label]), image, label)
    there = images(spark, f"{root}/{folder}", recursive=False).select(F.regexp_extract("path", "([^/]*)$", 1).alias("source_image")).distinct()
    return rows.join(there, "source_image").select(F.concat(F.lit(f"{root}/{folder}/"), "image").alias("image"), "label", "source_image")


def split_tree(spark: SparkSession, root: str) -> DataFrame:
    """Samples of a tree of splits, tagged with the split that they come from."""
    found = {tag: _samples(spark, root, labels, folder, *TREE_COLUMNS) for tag, (labels, folder) in TREE.items()}
    return _united(spark, found)


def flat(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """Samples of one label file and one folder."""
    return _united(spark, {layout: _samples(spark, root, *FLAT[layout])})


def _united(spark: SparkSession, found: dict[str, DataFrame | None]) -> DataFrame:
    some = {tag: df for tag, df in found.items() if df is not None}
    return union_sources(some).select("image", "label", "source_image", "source_dataset") if some else spark.createDataFrame([], SAMPLES)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(number, text): the non-blank lines of a text file, normalised, in order."""
    lines = F.transform(F.split("value", "\r?\n"), lambda x, k: F.struct(k.alias("k"), normalize_text(x).alias("text")))
    kept = F.filter(lines, lambda r: r["text"] != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(kept).alias("number", "line")).select("number", F.col("line.text").alias("text"))


def decoded(files: DataFrame) -> DataFrame:
    """Grey rasters (path, height, width, data) of image files (path, content); those that can't be read go.

    Binary grey maps (P5) and grey PNG are read here, other formats where Pillow is
    installed on the executors.
    """
    schema = "path string, height int, width int, data binary"
    arrow = [("path", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["path", "content"]).to_pylist():
                page = grey(row["content"])
                if page is not None:
                    values = (row["path"], *page.shape, np.ascontiguousarray(page).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(values, arrow, strict=True)], schema=pa.schema(arrow))

    return files.select("path", "content").mapInArrow(run, schema)


def grey(content: bytes) -> np.ndarray | None:
    """The grey raster of an image file, or None."""
    try:
        if content[:2] == b"P5":
            fields, at = [], 2
            while len(fields) < 3:
                line_end = content.index(b"\n", at)
                fields += [int(x) for x in content[at:line_end].split(b"#")[0].split()]
                at = line_end + 1
            w, h, _ = fields
            return np.frombuffer(content, np.uint8, w * h, at).reshape(h, w)
        if (page := png.decoded(content)) is not None:
            return page
        import io

        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(content)).convert("L"))
    except Exception:  # whatever an unreadable file raises, it is skipped
        return None


def region_folder(spark: SparkSession, path: str) -> DataFrame:
    """Region rows for a folder of region images: each is a page of its own, and its box the whole image."""
    files = decoded(images(spark, path, content=True)).withColumn("page_id", safe_id(file_stem(F.col("path"))))
    return files.select(
        "page_id", compose_id(F.col("page_id"), "r", F.lit(0)).alias("region_id"), F.col("path").alias("region_image_path"),
        F.lit(0).alias("x1_page"), F.lit(0).alias("y1_page"), F.col("width").alias("x2_page"), F.col("height").alias("y2_page"), "width", "height", "data",
    )


def in_listing_order(files: DataFrame) -> DataFrame:
    """``files`` with number: their place in order of path."""
    return numbered(files, ["path"], "number")
