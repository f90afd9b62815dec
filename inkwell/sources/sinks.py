"""Sinks: CSV and JSON tables, split trees, detector labels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import png
from ..functions.geometry import clamp, to_centre, valid
from ..functions.text import safe_name
from ..operators.annotate import now
from ..operators.datasets import numbered_in, rebased
from .files import write_files


def csv(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None, overwrite: bool = False) -> None:
    """The named columns with a header, even of an empty table; other columns are left out."""
    out = df.select(*columns)
    out = out.orderBy(*order) if order else out
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def splits(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A folder for each split."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def label_lines(boxes: DataFrame, image: str = "image_id", label: int = 0) -> DataFrame:
    """(image, lines): the boxes cx, cy, w, h of an image as text, six decimals, in order of row."""
    line = F.format_string(f"{label} %.6f %.6f %.6f %.6f", "cx", "cy", "w", "h")
    rows = boxes.groupBy(image).agg(F.array_sort(F.collect_list(F.struct("row", line.alias("line")))).alias("all"))
    return rows.select(image, F.array_join(F.col("all.line"), "\n").alias("lines"))


# Where the images and labels of a split stand in a tree of splits.
TREE = {
    "train": ("Training/training_words", "Training/training_labels.csv"), "val": ("Validation/validation_words", "Validation/validation_labels.csv"),
    "test": ("Testing/testing_words", "Testing/testing_labels.csv"),
}
TREE_COLUMNS = ["IMAGE", "MEDICINE_NAME", "SOURCE_DATASET", "SOURCE_IMAGE"]


def split_tree(rows: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Label tables of a data set, a folder for each split, with the images under new numbered names; the table (split, IMAGE, MEDICINE_NAME, SOURCE_DATASET, SOURCE_IMAGE, source) is returned.

    ``rows`` has split, image, label, source_dataset and source_image. Where they
    have ``content``, it is written too, so the table holds the images themselves.
    """
    rank = numbered_in(rows, "split", ["source_dataset", "image"], "_rank")
    suffix = F.lower(F.regexp_extract("image", r"(\.[^./]+)$", 1))
    name = F.concat(F.format_string("%06d_", "_rank"), safe_name(F.col("source_dataset")), suffix)
    content = ["content"] if "content" in rows.columns else []
    out = rank.select("split", name.alias("IMAGE"), F.col("label").alias("MEDICINE_NAME"), F.col("source_dataset").alias("SOURCE_DATASET"), F.col("source_image").alias("SOURCE_IMAGE"), F.col("image").alias("source"), *content)
    splits(out, path, overwrite)
    return out


def split_tree_files(tree: DataFrame, path: str) -> None:
    """The tree of ``split_tree`` (with content) as files: images in a folder for each split, and its label file beside it."""
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for split, places in TREE.items() for x in (split, places[k])]), F.col("split"))
    images = tree.select(F.concat(of(0), F.lit("/"), "IMAGE").alias("name"), F.lit("").alias("at"), "content")
    quoted = F.to_csv(F.struct(*TREE_COLUMNS), {"escape": '"', "emptyValue": ""})
    lines = tree.select(of(1).alias("name"), F.col("IMAGE").alias("at"), F.concat(quoted, F.lit("\r\n")).cast("binary").alias("content"))
    header = F.lit(",".join(TREE_COLUMNS) + "\r\n").cast("binary")
    heads = tree.select(of(1).alias("name")).distinct().select("name", F.lit("").alias("at"), header.alias("content"))
    write_files(images.union(lines).union(heads), path, order=["at"])


def label_files(boxes: DataFrame, path: str, image: str = "image_id", label: int = 0, names: list[str] | None = None) -> None:
    """Detector labels, labels/<image>.txt for each image that has boxes, and the class names in classes.txt."""
    lines = label_lines(boxes, image, label).select(F.concat(F.lit("labels/"), image, F.lit(".txt")).alias("name"), F.concat("lines", F.lit("\n")).alias("content"))
    kinds = lines.sparkSession.createDataFrame([("classes.txt", "".join(f"{n}\n" for n in names or ["region"]))], "name string, content string")
    write_files(lines.union(kinds), path)


def png_files(images: DataFrame, name: Column) -> DataFrame:
    """(name, content): grey rasters (height, width, data) as PNG."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pages = [np.frombuffer(d, np.uint8).reshape(h, w) for d, h, w in zip(frame["data"], frame["height"], frame["width"], strict=True)]
            yield pd.DataFrame({"name": frame["name"], "content": [png.encoded(p) for p in pages]})

    return images.select(name.alias("name"), "height", "width", "data").mapInPandas(run, "name string, content binary")


def crop_files(crops: DataFrame, path: str, key: str) -> None:
    """A PNG for each crop, named by its key."""
    write_files(png_files(crops, F.concat(F.col(key), F.lit(".png"))), path)


def layout_set(pages: DataFrame, boxes: DataFrame, path: str, class_name: str = "handwritten_region") -> None:
    """A detector's training set: images and labels of each split, and data.yaml.

    ``pages`` has page_id, split, height, width and data, ``boxes`` page_id, row
    and x1..y2 in pixels. Boxes are cut to their page; pages without any are left out.
    """
    sized = boxes.join(pages.select("page_id", "split", "width", "height"), "page_id")
    w, h = F.col("width"), F.col("height")
    cut = sized.withColumns({"x1": clamp(F.col("x1"), 0, w - 1), "y1": clamp(F.col("y1"), 0, h - 1), "x2": clamp(F.col("x2"), 1, w), "y2": clamp(F.col("y2"), 1, h)})
    cut = cut.where(valid(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])).withColumns(to_centre(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], w, h))
    keyed = cut.select("row", "cx", "cy", F.col("w"), F.col("h"), F.concat("split", F.lit("/"), "page_id").alias("place"))
    lines = label_lines(keyed, "place")
    labels = lines.select(F.concat(F.lit("labels/"), "place", F.lit(".txt")).alias("name"), F.concat("lines", F.lit("\n")).cast("binary").alias("content"))
    kept = pages.join(cut.select("page_id").distinct(), "page_id", "left_semi")
    images = png_files(kept, F.concat(F.lit("images/"), "split", F.lit("/"), "page_id", F.lit(".png")))
    listed = "".join(f"{split}: images/{split}\n" for split in ("train", "val", "test"))
    yaml = pages.sparkSession.createDataFrame([("data.yaml", bytearray(f"path: {path}\n{listed}names:\n  0: {class_name}\n".encode()))], "name string, content binary")
    write_files(images.union(labels).union(yaml), path)


def package(sheet: DataFrame, annotator: str, path: str, image: str = "image_path", folder: str = "images", overwrite: bool = False) -> DataFrame:
    """One annotator's rows, with paths into the package's own folder; an error if there are none."""
    mine = sheet.where(F.col("annotator_id") == annotator)
    if mine.isEmpty():
        raise ValueError(f"no rows of {annotator}")
    moved = mine.withColumns({"source": F.col(image), image: rebased(F.col(image), folder)})
    csv(moved, path, moved.columns, [image], overwrite)
    return moved


def listing_package(files: DataFrame, path: str, names: list[str]) -> None:
    """A listing (image_name, image_path) in order, and the class names, for annotation tools."""
    listing = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("image_name"), F.col("path").alias("image_path"))
    csv(listing, f"{path}/manifest", ["image_name", "image_path"], ["image_name"])
    files.sparkSession.createDataFrame([("\n".join(names),)], "value string").coalesce(1).write.text(f"{path}/classes")


def masks(masked: DataFrame, rectangles: DataFrame, path: str) -> None:
    """The masked rasters, how many rectangles each has, and the rectangles as JSON."""
    json(masked.drop("data"), f"{path}/manifest")
    masked.write.mode("errorifexists").parquet(f"{path}/images")
    mine = rectangles.groupBy("image_id").agg(F.collect_list("rectangle").alias("rectangles"))
    json(mine, f"{path}/rectangles")


def json_array(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """A table of one pretty-printable JSON array, for small results."""
    rows = df.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    rows.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def metrics(named: dict[str, DataFrame], path: str, overwrite: bool = False) -> DataFrame:
    """One-row tables as (name, metric, value), written as CSV, with the time of the run."""
    def long(name: str, df: DataFrame) -> DataFrame:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns]))
        return df.select(F.lit(name).alias("name"), pairs.alias("p")).select("name", "p.*")

    table = reduce(DataFrame.union, [long(name, df) for name, df in named.items()]).withColumn("run_at", now())
    csv(table, path, table.columns, ["name", "metric"], overwrite)
    return table
