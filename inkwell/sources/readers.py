"""Sources: manifests, lexica, labels, image listings, JSON rectangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import from_centre_padded, valid
from ..functions.text import STOP_TOKENS, file_stem
from ..operators.lexicon import load_lexicon

#: What counts as an image.
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff"]
NAME_COLUMNS = ["medicine_name", "MEDICINE_NAME", "drug", "name"]


def require(df: DataFrame, columns: list[str], what: str = "table") -> DataFrame:
    """The frame, or an error that names the missing columns."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"{what} missing columns: {missing}")
    return df


def manifest(spark: SparkSession, path: str, schema: T.StructType | str | None = None, required: list[str] | None = None) -> DataFrame:
    """A header CSV as strings, or cast to ``schema`` by name; a byte-order mark is dropped."""
    df = spark.read.option("header", True).option("nullValue", "").option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.removeprefix("﻿") for c in df.columns])
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    require(df, required or (schema.fieldNames() if schema else []), "manifest")
    return df.select(*[F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})").alias(f.name) for f in schema]) if schema else df


def images(spark: SparkSession, path: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, modificationTime, length[, content], image_id): files of image suffixes in any case; bytes only if asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    kept = df.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(IMAGE_SUFFIXES))
    return (kept if content else kept.drop("content")).withColumn("image_id", file_stem(F.col("path")))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(drug, drug_idx) from a CSV's first known name column, or a line each."""
    if path.lower().endswith(".csv"):
        df = manifest(spark, path)
        column = next((c for c in NAME_COLUMNS if c in df.columns), None)
        if column is None:
            raise ValueError(f"lexicon has none of {NAME_COLUMNS}")
    else:
        df, column = spark.read.text(path), "value"
    return load_lexicon(df, column, STOP_TOKENS)


def detector_labels(spark: SparkSession, path: str, target: int | None = None) -> DataFrame:
    """(image_id, row, class, cx, cy, w, h) from label files; lines of fewer than five fields are skipped."""
    lines = spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("image_id"), F.posexplode(F.split("value", "\n")).alias("row", "line"))
    f = F.split(F.trim("line"), r"\s+")
    number = lambda k: F.get(f, k).try_cast("double")
    out = lines.where(F.size(f) >= 5).select(
        "image_id", "row", number(0).cast("int").alias("class"), number(1).alias("cx"), number(2).alias("cy"), number(3).alias("w"), number(4).alias("h")
    )
    return out if target is None else out.where(F.col("class") == target)


def class_id(spark: SparkSession, path: str, target: str) -> int:
    """The number of a class by its name; an error that lists the names where it isn't one."""
    names = [r["name"] for r in class_names(spark, path).orderBy("index").collect()]
    if target not in names:
        raise ValueError(f"no class {target!r} among {names}")
    return names.index(target)


def label_boxes(labels: DataFrame, pages: DataFrame, pad: int = 8, least_area: int = 2000) -> DataFrame:
    """(image_id, row, class, x1..y2): detector labels in pixels of their pages (image_id, width, height), padded; small ones go."""
    of_page = labels.join(pages.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id")
    corners = from_centre_padded(*[F.col(c) for c in ("cx", "cy", "w", "h", "_w", "_h")], pad=pad)
    boxes = of_page.select("image_id", "row", "class", *[c.alias(k) for k, c in corners.items()])
    return boxes.where(valid(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]) & ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) >= least_area))


def labelled_images(spark: SparkSession, pages: str, labels: str) -> DataFrame:
    """(image_id, path, label_path): the images of a folder with the label file of their name, or null; their bytes aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(labels)
    of = files.select(file_stem(F.col("path")).alias("image_id"), F.col("path").alias("label_path"))
    return images(spark, pages).select("image_id", "path").join(of, "image_id", "left")


def class_names(spark: SparkSession, path: str) -> DataFrame:
    """(index, name) of the non-blank lines, in order."""
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("index", "name"))


def rectangles(spark: SparkSession, path: str) -> DataFrame:
    """(source_image, rectangle) from a JSON map of image names to corner lists; corners are put in order."""
    parsed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<int>>>")).alias("source_image", "all"))
    r = F.col("r")
    ordered = F.array(F.least(r[0], r[2]), F.least(r[1], r[3]), F.greatest(r[0], r[2]), F.greatest(r[1], r[3]))
    return parsed.select("source_image", F.explode("all").alias("r")).select("source_image", ordered.alias("rectangle"))
