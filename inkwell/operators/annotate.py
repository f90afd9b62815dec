"""Annotation sheets: templates, merges, queues, progress, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_first", rank).where("_first = 1").drop("_first")


def blank_as(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def template(manifest: DataFrame, columns: list[str]) -> DataFrame:
    """An empty sheet for the manifest's rows."""
    return manifest.withColumns({c: F.lit("") for c in columns if c not in manifest.columns}).withColumns(
        {"confidence": F.lit("medium"), "review_status": F.lit("pending"), "updated_at": now()}
    )


def merge(manifest: DataFrame, sheet: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Manifest rows (first of a key) with their annotations; missing ones are blank, without a status pending."""
    joined = first_rows(manifest, key, order).join(sheet, key, "left")
    extra = [c for c in sheet.columns if c != key and c != "review_status"]
    out = joined.withColumns({c: F.coalesce(c, F.lit("")) for c in extra if dict(sheet.dtypes)[c] == "string"})
    return out.withColumn("review_status", blank_as("review_status", "pending"))


def queue(sheet: DataFrame, mode: str = "all", text: str = "word_text", annotator: str | None = None, medicine_only: bool = False) -> DataFrame:
    """Rows to work on: all, unannotated, pending, reviewed or rejected; mine or nobody's."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    status = blank_as("review_status", "pending")
    modes = {"all": F.lit(True), "unannotated": blank, "pending": status == "pending", "reviewed": status == "reviewed", "rejected": status == "reject"}
    out = sheet.where(modes[mode])
    if annotator is not None:
        out = out.where(F.coalesce("annotator_id", F.lit("")).isin("", annotator))
    if medicine_only:
        out = out.where(F.lower("is_medicine").isin("1", "true", "yes", "y"))
    return out


def progress(sheet: DataFrame, text: str = "word_text") -> DataFrame:
    done = F.trim(F.coalesce(text, F.lit(""))) != ""
    return sheet.agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.count_if(F.col("review_status") == "reviewed").alias("reviewed")).withColumn(
        "percent", F.when(F.col("total") > 0, F.bround(100.0 * F.col("done") / F.col("total"), 2)).otherwise(0.0)
    )


def upsert(sheet: DataFrame, edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The sheet with its edits: the last edit of a key wins, columns that it leaves null stay."""
    last = first_rows(edits, key, order).select(key, *[F.col(c).alias(f"_new_{c}") for c in edits.columns if c != key])
    joined = sheet.join(last, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in joined.columns else F.col(c) for c in sheet.columns])


def reviewed(sheet: DataFrame, label: str, statuses: list[str]) -> DataFrame:
    """Rows that have a label, of these statuses where the sheet knows any."""
    named = sheet.where(F.trim(F.coalesce(label, F.lit(""))) != "")
    return named.where(F.col("review_status").isin(statuses)) if "review_status" in sheet.columns else named


def counts(sheet: DataFrame, medicine: str, text: str = "word_text") -> DataFrame:
    """Rows in all, annotated, reviewed, and reviewed with a medicine."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    done = F.col("review_status") == "reviewed"
    return sheet.agg(F.count("*").alias("total"), F.count_if(has(text)).alias("annotated"), F.count_if(done).alias("reviewed"), F.count_if(done & has(medicine)).alias("medicines"))


def next_line(y1: Column, y2: Column, height: Column) -> dict[str, Column]:
    """Where the line after this one may stand: below it, or at the bottom where there is no room."""
    tall = F.greatest(F.lit(20), y2 - y1)
    top = y2 + F.greatest(F.lit(8), (0.3 * (y2 - y1)).cast("int"))
    low = top + tall > height
    return {"y1": F.when(low, F.greatest(F.lit(0), height - tall)).otherwise(top), "y2": F.when(low, height).otherwise(top + tall)}


def now() -> Column:
    """The time as text, in whole seconds of UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
