"""Dataset engineering: unions, splits, shards, augmentation fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.text import normalize_text
from .numbering import numbered

# The ranges of random changes, and the chance of a blur and of noise.
DRAWN = {
    "degrees": (-4.0, 4.0), "scale": (0.94, 1.08), "shift_x": (-0.06, 0.06), "shift_y": (-0.06, 0.06), "contrast": (0.82, 1.18), "brightness": (-0.18, 0.18),
}
CHANCE = 0.15


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources, tagged, with columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_dataset", F.lit(name)) for name, df in sources.items()])


def seeded(seed: int, key: Column) -> Column:
    """A shuffle order that does not depend on partitions."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def _share(n: Column, ratio: float) -> Column:
    return F.bround(n * F.lit(ratio)).cast("int")


def split_counts(n: Column, train: float = 0.8, val: float = 0.1) -> tuple[Column, Column]:
    """Train and validation counts of a label with n rows; three rows and more have a test row, five a validation row."""
    a, b = F.greatest(F.lit(1), _share(n, train)), _share(n, val)
    b = F.when(a + b > n, F.greatest(F.lit(0), n - a)).otherwise(b)
    no_test = (n - a - b <= 0) & (n >= 3)
    a1 = F.when(no_test & (a > 1), a - 1).otherwise(a)
    b1 = F.when(no_test & (a <= 1) & (b > 0), b - 1).otherwise(b)
    no_val = (b1 == 0) & (n >= 5)
    test = n - a1 - b1
    a2 = F.when(no_val & (a1 > 1), a1 - 1).otherwise(a1)
    b2 = F.when(no_val & ((a1 > 1) | (test > 1)), F.lit(1)).otherwise(b1)
    return F.when(n <= 1, n).otherwise(a2).cast("int"), F.when(n <= 1, F.lit(0)).otherwise(b2).cast("int")


def stratified_counts(n: Column, train: float = 0.8, val: float = 0.1) -> tuple[Column, Column]:
    """The other rule, for several sources: three rows and more have a validation row."""
    a, b = F.greatest(F.lit(1), _share(n, train)), _share(n, val)
    b = F.when((n >= 3) & (b == 0), F.lit(1)).otherwise(b)
    a = F.when((a + b >= n) & (n >= 3), F.greatest(F.lit(1), n - b - 1)).otherwise(a)
    b = F.when(a + b > n, n - a).otherwise(b)
    return F.when(n == 1, F.lit(1)).otherwise(a).cast("int"), F.when(n == 1, F.lit(0)).otherwise(b).cast("int")


def label_split(rows: DataFrame, label: Column, key: str, counts=split_counts, seed: int = 42, **ratios) -> DataFrame:
    """``rows`` with split: each label's rows in seeded order, cut by its counts."""
    keyed = rows.withColumns({"_label": label, "_at": seeded(seed, F.col(key))}).withColumn("_bucket", F.substring("_at", 1, 3))
    # A label may have most of the rows: they are ranked in buckets of the order, after the rows of the buckets ahead.
    ahead = Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy(F.col("_label").alias("_of"), F.col("_bucket").alias("_in")).agg(F.count("*").alias("_rows"))
    sizes = sizes.select("_of", "_in", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_rows").over(Window.partitionBy("_of")).cast("int").alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_at", key))
    ranked = keyed.withColumn("_inside", inside).join(sizes, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_bucket") == F.col("_in")))
    ranked = ranked.withColumn("_rank", F.col("_ahead") + F.col("_inside"))
    train, val = counts(F.col("_n"), **ratios)
    split = F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_label", "_at", "_bucket", "_inside", "_of", "_in", "_ahead", "_n", "_rank")


def group_split(rows: DataFrame, group: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """(group, split): whole groups, test first, in seeded order, a row each."""
    groups = rows.select(group).distinct().withColumn("_at", seeded(seed, F.col(group)))
    ranked = numbered(groups, ["_at", group], "_rank").withColumn("_rank", F.col("_rank") + 1)
    ranked = ranked.withColumn("_n", F.lit(ranked.count()))
    n = F.col("_n")
    tests = F.when((n > 2) & F.lit(test > 0), F.greatest(F.lit(1), _share(n, test))).otherwise(F.lit(0))
    vals = F.when((n - tests > 1) & F.lit(val > 0), F.greatest(F.lit(1), _share(n, val))).otherwise(F.lit(0))
    vals = F.when(tests + vals >= n, F.greatest(F.lit(0), n - tests - 1)).otherwise(vals)
    split = F.when(F.col("_rank") <= tests, "test").when(F.col("_rank") <= tests + vals, "val").otherwise("train")
    return ranked.select(group, split.alias("split"))


def shard(rows: DataFrame, order: list[str], n: int, prefix: str = "annotator") -> DataFrame:
    """Round robin in order: annotator_id of each row."""
    name = F.concat(F.lit(f"{prefix}_"), (F.pmod("_rank", F.lit(n)) + 1).cast("string"))
    return numbered(rows, order, "_rank").withColumn("annotator_id", name).drop("_rank")


def augment(rows: DataFrame, copies: int = 3, image: str = "image") -> DataFrame:
    """Training rows and ``copies`` augmented ones of each; other splits as they are."""
    extra = rows.where("split = 'train'").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    name = F.format_string("%s_aug%02d", F.col(image), F.col("_k"))
    return rows.withColumn("augmented", F.lit(False)).unionByName(extra.withColumn(image, name).drop("_k").withColumn("augmented", F.lit(True)))


def sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for every run."""
    return rows.orderBy(seeded(seed, F.col(key)), key).limit(n)


def adapted(rows: DataFrame, image: str, label: str) -> DataFrame:
    """A source's own columns as samples (image, label, source_image); rows without a label go."""
    name = normalize_text(F.col(label))
    return rows.select(F.col(image).alias("image"), name.alias("label"), F.regexp_extract(image, "([^/]*)$", 1).alias("source_image")).where(F.col("label") != "")


def rebased(path: Column, folder: str) -> Column:
    """The file under another folder."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract(path, "([^/]*)$", 1))


def numbered_in(rows: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """0, 1, ... inside each group, of which a few may hold all rows: all are numbered in one order, and each group counts from its first."""
    every = numbered(rows, [group, *order], "_number")
    first = every.groupBy(F.col(group).alias("_of")).agg(F.min("_number").alias("_first"))
    return every.join(first, F.col(group).eqNullSafe(F.col("_of"))).withColumn(out, F.col("_number") - F.col("_first")).drop("_number", "_of", "_first")


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with place: a seeded order of all of them."""
    return numbered(rows.withColumn("_at", seeded(seed, F.col(key))), ["_at", key], "place").drop("_at")


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, n): rows of each table."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()])


def latest(files: DataFrame, group: str, path: str, time: str) -> DataFrame:
    """(group, path): the latest file of each group; of equal times the last path."""
    return files.groupBy(group).agg(F.max_by(path, F.struct(time, path)).alias(path))


def augmentation_draws(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """``rows`` with the parameters of a random change, the same for every run: degrees, scale, shifts, contrast, brightness, blur and noise."""
    of = lambda name, low, high: uniform(seed, name, F.col(key), low, high)
    return rows.withColumns({**{name: of(name, *ends) for name, ends in DRAWN.items()}, "blur": of("blur", 0, 1) < CHANCE, "noise": of("noise", 0, 1) < CHANCE})
