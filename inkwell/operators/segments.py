"""Pages to regions, regions to lines, lines to words.

Images are rows (id, height, width, data: eight-bit grey). Kernels turn pixels
into components and profiles; every rule after that is a native expression on
the arrays of its row (``functions.layout``), so nothing is shuffled. The numbers
in the rules and defaults below (shares of a page, of medians, least sizes, the
28th percentile) are fixed values that results depend on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import layout as L
from ..functions import raster as R
from ..functions.text import compose_id

_COMPONENT = pa.struct([(k, pa.int32()) for k in ("x", "y", "w", "h", "area")])
_DDL = "array<struct<x:int,y:int,w:int,h:int,area:int>>"
_INTS = pa.list_(pa.int32())
#: Columns of ``measured`` and ``_spread``: their Spark and Arrow types.
MEASURED = {
    "bits": ("binary", pa.binary()), "components": (_DDL, pa.list_(_COMPONENT)), "row_ink": ("array<int>", _INTS),
    "row_first": ("array<int>", _INTS), "row_last": ("array<int>", _INTS),
}
#: Pixels that one task takes, and pixels of crops that leave it together.
TASK_PIXELS, CROP_PIXELS = 4 << 20, 4 << 20
SPREAD = {"spread_ink": ("array<int>", _INTS), "blobs": (_DDL, pa.list_(_COMPONENT))}


def _array(value, kind: pa.DataType) -> pa.Array:
    """One value as an array; lists of structs may come as a matrix with a column for each field."""
    if isinstance(value, np.ndarray) and value.ndim == 2:
        fields = [pa.array(np.ascontiguousarray(value[:, k]), f.type) for k, f in enumerate(kind.value_type)]
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), pa.StructArray.from_arrays(fields, [f.name for f in kind.value_type]))
    return pa.array([value], kind)


def _appended(rows: DataFrame, fields: dict[str, tuple], make: Callable[[dict], tuple], needs: list[str]) -> DataFrame:
    """``rows`` with the columns that ``make`` gives for each row, which sees the columns that it needs."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(k, T._parse_datatype_string(ddl)) for k, (ddl, _) in fields.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # An image at a time: rasters are large.
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                made = make({c: part.column(c)[0].as_py() for c in needs})
                arrays = [_array(value, kind) for value, (_, kind) in zip(made, fields.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *fields])

    return rows.mapInArrow(run, schema)


def dealt(images: DataFrame, task_pixels: int = TASK_PIXELS) -> DataFrame:
    """``images`` (height, width, ...) in as many tasks as their pixels need, before a costly kernel; small tables keep all cores busy."""
    pixels = images.agg(F.sum(F.col("height").cast("long") * F.col("width"))).first()[0] or 0
    return images.repartition(max(images.sparkSession.sparkContext.defaultParallelism, -(-pixels // task_pixels)))


def _grey(row: dict) -> np.ndarray:
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"])


def _boxed(found: list[tuple], of: np.ndarray | None = None) -> np.ndarray:
    """Components as a matrix; with ``of``, their area is the ink of that raster in their box."""
    boxes = np.array(found, np.int64).reshape(-1, 5)
    if of is not None and len(boxes):
        sums = np.zeros((of.shape[0] + 1, of.shape[1] + 1), np.int64)
        np.cumsum(np.cumsum(of, axis=0, dtype=np.int64), axis=1, out=sums[1:, 1:])
        x1, y1, x2, y2 = boxes[:, 0], boxes[:, 1], boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
        boxes[:, 4] = sums[y2, x2] - sums[y1, x2] - sums[y2, x1] + sums[y1, x1]
    return boxes


def _unpacked(row: dict) -> np.ndarray:
    n = row["height"] * row["width"]
    return np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=n).reshape(row["height"], row["width"])


def measured(images: DataFrame) -> DataFrame:
    """``images`` without data, with the ink as bits, its components, the ink of each row and where it begins and ends."""
    def make(row: dict) -> tuple:
        ink = R.handwriting(_grey(row))
        blank = ~ink.any(axis=1)
        ends = [pa.array(at.astype(np.int32), mask=blank) for at in (ink.argmax(axis=1), row["width"] - 1 - ink[:, ::-1].argmax(axis=1))]
        return np.packbits(ink).tobytes(), _boxed(R.components(ink)), ink.sum(axis=1, dtype=np.int32), *ends

    whole = F.col("data").isNotNull() & (F.octet_length("data") == F.col("height") * F.col("width"))
    return _appended(images.where(whole), MEASURED, make, ["height", "width", "data"]).drop("data")


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` with the row sums of the ink spread by kernel_w and kernel_h, and the outer blobs with their ink by blob_w and blob_h."""
    def make(row: dict) -> tuple:
        ink = _unpacked(row)
        sums = R.spread(ink, row["kernel_w"], row["kernel_h"]).sum(axis=1, dtype=np.int32)
        return sums, _boxed(R.outermost(R.spread(ink, row["blob_w"], row["blob_h"])), ink)

    return _appended(rows, SPREAD, make, ["height", "width", "bits", "kernel_w", "kernel_h", "blob_w", "blob_h"])


def component_stats(components: Column, width: Column, height: Column, least_area: int, most_width: float, most_height: float) -> Column:
    """Medians of the components that may be letters, their number, and how many were rejected; usual sizes where there are none."""
    fits = lambda c: (c["area"] >= least_area) & (c["w"] >= 2) & (c["h"] >= 2) & (c["w"] <= width * most_width) & (c["h"] <= height * most_height)

    def stats(kept: Column) -> Column:
        of = lambda k, usual: F.when(F.size(kept) > 0, L.median(F.transform(kept, lambda c: c[k].cast("double")))).otherwise(F.lit(usual))
        return F.struct(
            of("w", 8.0).alias("width"), of("h", 12.0).alias("height"), of("area", 40.0).alias("area"),
            F.size(kept).alias("n"), (F.size(components) - F.size(kept)).alias("rejected"),
        )

    return L.bound(F.filter(components, fits), stats)


def line_stats(components: Column, width: Column, height: Column) -> Column:
    return component_stats(components, width, height, 6, 0.92, 0.35)


def word_stats(components: Column, width: Column, height: Column) -> Column:
    return component_stats(components, width, height, 5, 0.92, 0.92)


def _as_box(c: Column) -> Column:
    return L.box(c["x"], c["y"], c["x"] + c["w"], c["y"] + c["h"])


def line_components(components: Column, stats: Column, width: Column, height: Column) -> Column:
    """Boxes of the components that may belong to a line."""
    least = F.greatest(F.lit(6), L.cut(stats["area"] * 0.18))
    fits = lambda c: (c["area"] >= least) & (c["w"] >= 2) & (c["h"] >= 2) & (c["h"] <= height * 0.32) & (c["w"] <= width * 0.94)
    return F.transform(F.filter(components, fits), _as_box)


def word_components(components: Column, stats: Column, width: Column, height: Column, small: bool) -> Column:
    """Boxes of a line's main components, or of its small ones."""
    least = F.greatest(F.lit(5), L.cut(stats["area"] * 0.16))
    tiny = lambda c: (c["area"] < least) | (c["w"] < 2) | (c["h"] < 2)
    fits = lambda c: (c["w"] <= width * 0.92) & (c["h"] <= height * 0.95) & (tiny(c) if small else ~tiny(c))
    inside = lambda c: L.box(c["x"], c["y"], F.least(width - 1, c["x"] + c["w"]), F.least(height - 1, c["y"] + c["h"]))
    return L.in_order(F.transform(F.filter(components, fits), inside), "x1", "y1")


def _least_width(width: Column) -> Column:
    return F.greatest(F.lit(40), L.cut(width * 0.06))


def projection_lines(spread_ink: Column, row_first: Column, row_last: Column, width: Column, height: Column, least: Column, gap: Column) -> Column:
    """Lines where the spread ink of the rows is over its 28th percentile."""
    nonzero = F.array_sort(F.filter(spread_ink, lambda v: v > 0))

    def percentile(s: Column) -> Column:
        at = (F.size(s) - 1) * 0.28
        low, high = F.get(s, L.cut(at)), F.get(s, F.least(L.cut(at) + 1, F.size(s) - 1))
        return F.greatest(F.lit(2), L.cut(low + (high - low) * (at - F.floor(at))))

    def line(r: Column) -> Column:
        rows = lambda a: F.slice(a, r["first"] + 1, F.greatest(r["end"] - r["first"], F.lit(0)))
        x1, x2 = F.array_min(rows(row_first)), F.array_max(rows(row_last))
        return L.box(F.greatest(F.lit(0), x1 - 6), F.greatest(F.lit(0), r["first"] - 1), F.least(width - 1, x2 + 6), F.least(height - 1, r["end"] + 1))

    spans = L.bound(L.bound(nonzero, percentile), lambda t: L.runs(spread_ink, lambda v: v > t, least))
    return F.filter(F.transform(L.joined_runs(spans, gap), line), lambda b: b["x2"] - b["x1"] >= _least_width(width))


def banded_lines(components: Column, width: Column, height: Column, least: Column, gap: Column, tolerance: Column) -> Column:
    """Components in bands, each widened a little."""
    tall = F.filter(L.first_fit(components, tolerance), lambda b: (b["y2"] - b["y1"] >= least) & (b["x2"] - b["x1"] >= _least_width(width)))
    wider = lambda b: L.box(F.greatest(F.lit(0), b["x1"] - 8), F.greatest(F.lit(0), b["y1"] - 2), F.least(width - 1, b["x2"] + 8), F.least(height - 1, b["y2"] + 2))
    return L.in_order(L.bands(F.transform(tall, wider), gap), "y1", "x1")


def blob_lines(blobs: Column, width: Column, height: Column, least: Column, gap: Column) -> Column:
    """Blobs of spread ink that are shaped like lines and hold enough ink."""
    fits = lambda c: (
        (c["h"] >= least) & (c["w"] >= _least_width(width)) & (c["h"] <= height * 0.38) & (c["w"] <= width * 0.99)
        & (c["area"] >= F.greatest(F.lit(20.0), 0.0018 * c["w"] * c["h"]))
    )
    return L.in_order(L.bands(F.transform(F.filter(blobs, fits), _as_box), gap), "y1", "x1")


def chosen(candidates: dict[str, Column], height: Column) -> Column:
    """(method, boxes) of the best set: many lines, few giant ones, even heights, a usual share of the region; the first of equal ones."""
    def ranked(k: int, name: str, boxes: Column) -> Column:
        heights = F.transform(boxes, lambda b: F.greatest(F.lit(1), b["y2"] - b["y1"]).cast("double"))
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
        n = F.size(boxes)
        mean = total(heights) / n
        spread = F.sqrt(total(F.transform(heights, lambda h: (h - mean) * (h - mean))) / n)
        giant = F.size(F.filter(heights, lambda h: h > height * 0.32))
        return F.when(n > 0, F.struct(
            (n - giant * 2.0).alias("a"), (-F.round(spread, 4)).alias("b"), (-F.round(F.abs(total(heights) / F.greatest(F.lit(1), height) - 0.32), 6)).alias("c"),
            F.lit(-k).alias("d"), F.lit(name).alias("method"), boxes.alias("boxes"),
        ))

    return F.array_max(F.array(*[ranked(k, name, boxes) for k, (name, boxes) in enumerate(candidates.items())]))


def detect_lines(images: DataFrame, min_height: int = 14, gap: int = 5) -> DataFrame:
    """``images`` without data, with boxes (of their lines) and what is known of them: method, quality_flag, counts and medians.

    Three generators propose lines; the best set is cut apart at the valleys
    between its lines.
    """
    w, h = F.col("width"), F.col("height")
    rows = measured(images)
    rows = rows.withColumn("stats", line_stats(F.col("components"), w, h))
    mw, mh = F.col("stats.width"), F.col("stats.height")
    rows = rows.withColumns({
        "least": F.greatest(F.lit(min_height), L.cut(mh * 0.75)), "gap": F.greatest(F.lit(gap), L.cut(mh * 0.45)),
        "kernel_w": L.cut(L.clip(mw * 4.0, 18, 70)), "kernel_h": L.cut(L.clip(mh * 0.25, 2, 6)),
        "blob_w": L.cut(L.clip(mw * 5.5, 24, F.greatest(F.lit(28.0), F.floor(w / 9).cast("double")))), "blob_h": L.cut(L.clip(mh * 0.35, 2, 8)),
    })
    least, near = F.col("least"), F.col("gap")
    rows = _spread(rows).withColumns({
        "projection": projection_lines(F.col("spread_ink"), F.col("row_first"), F.col("row_last"), w, h, least, F.greatest(near, L.cut(mh * 0.35))),
        "banded": banded_lines(line_components(F.col("components"), F.col("stats"), w, h), w, h, least, near, F.greatest(near + 3, L.cut(mh * 1.1))),
        "connected": blob_lines(F.col("blobs"), w, h, least, near),
    })
    sets = {"projection": F.col("projection"), "components": F.col("banded"), "connected": F.col("connected")}
    rows = rows.withColumn("best", chosen(sets, h))
    rows = rows.withColumn("boxes", F.when(F.col("best").isNull(), L.none()).otherwise(L.refined(F.col("best.boxes"), F.col("row_ink"), mh, h)))
    rows = rows.withColumn("boxes", F.when(F.size("boxes") > 0, F.col("boxes")).otherwise(F.coalesce("best.boxes", L.none())))
    some = F.size("boxes") > 0
    counts = F.concat_ws(";", *[F.concat(F.lit(f"{k}:"), F.size(c).cast("string")) for k, c in sets.items()])
    return rows.select(
        *[c for c in images.columns if c != "data"], "boxes",
        F.when(some, F.concat(F.lit("hybrid_"), F.col("best.method"), F.lit("_seam_refined"))).otherwise("none").alias("method"),
        F.when(some, "ok").otherwise("no_lines_detected").alias("quality_flag"), counts.alias("candidate_counts"),
        F.col("stats.n").alias("component_count"), F.col("stats.rejected").alias("rejected_tiny_components"),
        F.bround(mw, 3).alias("median_component_width"), F.bround(mh, 3).alias("median_component_height"),
    )


def detect_words(images: DataFrame, min_width: int = 8, min_height: int = 8, gap: int = 6) -> DataFrame:
    """``images`` (of lines) without data, with boxes (of their words), quality_flag, counts, medians and gaps."""
    w, h = F.col("width"), F.col("height")
    rows = measured(images)
    rows = rows.withColumn("stats", word_stats(F.col("components"), w, h))
    mw, mh, some = F.col("stats.width"), F.col("stats.height"), F.col("stats.n") > 0
    merge = F.when(some, F.greatest(F.lit(gap), L.cut(L.clip(mw * 1.6, 5, 18)))).otherwise(F.lit(gap))
    rows = rows.withColumn("merge_gap", merge)
    between = F.greatest(F.col("merge_gap") + 2, L.cut(L.clip(mw * 2.2, 10, F.greatest(F.lit(12.0), F.floor(w / 8).cast("double")))))
    rows = rows.withColumns({
        "word_gap": F.when(some, between).otherwise(F.lit(2 * gap)), "kernel_w": F.lit(1), "kernel_h": F.lit(1),
        "blob_w": L.cut(L.clip(mw * 1.8, 7, 18)), "blob_h": L.cut(L.clip(mh * 0.16, 1, 3)),
    })
    inside = lambda c: L.box(c["x"], c["y"], F.least(w - 1, c["x"] + c["w"]), F.least(h - 1, c["y"] + c["h"]))
    blobs = F.filter(F.transform("blobs", inside), lambda b: (b["x2"] - b["x1"] >= 2) & (b["y2"] - b["y1"] >= 2))
    rows = _spread(rows).withColumns({
        "main": word_components(F.col("components"), F.col("stats"), w, h, False),
        "small": word_components(F.col("components"), F.col("stats"), w, h, True), "blob_boxes": L.in_order(blobs, "x1", "y1"),
    })
    enough = F.size("blob_boxes") >= F.greatest(F.lit(1), F.floor(F.size("main") / 3))
    words = L.runs_of_words(F.when(enough, F.col("blob_boxes")).otherwise(F.col("main")), F.col("merge_gap"))
    grown = L.bound(words, lambda x: F.when(F.size(x) > 0, L.with_small(x, F.col("small"), F.greatest(F.col("word_gap"), L.cut(mw * 3)))).otherwise(x))
    rows = rows.withColumn("words", grown)

    def columns(row: dict) -> tuple:
        ink = _unpacked(row)
        return ([ink[b["y1"] : b["y2"], b["x1"] : b["x2"]].sum(axis=0, dtype=np.int32) for b in row["words"]],)

    rows = _appended(rows, {"column_ink": ("array<array<int>>", pa.list_(_INTS))}, columns, ["height", "width", "bits", "words"])
    parts = F.flatten(F.transform("words", lambda b, k: L.split_at_valleys(b, F.get("column_ink", k), mw, mh, F.col("word_gap"))))
    rows = rows.withColumn("boxes", L.in_order(F.filter(parts, lambda b: word_fits(b, w, h, min_width, min_height)), "x1", "y1"))
    return rows.select(
        *[c for c in images.columns if c != "data"], "boxes", F.lit("hybrid_components_gap_valley").alias("method"),
        F.when(F.size("boxes") > 0, "ok").otherwise("no_words_detected").alias("quality_flag"),
        F.col("stats.n").alias("component_count"), F.col("stats.rejected").alias("rejected_tiny_components"),
        F.bround(mw, 3).alias("median_component_width"), F.bround(mh, 3).alias("median_component_height"),
        F.col("merge_gap").alias("adaptive_merge_gap"), F.col("word_gap").alias("inter_word_gap"),
    )


def word_fits(b: Column, width: Column, height: Column, min_width: int, min_height: int) -> Column:
    """Neither tiny nor the whole line."""
    bw, bh = b["x2"] - b["x1"], b["y2"] - b["y1"]
    return (bw >= min_width) & (bh >= min_height) & (bw <= width * 0.96) & (bh <= height * 0.96)


def text_areas(pages: DataFrame) -> DataFrame:
    """``pages`` with area: the box in which a page's text seems to stand."""
    kind = pa.struct([(k, pa.int32()) for k in ("x1", "y1", "x2", "y2")])

    def make(row: dict) -> tuple:
        return (dict(zip(("x1", "y1", "x2", "y2"), R.text_area(_grey(row)), strict=True)),)

    return _appended(pages, {"area": ("struct<x1:int,y1:int,x2:int,y2:int>", kind)}, make, ["height", "width", "data"])


def regions(pages: DataFrame, boxes: DataFrame | None = None, full_page: bool = False) -> DataFrame:
    """(page_id, region_id, x1_page..y2_page): the whole page, or the boxes (page_id, row, x1..y2) of a detector or of
    labels, or where a page has none its ``area``. Boxes without extent keep their number but give no region."""
    whole = F.array(L.box(F.lit(0), F.lit(0), F.col("width") - 1, F.col("height") - 1))
    if full_page or boxes is None:
        found = pages.withColumn("_boxes", whole if full_page else F.array("area"))
    else:
        side = F.struct("row", *[F.col(k).cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")])
        given = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(side)).alias("_given"))
        given = given.select("page_id", F.transform("_given", lambda b: L.box(b["x1"], b["y1"], b["x2"], b["y2"])).alias("_given"))
        found = pages.join(given, "page_id", "left").withColumn("_boxes", F.coalesce("_given", F.array("area")))
    each = found.select("page_id", F.posexplode("_boxes").alias("_k", "_b")).where("_b.x2 > _b.x1 AND _b.y2 > _b.y1")
    return each.select("page_id", compose_id(F.col("page_id"), "r", F.col("_k")).alias("region_id"), *[F.col(f"_b.{k}").alias(f"{k}_page") for k in ("x1", "y1", "x2", "y2")])


def _children(found: DataFrame, parent: str, letter: str, pad: int, least_width: int, least_height: int, frame: str) -> DataFrame:
    """A row for each padded box, numbered before small ones go; x1..y2 in the frame of the parent, and of the page."""
    w, h = F.col("width"), F.col("height")
    each = found.select("*", F.posexplode("boxes").alias("_k", "_b")).withColumns({
        f"x1_{frame}": F.greatest(F.lit(0), F.col("_b.x1") - pad), f"y1_{frame}": F.greatest(F.lit(0), F.col("_b.y1") - pad),
        f"x2_{frame}": F.least(w - 1, F.col("_b.x2") + pad), f"y2_{frame}": F.least(h - 1, F.col("_b.y2") + pad),
    })
    each = each.where((F.col(f"x2_{frame}") - F.col(f"x1_{frame}") >= least_width) & (F.col(f"y2_{frame}") - F.col(f"y1_{frame}") >= least_height))
    page = {f"{side}_page": F.col(f"{side}_{frame}") + F.col(f"{side[0]}_offset") for side in ("x1", "y1", "x2", "y2")}
    return each.withColumn(f"{ {'l': 'line', 'w': 'word'}[letter] }_id", compose_id(F.col(parent), letter, F.col("_k"))).withColumns(page).drop("_k", "_b", "boxes")


def line_rows(found: DataFrame, padding: int = 4) -> DataFrame:
    """Lines of regions (``detect_lines`` or a detector's boxes, with x_offset and y_offset of the region on its page).

    A region without lines is a line of its own.
    """
    empty = F.size("boxes") == 0
    whole = F.array(L.box(F.lit(0), F.lit(0), F.col("width") - 1, F.col("height") - 1))
    filled = found.withColumns({
        "method": F.when(empty, F.concat("method", F.lit("_full_region_fallback"))).otherwise(F.col("method")),
        "quality_flag": F.when(empty, "fallback_full_region").otherwise(F.col("quality_flag")),
        "boxes": F.when(empty, whole).otherwise(F.col("boxes")),
    })
    return _children(filled, "region_id", "l", max(0, padding), 30, 8, "region")


def word_rows(found: DataFrame, min_width: int = 8, min_height: int = 8) -> DataFrame:
    """Words of lines (``detect_words``, with x_offset and y_offset of the line on its page); a line without words gives none."""
    return _children(found, "line_id", "w", 3, min_width, min_height, "line")


def problems(rows: DataFrame) -> DataFrame:
    """Rows whose quality isn't ok."""
    return rows.where(F.col("quality_flag") != "ok")


def drawn(pages: DataFrame, paper: int = 240, ink: int = 60) -> DataFrame:
    """``pages`` (image_id, height, width, boxes) with data: the boxes in ink on paper, for tests and demonstrations."""
    def make(row: dict) -> tuple:
        page = np.full((row["height"], row["width"]), paper, np.uint8)
        for b in row["boxes"]:
            page[b["y1"] : b["y2"], b["x1"] : b["x2"]] = ink
        return (page.tobytes(),)

    return _appended(pages, {"data": ("binary", pa.binary())}, make, ["height", "width", "boxes"])


def masked(images: DataFrame, rectangles: DataFrame) -> DataFrame:
    """``images`` with the rectangles (image_id, rectangle: corners in order) blacked out, and how many there were."""
    mine = rectangles.groupBy("image_id").agg(F.collect_list("rectangle").alias("_rectangles"))
    joined = images.join(mine, "image_id", "left").withColumn("_rectangles", F.coalesce("_rectangles", F.array().cast("array<array<int>>")))

    def make(row: dict) -> tuple:
        return R.mask(_grey(row), [tuple(r) for r in row["_rectangles"]]).tobytes(), len(row["_rectangles"])

    black = _appended(joined, {"_masked": ("binary", pa.binary()), "mask_count": ("int", pa.int32())}, make, ["height", "width", "data", "_rectangles"])
    return black.withColumn("data", F.col("_masked")).drop("_masked", "_rectangles")


def crops(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row (image_id, row, height, width, data) for each box (image_id, row, x1..y2) that holds pixels; more columns of boxes stay."""
    side = F.struct(*[F.col(f"`{c}`") for c in boxes.columns if c != "image_id"])
    mine = boxes.groupBy("image_id").agg(F.collect_list(side).alias("boxes"))
    return cut(images.select("image_id", "height", "width", "data").join(mine, "image_id"))


def cut(images: DataFrame) -> DataFrame:
    """``crops`` of images that have their boxes (row, x1..y2, ...) in an array: all are cut from an image that is sent once."""
    boxes = images.schema["boxes"].dataType.elementType
    sides = ("x1", "y1", "x2", "y2")
    kept = [f for f in boxes.fields if f.name not in ("row", *sides)]
    ints, name = T.IntegerType(), images.schema["image_id"]
    schema = T.StructType([name, boxes["row"], T.StructField("height", ints), T.StructField("width", ints), T.StructField("data", T.BinaryType()), *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("height", "width", "data")}
                grey, given = _grey(row), batch.column("boxes")[k].values
                x1, y1, x2, y2 = (np.maximum(given.field(c).to_numpy(), 0) for c in sides)
                h, w = np.minimum(y2, row["height"]) - y1, np.minimum(x2, row["width"]) - x1
                some = np.flatnonzero((h > 0) & (w > 0))
                columns = [batch.column("image_id").take(pa.array(np.full(len(some), k))), given.field("row").take(pa.array(some)), *[pa.array(n[some], pa.int32()) for n in (h, w)]]
                rest = [given.field(f.name).take(pa.array(some)) for f in kept]
                # Some crops at a time: those of boxes that lie over each other hold more than the image.
                ends = np.cumsum((h * w)[some])
                start = 0
                while start < len(some):
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + CROP_PIXELS, side="right")))
                    parts = [grey[y1[i] : y2[i], x1[i] : x2[i]].tobytes() for i in some[start:stop]]
                    some_rows = [c.slice(start, stop - start) for c in (*columns, *rest)]
                    yield pa.RecordBatch.from_arrays([*some_rows[:4], pa.array(parts, pa.binary()), *some_rows[4:]], names=schema.names)
                    start = stop

    return images.select("image_id", "height", "width", "data", "boxes").mapInArrow(run, schema)


def grey_sums(images: DataFrame) -> DataFrame:
    """``images`` with grey: the sum of their pixels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(data.as_buffer(), np.uint8).sum(dtype=np.int64)) for data in batch.column("data")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*batch.schema.names, "grey"])

    return images.mapInArrow(run, T.StructType([*images.schema.fields, T.StructField("grey", T.LongType())]))
