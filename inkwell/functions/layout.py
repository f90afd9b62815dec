"""Layout rules on arrays of boxes, as native columns: what a page's components and profiles say of its lines and words.

Each row is an image; a box is a struct (x1, y1, x2, y2), a component a struct
(x, y, w, h, area). Arrays hold what one image has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BOXES = "array<struct<x1:int,y1:int,x2:int,y2:int>>"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), 0)


def cut(c: Column) -> Column:
    """Truncated to an integer."""
    return c.cast("int")


def hundredths(n: int, c: Column) -> Column:
    """n hundredths of a whole number, truncated; 0.35 * 180 falls short of 63 in doubles."""
    return cut(n * c / F.lit(100))


def clip(c: Column, low, high) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.least(F.greatest(c, lit(low)), lit(high))


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(*[cut(v).alias(k) for k, v in {"x1": x1, "y1": y1, "x2": x2, "y2": y2}.items()])


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def in_order(boxes: Column, *keys: str) -> Column:
    """Boxes sorted by the named sides, then by the others."""
    sides = [*keys, *[k for k in ("x1", "y1", "x2", "y2") if k not in keys]]
    ranked = F.array_sort(F.transform(boxes, lambda b: F.struct(*[b[k].alias(k) for k in sides])))
    return F.transform(ranked, lambda b: box(b["x1"], b["y1"], b["x2"], b["y2"]))


def median(values: Column) -> Column:
    """Of a non-empty array of numbers."""
    middle = lambda s: (F.get(s, cut((F.size(s) - 1) / 2)) + F.get(s, cut(F.size(s) / 2))) / 2.0
    return bound(F.array_sort(values), middle)


def none() -> Column:
    return F.array().cast(BOXES)


def last(boxes: Column) -> Column:
    return F.try_element_at(boxes, F.lit(-1))


def without_last(boxes: Column) -> Column:
    return F.slice(boxes, 1, F.greatest(F.size(boxes) - 1, F.lit(0)))


def folded(boxes: Column, joins: Callable[[Column, Column], Column]) -> Column:
    """Boxes in order; each joins the last one so far, or starts another."""
    def step(done: Column, b: Column) -> Column:
        fits = (F.size(done) > 0) & F.coalesce(joins(last(done), b), F.lit(False))
        return F.when(fits, F.concat(without_last(done), F.array(union(last(done), b)))).otherwise(F.concat(done, F.array(b)))

    return F.aggregate(boxes, none(), lambda done, b: step(done, b).cast(BOXES))


def bands(boxes: Column, gap: Column) -> Column:
    """Boxes by (y1, x1); one joins the last band if they overlap vertically or their middles are near."""
    def joins(p: Column, b: Column) -> Column:
        overlap = F.least(p["y2"], b["y2"]) - F.greatest(p["y1"], b["y1"])
        apart = F.abs((p["y1"] + p["y2"]) / 2 - (b["y1"] + b["y2"]) / 2)
        return (overlap > 0) | (apart <= F.greatest(gap.cast("double"), 0.65 * (p["y2"] - p["y1"])))

    return folded(in_order(boxes, "y1", "x1"), joins)


def runs_of_words(boxes: Column, gap: Column) -> Column:
    """Boxes by (x1, y1); one joins the last word if it is within ``gap`` and close vertically."""
    def joins(p: Column, b: Column) -> Column:
        overlap = F.least(p["y2"], b["y2"]) - F.greatest(p["y1"], b["y1"])
        return (b["x1"] - p["x2"] <= gap) & (overlap > -F.greatest(F.lit(4), hundredths(35, p["y2"] - p["y1"])))

    return folded(in_order(boxes, "x1", "y1"), joins)


def first_fit(boxes: Column, tolerance: Column) -> Column:
    """Boxes by their middles, then x1; each joins the first of all bands whose middle is near, or starts another."""
    def step(done: Column, b: Column) -> Column:
        def near(band: Column) -> Column:
            reach = F.greatest(tolerance.cast("int"), hundredths(55, F.greatest(F.lit(1), band["y2"] - band["y1"])))
            return F.abs((b["y1"] + b["y2"]) / 2 - (band["y1"] + band["y2"]) / 2) <= reach

        def placed(at: Column) -> Column:
            return F.when(at == 0, F.concat(done, F.array(b))).otherwise(F.transform(done, lambda band, i: F.when(i + 1 == at, union(band, b)).otherwise(band)))

        return bound(F.coalesce(F.array_position(F.transform(done, near), True), F.lit(0)), placed)

    ranked = F.array_sort(F.transform(boxes, lambda b: F.struct(((b["y1"] + b["y2"]) / 2).alias("m"), b["x1"].alias("x"), b.alias("b"))))
    return F.aggregate(F.transform(ranked, lambda r: r["b"]), none(), lambda done, b: step(done, b).cast(BOXES))


def with_small(words: Column, small: Column, distance: Column) -> Column:
    """Small boxes, by (x1, y1), each grow the nearest word within ``distance``; the first of equal ones."""
    def step(done: Column, s: Column) -> Column:
        x, y = (s["x1"] + s["x2"]) / 2, (s["y1"] + s["y2"]) / 2
        away = lambda w: F.greatest(F.lit(0.0), w["x1"] - x, x - w["x2"]) + 0.35 * F.abs(y - (w["y1"] + w["y2"]) / 2)
        nearest = F.array_min(F.transform(done, lambda w, i: F.struct(away(w).alias("d"), i.alias("i"))))
        grow = lambda n: F.transform(done, lambda w, i: F.when((i == n["i"]) & (n["d"] <= distance), union(w, s)).otherwise(w))
        return bound(nearest, grow)

    return F.aggregate(in_order(small, "x1", "y1"), words, lambda done, s: step(done, s).cast(BOXES))


def runs(values: Column, hit: Callable[[Column], Column], least: Column) -> Column:
    """(first, end) of the maximal runs where ``hit`` holds, ``least`` long or more; one that goes to the end of the array ends at its last place."""
    n = F.size(values)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    on = lambda i: F.coalesce(hit(F.get(values, i)), F.lit(False))
    before = lambda i: F.when(i > 0, on(i - 1)).otherwise(F.lit(False))
    starts = F.filter(places, lambda i: on(i) & ~before(i))
    ends = F.filter(places, lambda i: ~on(i) & before(i))
    both = F.transform(starts, lambda s, k: F.struct(s.alias("first"), F.get(ends, k).alias("end")))
    long = F.filter(both, lambda r: F.coalesce(r["end"], n) - r["first"] >= least)
    return F.transform(long, lambda r: F.struct(r["first"].alias("first"), F.coalesce(r["end"], n - 1).alias("end")))


def joined_runs(spans: Column, gap: Column) -> Column:
    """Runs at most ``gap`` apart become one."""
    kind = "array<struct<first:int,end:int>>"

    def step(done: Column, r: Column) -> Column:
        p = F.try_element_at(done, F.lit(-1))
        near = F.coalesce(r["first"] - p["end"] <= gap, F.lit(False))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(p["first"].alias("first"), r["end"].alias("end"))))
        return F.when(near, grown).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(spans, F.array().cast(kind), lambda done, r: step(done, r).cast(kind))


def refined(boxes: Column, row_ink: Column, median_height: Column, height: Column) -> Column:
    """Line boxes by (y1, x1), each pair cut apart at the row of least ink between them; the cut of a pair is what the next one sees."""
    gap = F.greatest(F.lit(2), cut(median_height * 0.18))
    line = F.greatest(F.lit(6), cut(median_height * 0.75))

    def step(done: Column, b: Column) -> Column:
        upper = last(done)
        top, bottom = F.greatest(F.lit(0), upper["y1"] + line), F.least(height - 1, b["y2"] - line)

        def separate(v: Column) -> Column:
            above = box(upper["x1"], upper["y1"], upper["x2"], F.least(upper["y2"], F.greatest(upper["y1"] + line, v - gap)))
            below = box(b["x1"], F.greatest(b["y1"], F.least(b["y2"] - line, v + gap)), b["x2"], b["y2"])
            return F.concat(without_last(done), F.array(above), F.array(below))

        ink = F.slice(row_ink, F.greatest(top + 1, F.lit(1)), F.greatest(bottom - top + 1, F.lit(0)))
        valley = top + bound(ink, lambda a: cut(F.array_position(a, F.array_min(a)))) - 1
        search = (F.size(done) > 0) & F.coalesce(bottom > top, F.lit(False))
        return F.when(search, bound(valley, separate)).otherwise(F.concat(done, F.array(b)))

    parted = F.aggregate(in_order(boxes, "y1", "x1"), none(), lambda done, b: step(done, b).cast(BOXES))
    return in_order(F.filter(parted, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])), "y1", "x1")


def split_at_valleys(word: Column, columns: Column, median_width: Column, median_height: Column, gap: Column) -> Column:
    """Parts of a wide word at the middles of its runs of blank columns; parts under 1.5 median widths go, and less than two parts leave it whole."""
    width = word["x2"] - word["x1"]
    blank = runs(columns, lambda ink: ink <= F.greatest(F.lit(0), cut(median_height * 0.08)), F.greatest(F.lit(3), cut(median_width * 0.8)))
    inner = F.filter(blank, lambda r: (r["first"] > median_width) & (width - r["end"] > median_width))
    cuts = F.transform(inner, lambda r: cut((r["first"] + r["end"]) / 2))

    def parts(at: Column) -> Column:
        sides = F.arrays_zip(F.concat(F.array(F.lit(0)), at).alias("a"), F.concat(at, F.array(width)).alias("b"))
        wide = F.filter(sides, lambda p: p["a"].isNotNull() & (p["b"] - p["a"] >= median_width * 1.5))
        return F.transform(wide, lambda p: box(word["x1"] + p["a"], word["y1"], word["x1"] + p["b"], word["y2"]))

    whole = F.array(word).cast(BOXES)
    found = bound(cuts, lambda at: F.when(F.size(at) > 0, parts(at)).otherwise(none()))
    wide = width >= F.greatest(median_width * 7, (gap * 2).cast("double"))
    return F.when(wide, bound(found, lambda p: F.when(F.size(p) > 1, p).otherwise(whole))).otherwise(whole)
