"""Page kernels and page queries at sizes that earlier versions failed at."""

from __future__ import annotations

import time

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from inkwell.functions import preparation as P
from inkwell.functions import raster as R
from inkwell.operators import boxes as B
from inkwell.operators import reading
from inkwell.operators import segments as S


def least_seconds(f, tries: int = 3) -> float:
    took = []
    for _ in range(tries):
        start = time.perf_counter()
        f()
        took.append(time.perf_counter() - start)
    return min(took)


def noisy_page(h: int = 224, w: int = 400) -> np.ndarray:
    rng = np.random.default_rng(3)
    page = np.full((h, w), 240.0)
    for _ in range(60):
        y, x = rng.integers(0, h), rng.integers(0, w)
        page[y : y + 5, x : x + rng.integers(6, 66)] = 60
    return np.clip(np.rint(page + rng.normal(0, 3, page.shape)), 0, 255).astype(np.uint8)


def test_a_page_is_denoised_in_a_fraction_of_a_second():
    page = noisy_page()
    assert least_seconds(lambda: P.denoised(page, 5)) < 0.75


def test_strips_of_a_page_are_denoised_as_the_whole(monkeypatch):
    page = noisy_page(150, 90)
    want = P.denoised(page, 5)
    monkeypatch.setattr(P, "STRIP", 1000)
    assert np.array_equal(P.denoised(page, 5), want)


def test_warps_cost_less_than_a_look_for_the_border_at_each_tap():
    page = noisy_page(448, 800)
    matrix = P.turn_matrix((400, 224), 3.0)

    def masked_taps():
        x, y = np.meshgrid(np.arange(800), np.arange(448))
        out = np.zeros(page.shape)
        for dy in range(4):
            for dx in range(4):
                ay, ax = y + dy, x + dx
                inside = (ay >= 0) & (ay < 448) & (ax >= 0) & (ax < 800)
                out += np.where(inside, page[np.clip(ay, 0, 447), np.clip(ax, 0, 799)], 255)
        return out

    assert least_seconds(lambda: P.warped(page, matrix, cubic=True)) < 0.8 * least_seconds(masked_taps)


def test_a_word_of_180_rows_takes_one_63_rows_below_no_more(spark):
    """0.35 * 180 is 63 exactly: an overlap of -63 is too far, -62 is not."""
    rows = [("far", 0, 0, 50, 180), ("far", 52, 243, 90, 260), ("near", 0, 0, 50, 180), ("near", 52, 242, 90, 260)]
    got = B.merge_words(spark.createDataFrame(rows, "page_id string, x1 int, y1 int, x2 int, y2 int"), "page_id", 4).groupBy("page_id").count()
    assert {r["page_id"]: r["count"] for r in got.collect()} == {"far": 2, "near": 1}


STROKED = ["raster_components", "raster_mask", "raster_nesting", "raster_crops", "layout_files"]


@pytest.fixture(scope="module")
def many_rows(tmp_path_factory):
    """Events of three regions, one of which has 260 rows: more than stand on a page."""
    folder = tmp_path_factory.mktemp("many_rows")
    con = duckdb.connect()
    con.sql("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2020-01-01' + INTERVAL (i) SECOND AS ts, CASE WHEN i < 260 THEN 10 ELSE i % 2 END AS user_id FROM range(400) t(i)")
    con.sql(f"COPY events TO '{folder}/events.parquet'")
    for table in ("lineitem", "part", "documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", STROKED)
def test_regions_of_more_rows_than_a_page_holds_are_whole(spark, many_rows, name):
    folder, con = many_rows
    got = entry.queries()[name](spark, folder)
    want = con.sql(entry.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


def test_pixels_of_turned_pages_are_not_shuffled(spark):
    """Strokes are dealt by page before they become pixels: rows are numbered, strokes are dealt, and nothing else moves."""
    plan = entry.queries()["skew_angles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_wide_blurs_and_spreads_cost_little():
    """Against a transform of each line, whose lengths have large prime factors, and running sums of each line."""
    page = noisy_page(448, 800)
    wide = np.pad(page.astype(float), 15, mode="edge")

    def transforms():
        for axis in (0, 1):
            np.fft.irfft(np.fft.rfft(wide, 2 * 239 if axis == 0 else 2 * 419, axis=axis), axis=axis)

    assert least_seconds(lambda: R.gaussian(page, 31), 5) < least_seconds(transforms, 5)
    ink = (page < 128).astype(np.uint8)
    assert least_seconds(lambda: R.spread(ink, 41, 5), 5) < least_seconds(lambda: np.cumsum(np.cumsum(ink.astype(np.int32), axis=0), axis=1), 5)


@pytest.mark.parametrize("name", ["line_texts", "line_no_words"])
def test_words_are_not_shuffled_to_their_lines(spark, name):
    """Lines are dealt before they are cut into words, and come from one written table: nothing above the words moves them."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Window" not in plan


def test_images_are_drawn_and_sent_to_be_cut_once(spark):
    """One kernel draws, one cuts all crops of an image, one sums; pixels are neither joined nor sent for each crop."""
    plan = entry.queries()["raster_crops"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert "Join" not in plan and plan.count("MapInArrow") == 3


def test_crops_of_many_boxes_and_their_other_columns(spark, monkeypatch):
    monkeypatch.setattr(S, "CROP_PIXELS", 500)
    rng = np.random.default_rng(8)
    pages = {k: rng.integers(0, 256, (40, 70)).astype(np.uint8) for k in "abc"}
    boxes = [(k, j, *map(int, rng.integers(-20, 80, 4)), f"{k}{j}") for k in "ab" for j in range(60)] + [("d", 0, 0, 0, 9, 9, "no page"), ("a", 99, 0, 0, 70, 40, "all")]
    images = spark.createDataFrame([(k, *p.shape, bytearray(p.tobytes())) for k, p in pages.items()], "image_id string, height int, width int, data binary")
    got = S.crops(images, spark.createDataFrame(boxes, "image_id string, row int, x1 int, y1 int, x2 int, y2 int, name string"))
    assert got.columns == ["image_id", "row", "height", "width", "data", "name"]
    want = set()
    for k, j, x1, y1, x2, y2, name in boxes:
        part = R.crop(pages[k], x1, y1, x2, y2) if k in pages else np.zeros((0, 0), np.uint8)
        if part.size:
            want.add((k, j, *part.shape, part.tobytes(), name))
    assert {(r[0], r[1], r[2], r[3], bytes(r[4]), r[5]) for r in got.collect()} == want and got.count() == len(want)


def test_a_review_reads_no_words_and_looks_up_no_names(spark):
    """How segmentation went is known before words are read; texts and names are made for the tables that need them."""
    def no_reader():
        raise AssertionError("words were read")

    page = noisy_page()
    pages = spark.createDataFrame([("p1", *page.shape, bytearray(page.tobytes()))], "page_id string, height int, width int, data binary")
    run = reading.read_pages(pages, no_reader, spark.createDataFrame([], "drug string"))
    review = run.review.collect()
    assert {r["stage"] for r in review} == {"line", "word"}
    assert sum(r["detected_count"] for r in review if r["stage"] == "word") == run.words.count() > 0


def test_denoising_in_sixteen_bits_costs_less_and_is_the_same():
    """Against sums of 32 bits whose arrays are made anew for each shift."""
    page = noisy_page()
    weights = P._likeness(5, 49)
    pad, line, h = 13, page.shape[1] + 26, len(page)
    wide = np.pad(page, pad, mode="reflect").astype(np.int32).reshape(-1)
    greys, first, n, corner = wide.astype(np.float32), pad * line + pad, h * line - 2 * pad, 3 * line + 3

    def summed(values, step):
        two = values[:-step] + values[step:]
        four = two[: -2 * step] + two[2 * step :]
        length = len(values) - 6 * step
        return values[:length] + two[step : step + length] + four[3 * step : 3 * step + length]

    def wide_sums():
        total, weight = np.zeros(h * line, np.float32), np.zeros(h * line, np.float32)
        for shift in (y * line + x for y in range(11) for x in range(-10, 11) if y or x >= 0):
            low, high = first - shift - corner, first + n + corner
            apart = wide[low:high] - wide[low + shift : high + shift]
            alike = weights.take(summed(summed(apart * apart, 1), line), mode="clip")
            for at, own in ((first + shift, alike[shift:]), (first - shift, alike[:n]))[: 2 if shift else 1]:
                total[:n] += own * greys[at : at + n]
                weight[:n] += own
        total, weight = (a.reshape(h, line)[:, : page.shape[1]] for a in (total, weight))
        return np.clip(np.rint(total / weight), 0, 255).astype(np.uint8)

    assert np.array_equal(P.denoised(page, 5), wide_sums())
    assert least_seconds(lambda: P.denoised(page, 5), 5) < 0.9 * least_seconds(wide_sums, 5)


def test_blocks_of_a_page_are_denoised_and_warped_as_the_whole(monkeypatch):
    page, matrix = noisy_page(150, 90), P.turn_matrix((45, 75), 4.0)
    want = [P.denoised(page, 5), P.denoised(page, 12), P.warped(page, matrix), P.warped(page, matrix, cubic=True)]
    for name, value in (("STRIP", 40), ("COLUMNS", 37), ("WARPED", 200)):
        monkeypatch.setattr(P, name, value)
    got = [P.denoised(page, 5), P.denoised(page, 12), P.warped(page, matrix), P.warped(page, matrix, cubic=True)]
    assert all(map(np.array_equal, got, want))
