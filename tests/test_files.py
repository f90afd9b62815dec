"""Files that other tools read, and tables that are edited while others read them."""

import json
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import png
from inkwell.sources import adapters, readers, sinks, versioned
from inkwell.sources.files import write_files


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (5, 9), (40, 33)):
        page = rng.integers(0, 256, shape).astype(np.uint8)
        assert np.array_equal(png.decoded(png.encoded(page)), page) and np.array_equal(adapters.grey(png.encoded(page)), page)
    # A file whose rows use each filter of the format in turn, filtered pixel by pixel.
    page = rng.integers(0, 256, (10, 7)).astype(int)
    raw = bytearray()
    for y in range(10):
        raw.append(y % 5)
        for x in range(7):
            left, up, corner = page[y, x - 1] if x else 0, page[y - 1, x] if y else 0, page[y - 1, x - 1] if x and y else 0
            p = left + up - corner
            nearest = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            raw.append(int(page[y, x] - [0, left, up, (left + up) // 2, nearest][y % 5]) % 256)
    content = png.encoded(page.astype(np.uint8))
    at = content.index(b"IDAT") - 4
    made = content[:at] + png._chunk(b"IDAT", zlib.compress(bytes(raw))) + content[content.index(b"IEND") - 4 :]
    assert np.array_equal(png.decoded(made), page)
    broken = bytearray(made)
    broken[at + 10] ^= 1
    assert png.decoded(b"GIF89a") is None and adapters.grey(bytes(broken)) is None


def test_files_appear_whole_or_not_at_all(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('d', id % 7, '/f', id, '.bin') AS name", "cast(concat('content ', id) as binary) AS content").repartition(6)
    write_files(rows, str(tmp_path / "a"))
    found = {str(p.relative_to(tmp_path / "a")): p.read_text() for p in (tmp_path / "a").rglob("*.bin")}
    assert found == {f"d{k % 7}/f{k}.bin": f"content {k}" for k in range(2000)}
    assert json.loads((tmp_path / "a/_SUCCESS").read_text())["files"] == 2000 and not (tmp_path / "a/_temporary").exists()
    with pytest.raises(ValueError, match="exists"):
        write_files(rows, str(tmp_path / "a"))
    for bad in ("assert_true(id <> 1999)", "if(id = 1999, raise_error('x'), 1)"):
        with pytest.raises(Exception):
            write_files(spark.range(2000).selectExpr("concat(id, '.bin') AS name", f"cast(concat('c', {bad}) as binary) AS content").repartition(6), str(tmp_path / "b"))
        assert not (tmp_path / "b").exists()
    with pytest.raises(Exception, match="inside the folder"):
        write_files(spark.createDataFrame([("../x", bytearray(b"1"))], "name string, content binary"), str(tmp_path / "c"))
    assert not (tmp_path / "c").exists() and not (tmp_path / "x").exists()


def test_parts_of_a_name_are_one_file_in_order(spark, tmp_path):
    rows = spark.range(900).selectExpr("concat('t', id % 3, '.txt') AS name", "-id AS at", "cast(concat(id, ' ') as binary) AS content").repartition(7)
    write_files(rows, str(tmp_path / "o"), order=["at"])
    for k in range(3):
        assert (tmp_path / f"o/t{k}.txt").read_text() == "".join(f"{x} " for x in range(899, -1, -1) if x % 3 == k)


def test_layout_set(spark, tmp_path):
    page = np.arange(20 * 30, dtype=np.uint8).reshape(20, 30)
    pages = spark.createDataFrame([(p, s, 20, 30, bytearray(page.tobytes())) for p, s in (("a", "train"), ("b", "val"), ("c", "test"), ("d", "train"))], "page_id string, split string, height int, width int, data binary")
    boxes = spark.createDataFrame([("a", 1, 0, 0, 15, 10), ("a", 0, 3, 5, 60, 15), ("b", 0, 40, 5, 10, 15), ("c", 0, 0, 0, 30, 20), ("x", 0, 1, 1, 2, 2)], "page_id string, row int, x1 int, y1 int, x2 int, y2 int")
    out = tmp_path / "set"
    sinks.layout_set(pages, boxes, str(out))
    assert sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.suffix in (".png", ".txt")) == ["images/test/c.png", "images/train/a.png", "labels/test/c.txt", "labels/train/a.txt"]
    assert (out / "labels/train/a.txt").read_text() == "0 0.550000 0.500000 0.900000 0.500000\n0 0.250000 0.250000 0.500000 0.500000\n"
    assert np.array_equal(png.decoded((out / "images/train/a.png").read_bytes()), page)
    assert (out / "data.yaml").read_text() == f"path: {out}\ntrain: images/train\nval: images/val\ntest: images/test\nnames:\n  0: handwritten_region\n"
    # What was written is read again: labels in pixels, and images with their label files.
    (out / "images/train/no_label.png").write_bytes(png.encoded(page))
    sizes = spark.createDataFrame([("a", 30, 20), ("c", 30, 20)], "image_id string, width int, height int")
    labels = readers.detector_labels(spark, str(out / "labels/train"), target=0)
    assert sorted(map(tuple, readers.label_boxes(labels, sizes, pad=0, least_area=1).collect())) == [("a", 0, 0, 3, 5, 30, 15), ("a", 1, 0, 0, 0, 15, 10)]
    assert readers.label_boxes(labels, sizes, pad=0, least_area=200).count() == 1
    got = {r["image_id"]: Path(r["label_path"]).name if r["label_path"] else None for r in readers.labelled_images(spark, str(out / "images"), str(out / "labels")).collect()}
    assert got == {"a": "a.txt", "c": "c.txt", "no_label": None}


def test_class_by_name(spark, tmp_path):
    (tmp_path / "classes.txt").write_text("stamp\n\nhandwritten_region\n")
    assert readers.class_id(spark, str(tmp_path / "classes.txt"), "handwritten_region") == 1
    with pytest.raises(ValueError, match="no class 'line' among"):
        readers.class_id(spark, str(tmp_path / "classes.txt"), "line")


def test_tree_of_splits_as_files(spark, tmp_path):
    rows = [("train", f"/a/{k}.PNG", 'l "x", y' if k else "plain", "my set", f"{k}.PNG", bytearray([k])) for k in range(3)] + [("val", "/b/9.jpg", "m", "other", "9.jpg", bytearray(b"y"))]
    df = spark.createDataFrame(rows, "split string, image string, label string, source_dataset string, source_image string, content binary")
    sinks.split_tree_files(sinks.split_tree(df, str(tmp_path / "table")), str(tmp_path / "tree"))
    assert (tmp_path / "tree/Training/training_words/000002_my_set.png").read_bytes() == b"\x02"
    lines = (tmp_path / "tree/Training/training_labels.csv").read_bytes().decode().split("\r\n")
    assert lines[:2] == ["IMAGE,MEDICINE_NAME,SOURCE_DATASET,SOURCE_IMAGE", "000000_my_set.png,plain,my set,0.PNG"] and len(lines) == 5
    back = {r["IMAGE"]: r["MEDICINE_NAME"] for r in readers.manifest(spark, str(tmp_path / "tree/Training/training_labels.csv")).collect()}
    assert back == {f"00000{k}_my_set.png": rows[k][2] for k in range(3)}


def test_crops_as_files(spark, tmp_path):
    page = np.arange(12, dtype=np.uint8).reshape(3, 4)
    crops = spark.createDataFrame([("p_r00_l00", 3, 4, bytearray(page.tobytes()))], "line_id string, height int, width int, data binary")
    sinks.crop_files(crops, str(tmp_path / "crops"), "line_id")
    assert np.array_equal(png.decoded((tmp_path / "crops/p_r00_l00.png").read_bytes()), page)


SHEET = "word_id string, word_text string, review_status string, updated_at string"


def test_edits_make_versions(spark, tmp_path):
    path = str(tmp_path / "sheet")
    with pytest.raises(ValueError, match="no version"):
        versioned.read(spark, path)
    versioned.create(spark.createDataFrame([(f"w{k}", "", "pending", None) for k in range(300)], SHEET), path, "word_id")
    edits = spark.createDataFrame([("w1", "old", "reviewed", 1), ("w1", "new", None, 2), ("w2", None, "reject", 1), ("w999", "added", None, 1), (None, "no key", None, 1)], "word_id string, word_text string, review_status string, n int")
    assert versioned.edit(spark, path, edits.drop("n").withColumn("n", F.lit(0)).limit(0), ["n"]) == 2
    assert versioned.edit(spark, path, edits, [F.desc("n")]) == 3
    now = {r["word_id"]: r for r in versioned.read(spark, path).collect()}
    assert len(now) == 301 and (now["w1"]["word_text"], now["w1"]["review_status"]) == ("new", "pending") and now["w2"]["review_status"] == "reject"
    assert {k for k, r in now.items() if r["updated_at"]} == {"w1", "w2", "w999"} and now["w999"]["word_text"] == "added"
    assert {r["word_text"] for r in versioned.read(spark, path, 1).collect()} == {""}
    # Only the buckets of the edited keys were written again.
    folders = [versioned._manifest(spark, path, v)["folders"] for v in (2, 3)]
    assert 1 <= sum(folders[0].get(b) != f for b, f in folders[1].items()) <= 3


def test_of_two_writers_one_loses(spark, tmp_path):
    path = str(tmp_path / "sheet")
    versioned.create(spark.createDataFrame([("a", "", "pending", None), ("b", "", "pending", None)], SHEET), path, "word_id")
    before = versioned.read(spark, path)
    one, two = (spark.createDataFrame([("a", text)], "word_id string, word_text string") for text in ("one", "two"))
    assert versioned.edit(spark, path, one, ["word_text"], base=1) == 2
    data = sorted((tmp_path / "sheet/data").iterdir())
    with pytest.raises(versioned.Conflict):
        versioned.edit(spark, path, two, ["word_text"], base=1)
    assert sorted((tmp_path / "sheet/data").iterdir()) == data
    assert {r["word_id"]: r["word_text"] for r in versioned.read(spark, path).collect()} == {"a": "one", "b": ""}
    assert {r["word_text"] for r in before.collect()} == {""}  # a reader of the old version still reads it
    assert versioned.edit(spark, path, two, ["word_text"]) == 3 and sorted(p.name for p in (tmp_path / "sheet/_versions").iterdir() if p.name[0] != ".") == ["000000001", "000000002", "000000003"]
