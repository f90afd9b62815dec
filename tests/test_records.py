"""Record operators against plain loops, and sources and sinks against their files."""

import json
import random
import re
from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.functions import raster as R
from inkwell.functions import text as T
from inkwell.operators import annotate as A
from inkwell.operators import boxes as B
from inkwell.operators import datasets as D
from inkwell.operators import entities as E
from inkwell.operators import metrics as M
from inkwell.operators.lexicon import best_matches, demo_matches, load_lexicon
from inkwell.operators.numbering import numbered
from inkwell.operators import segments as S
from inkwell.sources import adapters, readers, sinks
from inkwell.streaming.files import follow

LINES = [
    "Tab. Acetol 500 mg BD oral", "acetoll", "Bricanyl 5 MG; 5 mg od OD", "10% 10%x 1-0-1", "", None, "  zzz  ", "drops drop po", "Inj Ace iv 2.5ml hs", "- Dolo-650 tabs",
    "patient name", "ACETOL acetol Acetol", "Cap Omez 20mg 1 - 0 - 1 PC",
]
NAMES = ["Acetol", "Dolo-650", "Omez", " Bricanyl ", "Omez", "", "Acetol Forte", "zinc"]


@pytest.fixture(scope="module")
def lexicon(spark):
    return load_lexicon(spark.createDataFrame([(n,) for n in NAMES], "name string"), "name")


def norm(text):
    return re.sub(r"\s+", " ", text or "").strip()


def clean(text):
    without = reduce(lambda rest, p: re.sub(p, "", rest, flags=re.I), (r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", T.FORMS, T.DOSAGE, T.FREQUENCY, T.ROUTE), norm(text))
    return norm(without)


def candidates(text):
    """Of all spellings the first, by the place where it comes up."""
    tokens = re.findall(r"[A-Za-z][A-Za-z0-9-]*", clean(text))
    pieces = [clean(c) for c in [clean(text)] + tokens + [" ".join(tokens[k : k + 2]) for k in range(len(tokens) - 1)]]
    fit = [c for c in pieces if len(c) > 1 and c.lower() not in T.STOP_TOKENS]
    return [c for k, c in enumerate(fit) if c.lower() not in {x.lower() for x in fit[:k]}]


def alike(a, b):
    inside = min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
    return max(inside, SequenceMatcher(None, a, b).ratio())


def best(text, known=NAMES):
    """The largest of all pairs by score, length of the name, place of the candidate and place of the name."""
    names = sorted({norm(n) for n in known} - {""})
    pairs = [(alike(c.lower(), n.lower()), len(n), -i, -j) for i, c in enumerate(candidates(text)) for j, n in enumerate(names)]
    if not pairs:
        return "", 0.0, ""
    score, _, i, j = max(pairs)
    return names[-j], round(score, 4), candidates(text)[-i]


def test_candidates_and_matches(spark, lexicon):
    df = spark.createDataFrame([(x,) for x in LINES], "text string")
    got = df.select("text", T.candidates(F.col("text")).alias("c")).collect()
    assert {r["text"]: r["c"] for r in got} == {x: candidates(x) for x in LINES}
    found = {r["text"]: (r["drug"], r["score"], r["matched_candidate"]) for r in best_matches(df.where("text is not null"), "text", lexicon).collect()}
    assert found == {x: best(x) for x in LINES if x is not None}


def test_no_lexicon_no_match(spark, lexicon):
    df = spark.createDataFrame([(x,) for x in LINES if x is not None], "text string")
    assert best_matches(df, "text", lexicon.limit(0)).where("drug <> '' OR score > 0").isEmpty()
    assert best_matches(df.limit(0), "text", lexicon).isEmpty()


def test_large_lexicon(spark):
    """Names of many lengths, letters and kinds, with near ones, parts and repeats: the joins find what comparing all pairs finds."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdeilnorstuéß", k=r.randint(1, 9)))
    names = [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(150)]
    names += [n.upper() for n in names[:10]] + [n[:-1] for n in names[10:40]] + [n + "a" for n in names[40:60]] + ["q", "zzzz", "xyxyxyxy" * 30]
    texts = [n.replace("e", "a") for n in names[::3]] + [word() + " " + word() for _ in range(60)] + ["kkkk", "jw", "w" * 40, "abc " * 60, *LINES[:5]]
    lex = load_lexicon(spark.createDataFrame([(n,) for n in names], "name string"), "name")
    found = {x["text"]: (x["drug"], x["score"], x["matched_candidate"]) for x in best_matches(spark.createDataFrame([(t,) for t in texts], "text string"), "text", lex).collect()}
    assert found == {t: best(t, names) for t in texts}


def test_demo_matches(spark, lexicon):
    df = spark.createDataFrame([(x,) for x in LINES], "text string")
    got = {r["text"]: (r["drug"], r["score"], r["status"]) for r in demo_matches(df, "text", lexicon).collect()}
    names = sorted({norm(n) for n in NAMES} - {""})
    for x in LINES:
        ratios = [SequenceMatcher(None, (x or "").lower(), n.lower()).ratio() for n in names]
        top = max(ratios)
        name = names[ratios.index(top)] if top else ""
        assert got[x] == (name, round(top, 4), "matched" if round(top, 4) >= 0.72 else "needs_review")


def test_numbers_of_rows(spark):
    r = random.Random(1)
    rows = [(r.randrange(300), f"k{k:05d}") for k in range(30_000)]
    df = spark.createDataFrame(rows, "a int, b string").repartition(7)
    got = {(x["a"], x["b"]): x["n"] for x in numbered(df, ["a", "b"], "n").collect()}
    assert got == {x: k for k, x in enumerate(sorted(rows))}
    assert numbered(df.limit(0), ["a"], "n").isEmpty()


@pytest.mark.parametrize("kind", ["long", "double", "date", "decimal(12,2)", "short", "string", "timestamp"])
def test_numbers_of_any_type(spark, kind):
    values = {"date": "date_add(date'2020-01-01', cast(id % 701 as int))", "timestamp": "timestamp_seconds(id * 7919 % 100003)"}
    df = spark.range(3000).selectExpr(f"cast({values.get(kind, '(id * 7919) % 3001')} as {kind}) AS a", "id AS b").repartition(5)
    got = numbered(df, ["a", "b"], "n").collect()
    assert [(x["a"], x["b"]) for x in sorted(got, key=lambda x: x["n"])] == sorted((x["a"], x["b"]) for x in got)
    assert sorted(x["n"] for x in got) == list(range(3000))


def test_numbers_with_nulls_in_groups(spark):
    df = spark.createDataFrame([("a", 3), ("a", None), (None, 1), (None, 0), ("b", 5), ("a", 3)], "g string, v int")
    got = sorted(((x["g"] or "", -1 if x["v"] is None else x["v"], x["n"]) for x in D.numbered_in(df, "g", ["v"], "n").collect()))
    assert got == [("", 0, 0), ("", 1, 1), ("a", -1, 0), ("a", 3, 1), ("a", 3, 2), ("b", 5, 0)]


def test_image_names_of_a_large_split_differ(spark, tmp_path):
    rows = spark.range(1_000_003).selectExpr("'train' AS split", "concat(id, '.PNG') AS image", "'x' AS label", "'web' AS source_dataset", "'s' AS source_image")
    tree = sinks.split_tree(rows, str(tmp_path / "t"))
    assert tree.select("IMAGE").distinct().count() == 1_000_003
    assert {r["IMAGE"] for r in tree.where("source in ('0.PNG', '1.PNG')").collect()} == {"000000_web.png", "000001_web.png"}


def test_entities(spark, lexicon):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(LINES)], "id long, text string")
    got = {r["id"]: r for r in E.parse_entities(df, "text", lexicon).collect()}
    assert len(got) == len(LINES)
    for k, x in enumerate(LINES):
        name, score, candidate = best(x)
        r = got[k]
        assert (r["medicine_name"], r["medicine_match_score"], r["matched_candidate"]) == (name if score >= 0.72 else "", score, candidate)
    assert got[2]["dosage"] == "5 MG; 5 mg" and got[2]["frequency"] == "OD" and got[3]["dosage"] == "10%"
    assert got[0]["validation_status"] == "matched" and got[7]["validation_status"] == "dose_only" and got[6]["keep_for_output"] == "no"


def test_lines_are_parsed_again(spark, lexicon):
    lines = spark.createDataFrame([("l1",), ("l2",)], "line_id string")
    words = spark.createDataFrame([("l1", 50, "w2", "mg"), ("l1", 9, "w0", "Omez"), ("l1", 20, "w1", "20")], "line_id string, x1_page int, word_id string, ocr_text string")
    got = {r["line_id"]: r for r in E.roll_up(lines, words, lexicon).collect()}
    assert got["l1"]["final_corrected_text"] == "Omez 20 mg" and got["l2"]["ocr_text"] == ""


@pytest.mark.parametrize(("rule", "want"), [
    (D.split_counts, {1: (1, 0, 0), 2: (2, 0, 0), 3: (2, 0, 1), 4: (3, 0, 1), 5: (3, 1, 1), 10: (8, 1, 1), 15: (12, 2, 1), 25: (20, 2, 3)}),
    (D.stratified_counts, {1: (1, 0, 0), 2: (2, 0, 0), 3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 10: (8, 1, 1), 15: (12, 2, 1), 25: (20, 2, 3)}),
])
def test_split_counts(spark, rule, want):
    n = F.col("n")
    train, val = rule(n)
    df = spark.createDataFrame([(k,) for k in want], "n int").select("n", train.alias("a"), val.alias("b"))
    assert {r["n"]: (r["a"], r["b"], r["n"] - r["a"] - r["b"]) for r in df.collect()} == want


def test_group_splits(spark):
    for n, want in {1: (1, 0, 0), 2: (1, 1, 0), 3: (1, 1, 1), 10: (6, 2, 2), 53: (37, 8, 8)}.items():
        got = [r["split"] for r in D.group_split(spark.range(n), "id").collect()]
        assert tuple(got.count(s) for s in ("train", "val", "test")) == want


def boxes(seed, n):
    r = random.Random(seed)
    return [(f"g{r.randrange(4)}", x := r.randrange(400), y := r.randrange(200), x + r.randint(2, 60), y + r.randint(2, 30)) for _ in range(n)]


def union(a, b):
    return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))


def groups(rows):
    out = {}
    for g, *b in rows:
        out.setdefault(g, []).append(tuple(b))
    return out


def bands(found, gap):
    out = []
    for b in sorted(found, key=lambda b: (b[1], b[0], b[2], b[3])):
        p = out[-1] if out else None
        if p and (min(p[3], b[3]) > max(p[1], b[1]) or abs((p[1] + p[3]) / 2 - (b[1] + b[3]) / 2) <= max(gap, 0.65 * (p[3] - p[1]))):
            out[-1] = union(p, b)
        else:
            out.append(b)
    return out


def words(found, gap):
    out = []
    for b in sorted(found):
        p = out[-1] if out else None
        if p and b[0] - p[2] <= gap and min(p[3], b[3]) - max(p[1], b[1]) > -max(4, int(0.35 * (p[3] - p[1]))):
            out[-1] = union(p, b)
        else:
            out.append(b)
    return out


def attached(big, small, distance):
    big = sorted(big)
    for s in sorted(small):
        x, y = (s[0] + s[2]) / 2, (s[1] + s[3]) / 2
        away = [max(0, w[0] - x, x - w[2]) + abs(y - (w[1] + w[3]) / 2) * 0.35 for w in big]
        k = away.index(min(away)) if away else None
        if k is not None and away[k] <= distance:
            big[k] = union(big[k], s)
    return big


def test_box_folds(spark):
    rows, few = boxes(1, 120), boxes(2, 40)
    schema = "g string, x1 int, y1 int, x2 int, y2 int"
    df, small = spark.createDataFrame(rows, schema), spark.createDataFrame(few, schema)
    flat = lambda found: sorted((g, *b) for g, bs in found.items() for b in bs)
    assert sorted(map(tuple, B.merge_bands(df, "g", 4).collect())) == flat({g: bands(b, 4) for g, b in groups(rows).items()})
    assert sorted(map(tuple, B.merge_words(df, "g", 4).collect())) == flat({g: words(b, 4) for g, b in groups(rows).items()})
    want = flat({g: attached(b, groups(few).get(g, []), 40) for g, b in groups(rows).items()})
    assert sorted(map(tuple, B.attach_small(df, small, "g", 40).collect())) == want


def test_candidate_sets(spark):
    rows = [("g", "a", 0, 0, 0, 9, 200), ("g", "b", 1, 0, 0, 9, 30), ("g", "b", 1, 0, 40, 9, 70), ("g", "c", 2, 0, 0, 9, 30), ("g", "c", 2, 0, 40, 9, 70)]
    df = spark.createDataFrame(rows, "g string, method string, seq int, x1 int, y1 int, x2 int, y2 int")
    assert B.choose_candidates(df, "g", F.lit(200.0)).first().asDict() == {"g": "g", "method": "b", "n": 2}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_error_rates(spark):
    pairs = [("a b c", "a c"), ("", "x"), (None, None), ("word", "word"), ("one two three four", "two one three five six"), ("a  a", "a a a")]
    df = spark.createDataFrame(pairs, "r string, h string")
    w, c = M.wer(df, "r", "h").first(), M.cer(df, "r", "h").first()
    assert w["edits"] == sum(edits((a or "").split(), (b or "").split()) for a, b in pairs)
    assert w["length"] == sum(max(1, len((a or "").split())) for a, _ in pairs)
    assert c["edits"] == sum(edits(a or "", b or "") for a, b in pairs)
    r = random.Random(7)
    words = [f"word{k}" for k in range(400)]
    other = [x if r.random() < 0.9 else r.choice(words) for x in words if r.random() < 0.95]
    many = [(" ".join(words), " ".join(other)), (" ".join(words[::-1]), " ".join(words[:300]))]
    assert M.wer(spark.createDataFrame(many, "r string, h string"), "r", "h").first()["edits"] == sum(edits(a.split(), b.split()) for a, b in many)


def test_annotations(spark):
    sheet = spark.createDataFrame([("w1", "x", "reviewed", ""), ("w2", " ", None, "me"), ("w3", None, "reject", "you")], "word_id string, word_text string, review_status string, annotator_id string")
    ids = lambda df: sorted(r["word_id"] for r in df.collect())
    assert ids(A.queue(sheet)) == ["w1", "w2", "w3"] and ids(A.queue(sheet, "unannotated")) == ["w2", "w3"]
    assert ids(A.queue(sheet, "pending")) == ["w2"] and ids(A.queue(sheet, annotator="me")) == ["w1", "w2"]
    assert A.progress(sheet).first().asDict() == {"total": 3, "done": 1, "reviewed": 1, "percent": 33.33}
    assert set(A.template(sheet.select("word_id"), ["notes"]).columns) == {"word_id", "notes", "confidence", "review_status", "updated_at"}


def test_components_of_a_raster(spark):
    gray = np.full((40, 60), 250, np.uint8)
    gray[3:9, 4:10] = gray[9:12, 10:14] = gray[20:25, 30:50] = 10
    df = spark.createDataFrame([("p", 40, 60, bytearray(gray.tobytes()))], "image_id string, height int, width int, data binary")
    assert [tuple(r)[2:] for r in R.component_table(df).orderBy("component").collect()] == [(4, 3, 10, 9, 48), (30, 20, 20, 5, 100)]
    assert (R.mask(gray, [(0, 0, 5, 5)])[:5, :5] == 0).all() and gray[0, 0] == 250


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿id,n,note\n1,2,\"a, b\"\n2,x,\n")
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.csv"), "id string, n int").collect()] == [("1", 2), ("2", None)]
    with pytest.raises(ValueError, match="missing columns"):
        readers.manifest(spark, str(tmp_path / "m.csv"), required=["page_id"])
    (tmp_path / "names.csv").write_text("drug\nB\nrx\n A  x\nB\n")
    assert [tuple(r) for r in readers.lexicon(spark, str(tmp_path / "names.csv")).orderBy("drug_idx").collect()] == [("A x", 0), ("B", 1)]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/p1.txt").write_text("0 0.5 0.5 0.2 0.1\nbad\n1 0.1 0.1 0.2 0.2\n")
    assert [r["image_id"] for r in readers.detector_labels(spark, str(tmp_path / "labels"), 0).collect()] == ["p1"]
    (tmp_path / "classes.txt").write_text("a\n\n b \n")
    assert [tuple(r) for r in readers.class_names(spark, str(tmp_path / "classes.txt")).collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "r.json").write_text('{"p.png": [[9, 2, 1, 8]]}')
    assert readers.rectangles(spark, str(tmp_path / "r.json")).first()["rectangle"] == [1, 2, 9, 8]
    (tmp_path / "pics/sub").mkdir(parents=True)
    for name in ("a.PNG", "sub/b.jpg", "c.txt"):
        (tmp_path / "pics" / name).write_bytes(b"x")
    assert sorted(r["image_id"] for r in readers.images(spark, str(tmp_path / "pics")).collect()) == ["a", "b"]


def test_sinks_and_incremental_runs(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "val"), (1, "a", "train")], "id int, t string, split string")
    sinks.csv(df, str(tmp_path / "c"), ["id", "t"], ["id"])
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "c")).collect()] == [("1", "a"), ("2", "b")]
    with pytest.raises(Exception, match="already exists"):
        sinks.csv(df, str(tmp_path / "c"), ["id"])
    sinks.csv(df.limit(0), str(tmp_path / "none"), ["id", "t"])
    assert readers.manifest(spark, str(tmp_path / "none")).columns == ["id", "t"]
    sinks.json(df, str(tmp_path / "j"))
    sinks.splits(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "s")).count() == 2
    lines = sinks.label_lines(spark.createDataFrame([("p", 1, 0.5, 0.5, 0.25, 0.125)], "image_id string, row int, cx double, cy double, w double, h double"))
    assert lines.first()["lines"] == "0 0.500000 0.500000 0.250000 0.125000"
    sinks.append(df, str(tmp_path / "in"))
    for _ in range(2):
        follow(spark, str(tmp_path / "in"), "id int, t string, split string", lambda x: x.where("id > 0"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        sinks.append(df, str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def pgm(array):
    return b"P5\n%d %d\n255\n" % array.shape[::-1] + array.tobytes()


def test_data_set_layouts(spark, tmp_path):
    tree, flat = tmp_path / "tree", tmp_path / "flat"
    for split, k in (("training", 2), ("testing", 1)):
        folder = tree / split.title() / f"{split}_words"
        folder.mkdir(parents=True)
        rows = [f"{j}.png, name  {j} " for j in range(k)] + ["gone.png,x", "0.png,"]
        (tree / split.title() / f"{split}_labels.csv").write_text("\n".join(["IMAGE,MEDICINE_NAME", *rows]))
        for j in range(k):
            (folder / f"{j}.png").write_bytes(b"x")
    got = sorted((r["source_dataset"], r["source_image"], r["label"]) for r in adapters.split_tree(spark, str(tree)).collect())
    assert got == [("bd_testing", "0.png", "name 0"), ("bd_training", "0.png", "name 0"), ("bd_training", "1.png", "name 1")]
    (flat / "img/img").mkdir(parents=True)
    (flat / "doctor_handwriting_labels.csv").write_text("filename,label\na.jpg,Ace\nb.txt,Bee\n")
    for name in ("a.jpg", "b.txt"):
        (flat / "img/img" / name).write_bytes(b"x")
    assert [r["label"] for r in adapters.flat(spark, str(flat), "archive_doctor_handwriting").collect()] == ["Ace"]
    assert adapters.flat(spark, str(flat), "rxhand").isEmpty() and adapters.split_tree(spark, str(tmp_path / "no")).isEmpty()
    (tmp_path / "t.txt").write_text("one\n\n  two  words\n \n")
    assert [tuple(r) for r in adapters.text_lines(spark, str(tmp_path / "t.txt")).collect()] == [(0, "one"), (1, "two words")]
    (tmp_path / "regions").mkdir()
    (tmp_path / "regions/p 1.png").write_bytes(pgm(np.arange(6, dtype=np.uint8).reshape(2, 3)))
    (tmp_path / "regions/bad.png").write_bytes(b"not an image")
    region = adapters.region_folder(spark, str(tmp_path / "regions")).collect()
    assert [(r["page_id"], r["region_id"], r["x2_page"], r["y2_page"], bytes(r["data"])) for r in region] == [("p_1", "p_1_r00", 3, 2, bytes(range(6)))]
    files = adapters.in_listing_order(readers.images(spark, str(tree)))
    assert [r["number"] for r in files.orderBy("path").collect()] == [0, 1, 2]


def test_packages(spark, tmp_path):
    rows = [("train", f"/a/{k}.PNG", f"l{k}", "my set", f"{k}.PNG", b"x") for k in range(3)] + [("val", "/b/9.jpg", "m", "other", "9.jpg", b"y")]
    df = spark.createDataFrame(rows, "split string, image string, label string, source_dataset string, source_image string, content binary")
    got = {(r["split"], r["IMAGE"]): r["source"] for r in sinks.split_tree(df, str(tmp_path / "s")).collect()}
    assert got == {("train", f"00000{k}_my_set.png"): f"/a/{k}.PNG" for k in range(3)} | {("val", "000000_other.jpg"): "/b/9.jpg"}
    assert spark.read.parquet(str(tmp_path / "s")).where("content IS NOT NULL").count() == 4
    boxes = spark.createDataFrame([("p", 1, 0.5, 0.5, 0.25, 0.125), ("p", 0, 0.1, 0.1, 0.1, 0.1), ("q", 0, 0.2, 0.2, 0.2, 0.2)], "image_id string, row int, cx double, cy double, w double, h double")
    sinks.label_files(boxes, str(tmp_path / "y"), names=["region"])
    assert (tmp_path / "y/labels/q.txt").exists() and (tmp_path / "y/classes.txt").read_text() == "region\n"
    assert (tmp_path / "y/labels/p.txt").read_text() == "0 0.100000 0.100000 0.100000 0.100000\n0 0.500000 0.500000 0.250000 0.125000\n"
    sheet = spark.createDataFrame([("a", "/x/1.png"), ("b", "/x/2.png")], "annotator_id string, image_path string")
    sinks.package(sheet, "a", str(tmp_path / "p"))
    assert [(r["image_path"], r["source"]) for r in readers.manifest(spark, str(tmp_path / "p")).collect()] == [("images/1.png", "/x/1.png")]
    with pytest.raises(ValueError, match="no rows"):
        sinks.package(sheet, "c", str(tmp_path / "none"))
    sinks.listing_package(spark.createDataFrame([("/x/2.png",), ("/x/1.png",)], "path string"), str(tmp_path / "l"), ["r", "s"])
    assert readers.manifest(spark, str(tmp_path / "l/manifest")).count() == 2 and readers.class_names(spark, str(tmp_path / "l/classes")).count() == 2
    page = np.full((4, 5), 200, np.uint8)
    pages = spark.createDataFrame([("p", 4, 5, bytearray(page.tobytes())), ("q", 4, 5, bytearray(page.tobytes()))], "image_id string, height int, width int, data binary")
    rectangles = spark.createDataFrame([("p", [1, 1, 3, 3]), ("p", [0, 0, 1, 1])], "image_id string, rectangle array<int>")
    black = S.masked(pages, rectangles)
    assert {r["image_id"]: (r["mask_count"], r["grey"]) for r in S.grey_sums(black).collect()} == {"p": (2, 15 * 200), "q": (0, 20 * 200)}
    sinks.masks(black, rectangles, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/rectangles")).count() == 1 and spark.read.parquet(str(tmp_path / "m/images")).count() == 2
    sinks.json_array(spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == [{"i": 1, "t": "a"}, {"i": 2, "t": "b"}]
    lines = spark.createDataFrame([("a b", "a c")], "r string, h string")
    table = sinks.metrics({"wer": M.wer(lines, "r", "h"), "cer": M.cer(lines, "r", "h")}, str(tmp_path / "k"))
    assert {(r["name"], r["metric"]): r["value"] for r in table.collect()}[("wer", "percent")] == 50.0
    draws = D.augmentation_draws(spark.range(500), "id").collect()
    assert all(abs(r["degrees"]) <= 4 and 0.94 <= r["scale"] < 1.08 for r in draws) and 40 < sum(r["blur"] for r in draws) < 110
    assert {r["y1"] for r in spark.createDataFrame([(10, 40), (90, 130)], "a int, b int").select(*[c.alias(k) for k, c in A.next_line(F.col("a"), F.col("b"), F.lit(150)).items()]).collect()} == {49, 110}
