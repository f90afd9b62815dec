"""Registered queries of the record operators, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.recognizers import demo, empty
from ..operators import annotate as A
from ..operators import boxes as B
from ..operators import datasets as D
from ..operators import entities as E
from ..operators import metrics as M
from ..operators.lexicon import best_matches, demo_matches, load_lexicon
from ..operators.tables import once_each, written
from . import matching_sql as S
from .views import INK, LINES, SHEET, oracle, spark_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WITH = f"WITH RECURSIVE rx AS ({oracle(LINES)}), ink AS ({oracle(INK)}), sheet AS ({oracle(SHEET)})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{WITH} {sql}" if sql.lstrip().upper().startswith("SELECT") else f"{WITH}, {sql}"
        return f

    return add


def _lines(spark, sf_dir):
    return spark_view(spark, sf_dir, LINES)


def _lexicon(spark, sf_dir):
    return load_lexicon(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name")


def _sheet(spark, sf_dir):
    return spark_view(spark, sf_dir, SHEET)


def _words(lines: DataFrame) -> DataFrame:
    words = lines.select("line_id", "x1", F.posexplode(F.split("text", " ")).alias("pos", "ocr_text"))
    return words.select("line_id", F.col("pos").alias("word_idx"), T.compose_id(F.col("line_id"), "w", F.col("pos")).alias("word_id"), "ocr_text", (F.col("x1") + 24 * F.col("pos")).alias("x1_page"))


def _dealt_lines(spark, sf_dir) -> DataFrame:
    """Lines, written once and dealt by line_id: their words are made where they are put together again."""
    return written(_lines(spark, sf_dir).select("line_id", "page_id", "x1", "text"), "lines").repartition("line_id")


_sql_normal, _sql_clean, _sql_all = S.normal, S.cleaned, S.all_found


@query("SELECT page_id, region_id, line_id, text, x1, y1, x2, y2 FROM rx")
def rx_lines_scan(spark, sf_dir):
    return _lines(spark, sf_dir).select("page_id", "region_id", "line_id", "text", "x1", "y1", "x2", "y2")


@query(f"SELECT line_id, {_sql_normal('text')} AS text, upper(text) AS upper_text, lower(text) AS lower_text FROM rx")
def text_normalize(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", T.normalize_text(F.col("text")).alias("text"), F.upper("text").alias("upper_text"), F.lower("text").alias("lower_text"))


@query("""SELECT line_id, regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS id,
 coalesce(nullif(regexp_replace(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'sample') AS name FROM rx""")
def safe_ids(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", T.safe_id(F.col("text")).alias("id"), T.safe_name(F.col("text")).alias("name"))


@query(f"SELECT line_id, {_sql_all('text', T.DOSAGE, False)} AS dosage FROM rx")
def extract_dosage(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", F.array_join(T.dosages(F.col("text")), "; ").alias("dosage"))


@query(f"SELECT line_id, {_sql_all('text', T.FREQUENCY, True)} AS frequency FROM rx")
def extract_frequency(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", F.array_join(T.frequencies(F.col("text")), "; ").alias("frequency"))


@query(f"SELECT line_id, {_sql_all('text', T.ROUTE, True)} AS route FROM rx")
def extract_route(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", F.array_join(T.routes(F.col("text")), "; ").alias("route"))


@query(f"SELECT line_id, {_sql_clean('text')} AS cleaned FROM rx")
def clean_candidates(spark, sf_dir):
    return _lines(spark, sf_dir).select("line_id", T.clean_candidate(F.col("text")).alias("cleaned"))


@query(f"texts AS (SELECT DISTINCT text FROM rx),{S.CANDIDATES} SELECT line_id, array_to_string(cands, '|') AS candidates FROM rx JOIN cands ON rx.text = cands.text")
def candidate_ngrams(spark, sf_dir):
    cut = lambda texts: texts.withColumn("candidates", F.array_join(T.candidates(F.col("text")), "|"))
    return once_each(_lines(spark, sf_dir).select("line_id", "text"), "text", cut).select("line_id", "candidates")


@query("SELECT p_name AS drug, CAST(row_number() OVER (ORDER BY p_name) AS INT) - 1 AS drug_idx FROM (SELECT DISTINCT p_name FROM part) q")
def lexicon_distinct_sorted(spark, sf_dir):
    return _lexicon(spark, sf_dir)


@query(f"texts AS (SELECT DISTINCT text FROM rx),{S.BEST} SELECT text, drug, score, matched_candidate FROM best")
def lexicon_best_match(spark, sf_dir):
    return best_matches(_lines(spark, sf_dir), "text", _lexicon(spark, sf_dir))


_PARSED = f"{S.LINE_ROWS}, {S.ENTITIES}"


@query(f"""texts AS (SELECT DISTINCT lower(text) AS a FROM rx), lex AS (SELECT p_name AS drug, lower(p_name) AS b, row_number() OVER (ORDER BY p_name) AS d FROM (SELECT DISTINCT p_name FROM part) q),
 asked AS (SELECT a, b FROM (SELECT DISTINCT lower(hyp_name) AS a FROM rx) t, (SELECT DISTINCT b FROM lex) l),{S.RATIOS},
 best AS (SELECT a, drug, ratio FROM (SELECT r.a, l.drug, r.ratio, row_number() OVER (PARTITION BY r.a ORDER BY r.ratio DESC, l.d) AS n FROM ratios r JOIN lex l ON l.b = r.b) q WHERE n = 1)
 SELECT line_id, CASE WHEN ratio > 0 THEN drug ELSE '' END AS drug, round_even(ratio, 4) AS score, CASE WHEN round_even(ratio, 4) >= 0.72 THEN 'matched' ELSE 'needs_review' END AS status FROM rx JOIN best ON lower(hyp_name) = a""")
def lexicon_demo_match(spark, sf_dir):
    return demo_matches(_lines(spark, sf_dir), "hyp_name", _lexicon(spark, sf_dir)).select("line_id", "drug", "score", "status")


@query(f"{_PARSED} SELECT * FROM entities")
def entity_parse(spark, sf_dir):
    return E.parse_entities(_lines(spark, sf_dir).select("line_id", "text"), "text", _lexicon(spark, sf_dir)).select("line_id", *E.ENTITIES)


@query(f"{_PARSED} SELECT * FROM entities WHERE keep_for_output = 'yes'")
def entity_kept(spark, sf_dir):
    return E.kept(entity_parse(spark, sf_dir))


@query(f"{_PARSED} SELECT * FROM entities WHERE validation_status = 'matched'")
def entity_matched(spark, sf_dir):
    return E.with_status(entity_parse(spark, sf_dir), "matched")


@query(f"{_PARSED} SELECT * FROM entities WHERE validation_status = 'dose_only'")
def entity_dose_only(spark, sf_dir):
    return E.with_status(entity_parse(spark, sf_dir), "dose_only")


@query(f"{_PARSED} SELECT validation_status, count(*) AS n FROM entities GROUP BY 1")
def status_histogram(spark, sf_dir):
    return E.status_counts(_lines(spark, sf_dir), "text", _lexicon(spark, sf_dir))


@query(f"""{_PARSED} SELECT *, array_to_string(list_filter([medicine_name, replace(dosage, '; ', ' + '), replace(frequency, '; ', ' + '), replace(route, '; ', ' + ')], lambda x: x <> ''), ' ') AS final_corrected_text FROM entities""")
def line_rollup(spark, sf_dir):
    lines = _dealt_lines(spark, sf_dir)
    return E.roll_up(lines.select("line_id", "page_id"), _words(lines), _lexicon(spark, sf_dir)).select("line_id", *E.ENTITIES, "final_corrected_text")


@query(f"SELECT line_id, {_sql_normal('text')} AS line_ocr_text FROM rx")
def line_texts(spark, sf_dir):
    lines = _dealt_lines(spark, sf_dir)
    return E.line_texts(lines.select("line_id"), _words(lines)).select("line_id", "line_ocr_text")


@query("""SELECT line_id, CAST(pos AS INT) AS word_idx, line_id || '_w' || CASE WHEN pos < 10 THEN '0' ELSE '' END || CAST(pos AS STRING) AS word_id,
 w[pos + 1] AS ocr_text, CAST(x1 + 24 * pos AS INT) AS x1_page FROM (SELECT *, string_split(text, ' ') AS w FROM rx) s, LATERAL (SELECT unnest(range(len(s.w))) AS pos) p""")
def word_manifest_from_text(spark, sf_dir):
    return _words(_lines(spark, sf_dir))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN ref_name = hyp_name THEN 1 ELSE 0 END) AS BIGINT) AS n_same, round_even(100.0 * avg(CASE WHEN ref_name = hyp_name THEN 1.0 ELSE 0.0 END), 2) AS percent FROM rx")
def exact_match_rate(spark, sf_dir):
    return M.exact_match(_lines(spark, sf_dir), "ref_name", "hyp_name")


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN lower(ref_name) = lower(hyp_name) THEN 1 ELSE 0 END) AS BIGINT) AS n_same, round_even(100.0 * avg(CASE WHEN lower(ref_name) = lower(hyp_name) THEN 1.0 ELSE 0.0 END), 2) AS percent FROM rx")
def ci_exact_match(spark, sf_dir):
    return M.exact_match(_lines(spark, sf_dir), "ref_name", "hyp_name", fold=True)


@query("""SELECT edits, length, round_even(100.0 * edits / length, 2) AS percent FROM
 (SELECT CAST(sum(levenshtein(ref_name, hyp_name)) AS BIGINT) AS edits, CAST(sum(greatest(1, length(ref_name))) AS BIGINT) AS length FROM rx) q""")
def cer_micro(spark, sf_dir):
    return M.cer(_lines(spark, sf_dir), "ref_name", "hyp_name")


_CODED = "array_to_string(list_transform(string_split({c}, ' '), lambda x: chr(CAST(list_position(v, x) AS INT) + 32)), '')"


@query(f"""SELECT edits, length, round_even(100.0 * edits / length, 2) AS percent FROM (SELECT CAST(sum(levenshtein({_CODED.format(c='ref_name')}, {_CODED.format(c='hyp_name')})) AS BIGINT) AS edits,
 CAST(sum(len(string_split(ref_name, ' '))) AS BIGINT) AS length FROM (SELECT ref_name, hyp_name, list_distinct(list_concat(string_split(ref_name, ' '), string_split(hyp_name, ' '))) AS v FROM rx) q) q""")
def wer_micro(spark, sf_dir):
    return M.wer(_lines(spark, sf_dir), "ref_name", "hyp_name")


@query("SELECT count(DISTINCT ref_name) AS labels, count(DISTINCT hyp_name) AS spellings FROM rx")
def label_cardinality(spark, sf_dir):
    return _lines(spark, sf_dir).agg(F.countDistinct("ref_name").alias("labels"), F.countDistinct("hyp_name").alias("spellings"))


@query("SELECT page_id, median(x2 - x1) AS width, median(y2 - y1) AS height FROM rx GROUP BY page_id")
def component_medians(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("page_id").agg(F.median(F.col("x2") - F.col("x1")).alias("width"), F.median(F.col("y2") - F.col("y1")).alias("height"))


@query("SELECT region_id, greatest(2, CAST(trunc(quantile_cont(ink, 0.28)) AS INT)) AS threshold FROM ink WHERE ink > 0 GROUP BY region_id")
def ink_percentile28(spark, sf_dir):
    ink = spark_view(spark, sf_dir, INK).where("ink > 0")
    return ink.groupBy("region_id").agg(F.greatest(F.lit(2), F.percentile("ink", 0.28).cast("int")).alias("threshold"))


@query("SELECT word_id, coalesce(word_text, '') AS word_text, coalesce(nullif(review_status, ''), 'pending') AS review_status FROM sheet")
def annotation_left_merge(spark, sf_dir):
    sheet = _sheet(spark, sf_dir)
    return A.merge(sheet.select("word_id", "doc_id"), sheet.select("word_id", "word_text", "review_status"), "word_id", ["doc_id"]).select("word_id", "word_text", "review_status")


@query("SELECT word_id FROM sheet WHERE coalesce(nullif(review_status, ''), 'pending') = 'pending' AND coalesce(annotator_id, '') IN ('', 'annotator_1')")
def annotation_queue(spark, sf_dir):
    return A.queue(_sheet(spark, sf_dir), "pending", annotator="annotator_1").select("word_id")


@query("""SELECT total, done, reviewed, round_even(100.0 * done / total, 2) AS percent FROM (SELECT count(*) AS total,
 count(*) FILTER (trim(coalesce(word_text, '')) <> '') AS done, count(*) FILTER (review_status = 'reviewed') AS reviewed FROM sheet) q""")
def annotation_progress(spark, sf_dir):
    return A.progress(_sheet(spark, sf_dir))


@query("SELECT word_id, CASE WHEN doc_id % 2 = 0 THEN 'edited' ELSE word_text END AS word_text, review_status FROM sheet")
def annotation_upsert(spark, sf_dir):
    sheet = _sheet(spark, sf_dir).select("doc_id", "word_id", "word_text", "review_status")
    edits = sheet.where("doc_id % 2 = 0").select("word_id", F.lit("edited").alias("word_text"), F.lit(None).cast("string").alias("review_status"), "doc_id")
    return A.upsert(sheet, edits, "word_id", ["doc_id"]).select("word_id", "word_text", "review_status")


@query("SELECT word_id, 'annotator_' || CAST((row_number() OVER (ORDER BY doc_id) - 1) % 3 + 1 AS STRING) AS annotator_id FROM sheet")
def annotator_shards(spark, sf_dir):
    return D.shard(_sheet(spark, sf_dir).drop("annotator_id"), ["doc_id"], 3).select("word_id", "annotator_id")


@query("SELECT source_dataset, count(*) AS n FROM (SELECT 'names' AS source_dataset FROM rx UNION ALL SELECT 'sheet' FROM sheet) q GROUP BY 1")
def dataset_union(spark, sf_dir):
    names = _lines(spark, sf_dir).select(F.col("line_id").alias("image"), F.col("ref_name").alias("label"))
    sheet = _sheet(spark, sf_dir).select(F.col("word_id").alias("image"), F.col("word_text").alias("label"))
    return D.union_sources({"names": names, "sheet": sheet}).groupBy("source_dataset").agg(F.count("*").alias("n"))


_RANKED = "r AS (SELECT line_id, {label} AS lab, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || line_id), line_id) AS k, count(*) OVER (PARTITION BY {label}) AS n FROM rx)"


@query(_RANKED.format(label="ref_name") + """, c AS (SELECT *, greatest(1, CAST(round_even(n * 0.8, 0) AS INT)) AS a, CAST(round_even(n * 0.1, 0) AS INT) AS b FROM r)
 SELECT line_id, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'val' ELSE 'test' END AS split FROM c""")
def dataset_label_split_build(spark, sf_dir):
    return D.label_split(_lines(spark, sf_dir), F.col("ref_name"), "line_id").select("line_id", "split")


@query(_RANKED.format(label="lower(hyp_name)") + """, c AS (SELECT *, greatest(1, CAST(round_even(n * 0.8, 0) AS INT)) AS a0, greatest(CAST(round_even(n * 0.1, 0) AS INT), CASE WHEN n >= 3 THEN 1 ELSE 0 END) AS b FROM r),
 e AS (SELECT *, CASE WHEN a0 + b >= n AND n >= 3 THEN greatest(1, n - b - 1) ELSE a0 END AS a FROM c)
 SELECT line_id, CASE WHEN k <= a THEN 'train' WHEN k <= a + b THEN 'val' ELSE 'test' END AS split FROM e""")
def dataset_label_split_combine(spark, sf_dir):
    return D.label_split(_lines(spark, sf_dir), F.lower("hyp_name"), "line_id", D.stratified_counts).select("line_id", "split")


@query("""g AS (SELECT DISTINCT page_id FROM rx), k AS (SELECT page_id, row_number() OVER (ORDER BY md5('42:' || page_id), page_id) AS k, count(*) OVER () AS n FROM g)
 SELECT page_id, CASE WHEN k <= round_even(n * 0.15, 0) THEN 'test' WHEN k <= 2 * round_even(n * 0.15, 0) THEN 'val' ELSE 'train' END AS split FROM k""")
def group_split(spark, sf_dir):
    return D.group_split(_lines(spark, sf_dir), "page_id")


@query("""s AS (SELECT line_id AS image, ref_name, CASE WHEN x1 % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM rx)
 SELECT image, ref_name, split, false AS augmented FROM s UNION ALL
 SELECT image || '_aug0' || CAST(k AS STRING), ref_name, split, true FROM s, (SELECT unnest([0, 1, 2]) AS k) q WHERE split = 'train'""")
def augment_fanout(spark, sf_dir):
    split = F.when(F.col("x1") % 5 == 0, "test").otherwise("train")
    return D.augment(_lines(spark, sf_dir).select(F.col("line_id").alias("image"), "ref_name", split.alias("split")), 3)


@query("SELECT DISTINCT page_id FROM rx WHERE x1 % 2 = 0 INTERSECT SELECT DISTINCT page_id FROM rx WHERE x1 % 2 = 1")
def page_region_intersect(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.where("x1 % 2 = 0").select("page_id").intersect(lines.where("x1 % 2 = 1").select("page_id"))


@query("SELECT s.word_id FROM sheet s WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id)")
def missing_images_anti(spark, sf_dir):
    return _sheet(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_anti").select("word_id")


@query("SELECT s.word_id FROM sheet s WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = s.doc_id)")
def existing_images_semi(spark, sf_dir):
    return _sheet(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_semi").select("word_id")


_size = lambda: (F.lit(640), F.lit(480))
_CENTRE = "(SELECT line_id, (x1 + x2) / 2.0 / 640 AS cx, (y1 + y2) / 2.0 / 480 AS cy, (x2 - x1) / 640.0 AS w, (y2 - y1) / 480.0 AS h FROM rx) c"


def _centres(spark, sf_dir):
    box = G.to_centre(*[F.col(c) for c in G.BOX], *_size())
    return _lines(spark, sf_dir).select("line_id", *[c.alias(k) for k, c in box.items()])


@query(f"SELECT line_id, round(cx, 9) AS cx, round(cy, 9) AS cy, round(w, 9) AS w, round(h, 9) AS h FROM {_CENTRE}")
def yolo_encode(spark, sf_dir):
    return _centres(spark, sf_dir).select("line_id", *[F.round(c, 9).alias(c) for c in ("cx", "cy", "w", "h")])


_CUT = "CAST(trunc(({c} {s} {d} / 2) * {n}) AS INT)"
_EDGES = {"x1": ("cx", "-", "w", 640), "y1": ("cy", "-", "h", 480), "x2": ("cx", "+", "w", 640), "y2": ("cy", "+", "h", 480)}
_cut = lambda k: _CUT.format(c=_EDGES[k][0], s=_EDGES[k][1], d=_EDGES[k][2], n=_EDGES[k][3])


@query("SELECT line_id, " + ", ".join(f"greatest(0, least({_cut(k)}, {_EDGES[k][3] - 1})) AS {k}" for k in _EDGES) + f" FROM {_CENTRE}")
def yolo_decode_runner(spark, sf_dir):
    box = G.from_centre(*[F.col(c) for c in ("cx", "cy", "w", "h")], *_size())
    return _centres(spark, sf_dir).select("line_id", *[c.alias(k) for k, c in box.items()])


@query("SELECT * FROM (SELECT line_id, " + ", ".join(
    f"greatest({int(k[1] == '2')}, least({_cut(k)} {'-' if k[1] == '1' else '+'} 8, {_EDGES[k][3] - int(k[1] == '1')})) AS {k}" for k in _EDGES
) + f" FROM {_CENTRE}) q WHERE (x2 - x1) * (y2 - y1) >= 2000")
def yolo_decode_cropper(spark, sf_dir):
    box = G.from_centre_padded(*[F.col(c) for c in ("cx", "cy", "w", "h")], *_size())
    return _centres(spark, sf_dir).select("line_id", *[c.alias(k) for k, c in box.items()]).where("(x2 - x1) * (y2 - y1) >= 2000")


@query("SELECT line_id, greatest(0, x1 - 6) + 100 AS x1, greatest(0, y1 - 6) + 50 AS y1, least(639, x2 + 6) + 100 AS x2, least(479, y2 + 6) + 50 AS y2 FROM rx")
def box_expand_translate(spark, sf_dir):
    box = G.expand(*[F.col(c) for c in G.BOX], 6, 6, *_size())
    return _lines(spark, sf_dir).select("line_id", *[(c + (100 if k[0] == "x" else 50)).alias(k) for k, c in box.items()])


@query("SELECT line_id FROM rx WHERE x2 - x1 >= 60 AND y2 - y1 >= 14")
def box_filters(spark, sf_dir):
    return _lines(spark, sf_dir).where(G.valid(*[F.col(c) for c in G.BOX], 60, 14)).select("line_id")


_RUNS = """e AS (SELECT *, max(y) OVER (PARTITION BY region_id) AS e FROM ink), h AS (SELECT *, y - row_number() OVER (PARTITION BY region_id ORDER BY y) AS k FROM e WHERE ink > 3),
 s AS (SELECT region_id, min(y) AS f, max(y) AS l, max(e) AS e FROM h GROUP BY region_id, k HAVING max(y) - min(y) + 1 >= 2), i AS (SELECT region_id, f AS first, least(l + 1, e) AS last FROM s)"""


@query(f"{_RUNS} SELECT * FROM i")
def row_band_islands(spark, sf_dir):
    return B.islands(spark_view(spark, sf_dir, INK), "region_id", "y", F.col("ink") > 3, 2)


@query(f"""{_RUNS}, n AS (SELECT *, CASE WHEN first - max(last) OVER (PARTITION BY region_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1 THEN 0 ELSE 1 END AS new FROM i),
 g AS (SELECT *, sum(new) OVER (PARTITION BY region_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM n)
 SELECT region_id, min(first) AS first, max(last) AS last FROM g GROUP BY region_id, k""")
def gap_span_merge(spark, sf_dir):
    return B.merge_spans(row_band_islands(spark, sf_dir), "region_id", 1)


@query(f"{S.BANDS} SELECT * FROM folded")
def band_merge_fold(spark, sf_dir):
    return B.merge_bands(_lines(spark, sf_dir), "page_id", 4)


@query(f"{S.WORDS} SELECT * FROM folded")
def word_merge_fold(spark, sf_dir):
    return B.merge_words(_lines(spark, sf_dir), "page_id", 4)


@query(f"{S.ATTACHED}, ends AS (SELECT page_id, unnest(arg_max(boxes, k)) AS b FROM grown GROUP BY page_id) SELECT page_id, b.x1 AS x1, b.y1 AS y1, b.x2 AS x2, b.y2 AS y2 FROM ends")
def attach_small(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return B.attach_small(lines.where("x2 - x1 >= 60"), lines.where("x2 - x1 < 60"), "page_id", 40)


@query(f"""{S.BANDS}, sets AS (SELECT page_id, 'lines' AS method, 0 AS seq, greatest(1, y2 - y1) AS h FROM rx UNION ALL SELECT page_id, 'bands', 1, greatest(1, y2 - y1) FROM folded),
 scored AS (SELECT page_id, method, seq, count(*) AS n, count(*) FILTER (h > 0.32 * 480) AS giant, round_even(stddev_pop(h), 9) AS spread, round_even(sum(h) / 480.0 - 0.32, 9) AS away FROM sets GROUP BY 1, 2, 3)
 SELECT page_id, method, n FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n - 2 * giant DESC, spread, abs(away), seq) AS k FROM scored) q WHERE k = 1""")
def candidate_set_choice(spark, sf_dir):
    boxes = _lines(spark, sf_dir).select("page_id", "x1", "y1", "x2", "y2")
    both = boxes.withColumns({"method": F.lit("lines"), "seq": F.lit(0)}).unionByName(
        B.merge_bands(boxes, "page_id", 4).withColumns({"method": F.lit("bands"), "seq": F.lit(1)})
    )
    return B.choose_candidates(both, "page_id", F.lit(480.0))


@query("SELECT line_id FROM rx ORDER BY md5('42:' || line_id), line_id LIMIT 24")
def hash_sample(spark, sf_dir):
    return D.sample(_lines(spark, sf_dir), "line_id", 24).select("line_id")


@query("SELECT line_id, text FROM rx ORDER BY line_id LIMIT 24")
def top_n_preview(spark, sf_dir):
    return _lines(spark, sf_dir).orderBy("line_id").limit(24).select("line_id", "text")


@query("SELECT line_id, '' AS ocr_text FROM rx")
def ocr_empty(spark, sf_dir):
    return empty(_lines(spark, sf_dir), "line_id", ["line_id"]).select("line_id", "ocr_text")


@query("SELECT line_id, CASE least(row_number() OVER (ORDER BY line_id), 3) WHEN 1 THEN 'Tab Ace' WHEN 2 THEN 'od' ELSE 'last' END AS ocr_text FROM rx")
def ocr_demo_text(spark, sf_dir):
    return demo(["Tab Ace", "od", "last"])(_lines(spark, sf_dir), "line_id", ["line_id"]).select("line_id", "ocr_text")
