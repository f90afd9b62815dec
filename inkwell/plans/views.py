"""Views that stand in for scanned pages: the common SQL of both engines.

``{t}`` in the texts is a table: a name for the oracle, a Parquet path for Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LINES = """
SELECT page_id, page_id || '_r00' AS region_id,
       page_id || '_r00_l' || CASE WHEN line_idx < 10 THEN '0' ELSE '' END || CAST(line_idx AS STRING) AS line_id,
       line_idx, p_name AS ref_name, hyp_name,
       form || hyp_name
       || CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE ' ' || CAST(p_size * 25 AS STRING)
          || CASE l_linenumber % 4 WHEN 0 THEN ' mg' WHEN 1 THEN ' ml' WHEN 2 THEN 'mcg' ELSE '%' END END
       || CASE l_orderkey % 6 WHEN 0 THEN ' 1-0-1' WHEN 1 THEN ' BD' WHEN 2 THEN ' od' WHEN 3 THEN ' 1 - 1 - 1'
                              WHEN 4 THEN ' daily' ELSE '' END
       || CASE l_partkey % 4 WHEN 0 THEN ' oral' WHEN 1 THEN ' iv' ELSE '' END AS text,
       CAST(10 + l_suppkey % 50 AS INT) AS x1, CAST(40 * line_idx + l_partkey % 30 AS INT) AS y1,
       CAST(40 + l_suppkey % 50 + p_size * 4 AS INT) AS x2, CAST(52 + 40 * line_idx + l_partkey % 30 + l_partkey % 9 AS INT) AS y2
FROM (SELECT *, 'p' || CAST(l_orderkey AS STRING) AS page_id,
             CASE l_suppkey % 4 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, 1) || substr(p_name, 3)
                                WHEN 2 THEN upper(p_name) ELSE replace(p_name, 'e', 'a') END AS hyp_name,
             CASE l_suppkey % 5 WHEN 0 THEN 'Tab. ' WHEN 1 THEN 'Cap ' WHEN 2 THEN 'Inj ' WHEN 3 THEN '- ' ELSE 'Syp ' END AS form
      FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, p_name, p_size,
                   CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                        l_quantity, l_extendedprice, l_shipdate) AS INT) - 1 AS line_idx
            FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) base) ids
"""
INK = """
SELECT 'u' || CAST(user_id AS STRING) AS region_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) - 1 AS y, CAST(event_id % 12 AS INT) AS ink
FROM {events}
"""
SHEET = """
SELECT d.doc_id, 'd' || CAST(d.doc_id AS STRING) AS word_id,
       CASE WHEN l.doc_id IS NULL THEN NULL WHEN d.doc_id % 5 = 0 THEN '' ELSE d.lang END AS word_text,
       CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN d.source ELSE '  ' END AS medicine_name,
       CASE WHEN l.toxic = 1 THEN 'reject' WHEN l.quality = 1 THEN 'reviewed' WHEN l.doc_id IS NULL THEN NULL ELSE '' END AS review_status,
       CASE WHEN d.doc_id % 3 = 0 THEN 'annotator_1' WHEN d.doc_id % 3 = 1 THEN 'annotator_2' ELSE '' END AS annotator_id
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""
TABLES = ["lineitem", "part", "events", "documents", "labels"]


def oracle(view: str) -> str:
    return view.format(**{t: t for t in TABLES})


def spark_view(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    return spark.sql(view.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))
