"""Every registered record query with an SQL form gives the same rows in DuckDB."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from inkwell.plans.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def sorted_rows(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    found = duck.execute(ORACLE_SQL[name])
    columns = sorted(c[0] for c in found.description)
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == columns
    at = [[c[0] for c in found.description].index(c) for c in columns]
    assert sorted_rows(df.select(*columns).collect()) == sorted_rows([tuple(r[k] for k in at) for r in found.fetchall()])


#: Queries whose plan depends on the number of rows, over more of them.
MORE = ["annotator_shards", "lexicon_best_match", "lexicon_demo_match", "raster_nesting", "raster_tiles"]


@pytest.mark.parametrize("name", MORE)
def test_query_over_more_rows(spark, name):
    folder = SF_DIR.replace("0.001", "0.01")
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted_rows(QUERIES[name](spark, folder).select(*columns).collect()) == sorted_rows(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows_twice_alike(spark, name):
    first = QUERIES[name](spark, SF_DIR)
    rows = sorted_rows(first.collect())
    assert rows and rows == sorted_rows(QUERIES[name](spark, SF_DIR).collect())


def test_entry_has_a_stable_schema(spark):
    assert __spark_entry__.entry(spark).columns == __spark_entry__.entry(spark).columns
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
