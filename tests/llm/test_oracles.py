"""Every operator with an SQL form gives the same rows in DuckDB, over whole tables."""

from pathlib import Path

import duckdb
import pytest

from inkwell.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables here")


def plain(rows):
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_operator_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.select(*columns).collect()) == plain(found.fetchall())
