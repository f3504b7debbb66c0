"""Every query with SQL gives the rows of its SQL, at the smallest scale."""

import duckdb
import pytest

from quillspark.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(table):
    cells = zip(*[table.column(c).to_pylist() for c in sorted(table.column_names)], strict=True)
    return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in cells)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
