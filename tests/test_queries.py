"""Each query with SQL gives what DuckDB gives for that SQL."""

import duckdb
import pytest

from weftline.plans import ORACLES, QUERIES

TABLES = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    return con


def plain(value):
    return float(value) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, TABLES)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = lambda x: sorted((tuple(map(plain, r)) for r in x), key=repr)
    assert rows(got.select(*columns).collect()) == rows(want.fetchall())
