"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from veriscope.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(name, spark, duck):
    df = catalog.QUERIES[name](spark, SF)
    got = sorted(tuple(norm(x) for x in r) for r in df.select(sorted(df.columns)).collect())
    r = duck.execute(catalog.ORACLE[name])
    cols = [c[0] for c in r.description]
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    want = sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(name, spark):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0
