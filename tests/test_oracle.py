"""Every query with SQL gives the rows DuckDB gives over the same tables; the others give rows."""

import decimal
import os

import duckdb
import pytest

from quire.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    order = sorted(df.columns)
    mine = sorted((tuple(value(r[c]) for c in order) for r in df.collect()), key=repr)
    found = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == order
    theirs = sorted((tuple(value(r[names.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    assert mine == theirs
    kinds = dict(zip(names, (str(x[1]) for x in found.description), strict=True))
    assert {c: KINDS.get(t, t) for c, t in df.dtypes} == kinds


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_gives_rows(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    assert registry.queries()[name](spark, SF).count() > 0
