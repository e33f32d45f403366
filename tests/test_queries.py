"""Every query with SQL against DuckDB on the same tables."""

import math
import os

import pytest

from scenelake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    one = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else 0.0 if isinstance(v, float) and v == 0 else float(v) if isinstance(v, float) else v
    return sorted(repr(tuple(one(v) for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
