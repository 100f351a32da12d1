"""Every relational query against DuckDB over the same files, as bags of rows."""

import math
from collections import Counter

import duckdb
import pytest

from sparkloom.plans.registry import ORACLE_SQL, QUERIES
from sparkloom.sources.tables import TABLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "is_finite"):
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == Counter(tuple(map(plain, r)) for r in want.fetchall())


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_a_sample_has_its_share(spark):
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert 0.08 < QUERIES["repeatable_sample"](spark, SF).count() / n < 0.12
