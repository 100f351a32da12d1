"""Texts that read as statements, stored state, comparison in one snapshot, levels of a packed catalog."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.columns import direct_sql
from sparkloom.operators import compare, schema_rank, sinks
from sparkloom.sources import catalog

SF = "/root/testdata/sf0.01"

DIRECT = [
    "select 1", "  SELECT\n*", "with x as (select 1) select * from x", "insert into t values (1)", 'INSERT INTO "a""b".t (x, y) select 1', "insert into t default values",
    "delete from only s.t as x;", "delete from t -- all\n;", "delete from t /* a\nb */", "delete from t where a = 1", "delete from t x using u", "update t set a = 1", "update only t as x set a = 2",
]
QUESTIONS = [
    "", "SELECTED users last week", "-- a comment\nselect 1", "insert into the table of orders a row", "delete from orders all the old ones", "update the orders set", "update orders", "drop table x",
    "show all with a name", "withdraw money",
]


def test_direct_sql(spark):
    texts = spark.createDataFrame([(x,) for x in DIRECT + QUESTIONS], "t string")
    found = {r["t"] for r in texts.where(direct_sql(F.col("t"))).collect()}
    assert found == set(DIRECT)


def test_state_is_replaced_whole(spark, tmp_path):
    folder = str(tmp_path / "state")
    schema = "name string, schemas array<string>, note string"
    assert sinks.state(spark, folder, schema).isEmpty()
    sinks.save_state(spark.createDataFrame([("a", ["x", "y"])], "name string, schemas array<string>"), folder)
    assert [tuple(r) for r in sinks.state(spark, folder, schema).collect()] == [("a", ["x", "y"], None)]
    sinks.save_state(spark.createDataFrame([("b",)], "name string"), folder)
    assert [r["name"] for r in sinks.state(spark, folder, schema).collect()] == ["b"]
    # a version that was never finished isn't read, and isn't written over
    (tmp_path / "state" / "version-000003").mkdir()
    (tmp_path / "state" / "version-000003" / "part-0").write_text('{"name": "c"}')
    assert [r["name"] for r in sinks.state(spark, folder, schema).collect()] == ["b"]
    sinks.save_state(spark.createDataFrame([("d",)], "name string"), folder)
    assert [r["name"] for r in sinks.state(spark, folder, schema).collect()] == ["d"]


def test_both_statements_see_one_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    session = compare.snapshot(spark, {"t": path})
    before = session.sql("select count(*) as n from t").first()["n"]
    spark.range(5).write.mode("append").parquet(path)
    assert before == session.sql("select count(*) as n from t").first()["n"] == 10
    assert spark.read.parquet(path).count() == 15 and not spark.catalog.tableExists("t")
    assert compare.compare_statements(spark, {"t": path}, "select id from t", "select id from t where id >= 0") == "equivalent"


@pytest.mark.parametrize(
    "candidate, verdict",
    [
        ("select sum(o_totalprice) as v from orders", "scalarValueMismatch"),
        ("select count(*) as v from orders where o_orderstatus is not null", "equivalent"),
        ("select o_orderkey as v from orders", "scalarShapeMismatch"),
    ],
)
def test_negative_controls_are_told(spark, candidate, verdict):
    paths = {"orders": f"{SF}/orders.parquet"}
    assert compare.compare_statements(spark, paths, "select count(*) as v from orders", candidate, "scalar") == verdict


def test_only_reads_are_compared(spark):
    with pytest.raises(ValueError):
        compare.compare_statements(spark, {}, "select 1 as v", "create table x as select 1")


def test_levels():
    plain, failed = schema_rank.Request("q"), schema_rank.Request("q", forbidden=("x",))
    assert [schema_rank.level(n, plain) for n in (1199, 1200, 4999, 5000)] == ["minimal", "focused", "focused", "full"]
    assert schema_rank.level(9000, failed) == "focused"


def test_fingerprint_follows_what_is_searched(spark):
    parts = [catalog.columns(spark, SF), catalog.keys(spark), catalog.foreign_keys(spark), catalog.checks(spark), catalog.comments(spark)]
    first = catalog.retrieval_fingerprint(*parts).first()["fingerprint"]
    assert first == catalog.retrieval_fingerprint(parts[0].orderBy(F.rand(1)), *parts[1:]).first()["fingerprint"]
    for k in range(5):
        changed = [p.limit(1) if k == j else p for j, p in enumerate(parts)]
        assert catalog.retrieval_fingerprint(*changed).first()["fingerprint"] != first


def test_two_strong_tables_close_together_pin_none(spark):
    ranks = spark.createDataFrame(
        [(1, "a", 300, True, False, False, False, False), (2, "b", 250, True, False, False, False, False), (3, "c", 10, False, False, False, False, False)],
        "place int, table_name string, score long, named boolean, bound boolean, replacement boolean, referenced boolean, neighbour boolean",
    )
    ask = schema_rank.Request("q", searches=('main."C"',))
    assert [r[0] for r in schema_rank.pinned(ranks, ask, "minimal").collect()] == ["c"]
    assert [r[0] for r in schema_rank.pinned(ranks.where("place <> 2"), ask, "minimal").orderBy("table_name").collect()] == ["a", "c"]
