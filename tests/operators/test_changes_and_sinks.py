"""Writes, sinks, membership of literals, and inspection sessions."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.columns import check_values
from sparkloom.operators import inspection, metrics, schema_search, sinks, writes
from sparkloom.operators.membership import unlisted_literals


def rows(spark, n=10):
    return spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("k"), F.when(F.col("id") > 0, F.lit("a")).alias("s"))


def test_delete_needs_confirmation_and_counts(spark, tmp_path):
    change = writes.Change("delete", F.col("s") == "a")
    with pytest.raises(writes.NotConfirmed):
        writes.run_write(rows(spark), change, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    assert writes.run_write(rows(spark), change, str(tmp_path / "out"), confirmed=True) == 9
    # a null condition keeps the row
    assert [r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [0]


def test_update_with_condition_runs_unconfirmed(spark, tmp_path):
    change = writes.Change("update", F.col("k") == 1, {"k": F.col("k") + 10})
    assert writes.run_write(rows(spark), change, str(tmp_path / "out")) == 3
    assert spark.read.parquet(str(tmp_path / "out")).where("k = 11").count() == 3
    assert writes.Change("update", None, {"k": F.lit(1)}).needs_confirmation
    with pytest.raises(ValueError, match="unknown change"):
        writes.marked(rows(spark), writes.Change("drop"))


def test_returning_keeps_the_true_count(spark):
    got = writes.returning(rows(spark), writes.Change("delete", F.col("id") >= 2), ["id"], ["id"], 3).orderBy("position").collect()
    assert [(r["affected_rows"], r["position"], r["id"]) for r in got] == [(8, 1, 2), (8, 2, 3), (8, 3, 4)]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, None), (3, "")], "id int, s string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("part-*.csv")
    with part.open(newline="") as f:
        assert list(csv.reader(f)) == [["id", "s"], ["1", 'say "hi", you'], ["2", ""], ["3", ""]]


def test_json_lines_are_appended_with_sorted_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "b int, a string")
    for _ in range(2):
        sinks.write_json_lines(df, str(tmp_path / "log"), append=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"a":"x","b":1}'] * 2


def test_markdown(spark):
    df = spark.createDataFrame([("a|b", None)], "x string, y int")
    assert sinks.markdown(df) == "| x | y |\n| --- | --- |\n| a\\|b | - |"
    with pytest.raises(ValueError, match="at most 3"):
        sinks.markdown(spark.range(4), 3)


def test_fixture_tolerates_missing_keys(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"name": "a", "n": 1}, {"name": "b", "other": 2}]))
    got = sinks.fixture(spark, str(tmp_path / "f.json"), "name string, n int").orderBy("name").collect()
    assert [tuple(r) for r in got] == [("a", 1), ("b", None)]


def test_file_name_without_letters(spark):
    df = spark.createDataFrame([("Top 10: Customers!",), ("  ",), (None,)], "t string").select(sinks.file_name(F.col("t")).alias("f"))
    assert [r["f"] for r in df.collect()] == ["top-10-customers.csv", "results.csv", "results.csv"]


@pytest.mark.parametrize(
    ("expression", "values"),
    [
        ("status IN ('a', 'b', 'a')", ["a", "b"]),
        ("status = ANY (ARRAY['it''s'])", ["it's"]),
        ("status = 'x <> y'", ["x <> y"]),
        ("status <> 'a'", []),
        ("NOT status IN ('a')", []),
        ("amount >= 1", []),
        ("status !~ 'a' OR status = 'b'", []),
    ],
)
def test_check_values(spark, expression, values):
    assert spark.range(1).select(check_values(F.lit(expression)).alias("v")).first()["v"] == values


def test_unlisted_literals(spark):
    rows(spark).createOrReplaceTempView("things")
    allowed = {("things", "s"): ("a", "b")}

    def found(sql):
        return unlisted_literals(spark, sql, allowed)

    assert found("SELECT * FROM things WHERE s = 'a'") == []
    assert found("SELECT * FROM things x WHERE x.s IN ('a', 'z') OR 'q' = x.s") == [("things", "s", "q"), ("things", "s", "z")]
    assert found("SELECT id FROM (SELECT id, s FROM things) d WHERE d.s <> 'no'") == [("things", "s", "no")]
    assert found("WITH c AS (SELECT * FROM things) SELECT * FROM c WHERE id IN (SELECT id FROM things WHERE s = 'y')") == [("things", "s", "y")]
    assert found("SELECT * FROM things WHERE k = 7 AND concat(s, 'z') = 'az'") == []


def test_inspection_handles():
    s = inspection.Session({"t": ("a", "b"), "u": ("a",)}, "v1")
    assert s.resolve([s.handle("t", "a"), s.handle("t", "b")], "column", "t") == [("t", "a"), ("t", "b")]
    cases = {
        "duplicate handle": ([s.handle("t")] * 2, "table", None),
        "stale handle": (["v0/table/t"], "table", None),
        "unknown handle": ([s.handle("x")], "table", None),
        "wrong kind": ([s.handle("t")], "column", None),
        "column of another table": ([s.handle("u", "a")], "column", "t"),
    }
    for reason, (handles, kind, table) in cases.items():
        with pytest.raises(inspection.Refused) as e:
            s.resolve(handles, kind, table)
        assert e.value.reason == reason


def test_inspection_budget(spark):
    s = inspection.Session({}, "v1", values_allowed=False)
    with pytest.raises(inspection.Refused, match="values not allowed"):
        s.show(rows(spark), 5, shows_values=True)
    wide = spark.range(100).select(F.repeat(F.lit("x"), 200).alias("x"))
    assert 0 < len(s.show(wide, 100)) <= 40
    for _ in range(3):
        assert len(s.show(spark.range(3), 5)) == 3
    for _ in range(2):
        with pytest.raises(inspection.Refused, match="budget exhausted"):
            s.show(spark.range(3), 5)
    assert s.exhausted


def test_alternative_groups_prefer_fewest_missing_then_best_worst_rank(spark):
    groups = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "z"), (1, "c", "w"), (2, "a", "q")], "case int, group string, item string")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "z", 5), (1, "w", 4)], "case int, item string, rank int")
    got = {r["case"]: (r["group"], r["missing"], r["worst"]) for r in metrics.best_groups(groups, ranked).collect()}
    assert got == {1: ("c", 0, 4), 2: ("a", 1, None)}


def test_collisions_of_a_missing_item_count_the_first_eight(spark):
    required = spark.createDataFrame([(1, "s.t", "t"), (2, "s.t", "t")], "case int, item string, name string")
    ranked = spark.createDataFrame([(1, "x.t", "t", 1), (1, "s.t", "t", 3), (2, "x.t", "t", 8), (2, "y.t", "t", 9), (2, "x.u", "u", 1)], "case int, item string, name string, rank int")
    assert {r["case"]: r["collisions"] for r in metrics.collisions(required, ranked).collect()} == {1: 1, 2: 1}


def test_summaries_over_nothing(spark):
    none = spark.createDataFrame([], "withheld boolean, decision_matches boolean, passed boolean")
    assert list(metrics.withheld_summary(none).first()) == [None] * 4
    arms = spark.createDataFrame([(1, "on", True), (1, "off", False), (2, "on", True)], "k int, arm string, ok boolean")
    assert metrics.paired_arms(arms, "k", "arm", "ok", "on", "off").first().asDict() == {"pairs": 1, "both": 0, "only_on": 1, "only_off": 0, "neither": 0}


def test_saved_index_is_built_once_and_again_if_unfinished(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    first = schema_search.saved_terms(spark, sf, str(tmp_path))
    n = first.count()
    (folder,) = tmp_path.iterdir()
    stamp = (folder / "_SUCCESS").stat().st_mtime_ns
    assert schema_search.saved_terms(spark, sf, str(tmp_path)).count() == n > 100
    assert (folder / "_SUCCESS").stat().st_mtime_ns == stamp
    (folder / "_SUCCESS").unlink()
    assert schema_search.saved_terms(spark, sf, str(tmp_path)).count() == n
    assert (folder / "_SUCCESS").exists()
