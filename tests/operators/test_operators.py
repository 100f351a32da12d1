import pytest
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.operators import bounded, compare, metrics, profile
from sparkloom.operators.retrieval import join_paths
from sparkloom.sources import catalog


def frame(spark, rows, schema="a int, b double"):
    return spark.createDataFrame(rows, schema)


def test_compare_by_tolerance_matches_pairs(spark):
    """Greedy pairing would give 1.0 to the first candidate in reach."""
    a = frame(spark, [(1, 1.0), (1, 1.08)])
    b = frame(spark, [(1, 1.07), (1, 0.95)])
    assert compare.compare(a, b, tolerance=0.1) == "equivalent"
    assert compare.compare(a, b) == "rowBagMismatch"
    assert compare.compare(a, b, "ordered", 0.01) == "orderedRowMismatch"
    assert compare.compare(a, a.limit(1)) == "rowCountMismatch"
    assert compare.compare(a, a.select("a")) == "missingCandidateColumn"
    assert compare.compare(a, a.withColumn("c", F.lit(1))) == "unexpectedExtraColumns"
    assert compare.compare(a.agg(F.sum("a")), b.agg(F.sum("a")), "scalar") == "equivalent"
    assert compare.compare(a, a.select(F.array("a").alias("a"), "b")) == "comparatorUnsupportedType"


def test_digest_ignores_order_and_sees_copies(spark):
    a = frame(spark, [(1, 1.0), (2, None), (None, 3.0)])
    assert compare.digest(a).first() == compare.digest(a.orderBy(F.desc("b"))).first()
    assert compare.digest(a).first() != compare.digest(a.union(a.limit(1))).first()
    assert compare.digest(a.limit(0)).first()["n"] == 0


def test_bounded_run(spark):
    spark.range(300).createOrReplaceTempView("numbers")
    out = bounded.run(spark, "SELECT id FROM numbers ORDER BY id")
    assert (len(out.rows), out.truncated, out.columns) == (100, True, ["id"])
    assert not bounded.run(spark, "SELECT id FROM numbers LIMIT 200").truncated
    for bad in ("DROP TABLE numbers", "INSERT INTO numbers VALUES (1)", "SELECT reflect('java.lang.Math', 'abs', 1)", "SELEC 1"):
        with pytest.raises(ValueError):
            bounded.run(spark, bad)
    for text, kind in (("SELECT x FROM numbers", "missingColumn"), ("SELECT 1 FROM nowhere", "missingTable"), ("SELECT nofunc(id) FROM numbers", "missingFunction")):
        with pytest.raises(Exception) as e:
            spark.sql(text).schema  # noqa: B018
        assert bounded.diagnose(e.value) == kind


def test_csv_lines(spark):
    df = spark.createDataFrame([(1, 'say "a", b'), (None, None), (2, "x\ny")], "n int, s string")
    assert [r.line for r in bounded.csv_lines(df).collect()] == ['1,"say ""a"", b"', ",", '2,"x\ny"']


def test_profile_hides_and_counts(spark):
    df = spark.createDataFrame([("a", "x@y"), ("b", None), ("a", None)], "kind string, email string")
    assert [tuple(r) for r in profile.distinct_values(df, "kind", 1).collect()] == [("a", 2, True)]
    row = profile.sample_rows(df, ["kind", "email"]).first()
    assert row.email is None and row.email_redacted
    assert profile.column_profile(df.limit(0), "kind").first().null_fraction is None
    stats = {r.column_name: r for r in profile.column_statistics(df).collect()}
    assert stats["email"].null_fraction == pytest.approx(2 / 3) and stats["kind"].distinct_estimate == 2


def test_tokenizers_differ(spark):
    df = spark.createDataFrame([("createdAt",), ("class2b",), ("Entities",), ("boxes",)], "s string")
    rows = df.select(C.search_tokens(F.col("s")).alias("a"), C.ranker_tokens(F.col("s")).alias("b")).collect()
    assert [r.a for r in rows] == [["created", "at"], ["class", "clas", "2", "b"], ["entities", "entity"], ["boxes", "box"]]
    assert [r.b for r in rows] == [["at", "created"], ["class2b"], ["entities", "entity"], ["boxe", "boxes"]]


def test_similarity_ladder(spark):
    pairs = [("orders", "orders"), ("ord", "orders"), ("rder", "orders"), ("ordres", "orders"), ("custmer", "customer"), ("custommerr", "customers"), ("x", "y"), ("custom", "customs"), ("orders", "ord"), ("or", "orders")]
    df = spark.createDataFrame(pairs, "a string, b string").select(C.similarity(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in df.collect()] == [1.0, 0.28, 0.16, 0.0, 0.42, 0.24, 0.0, 0.28, 0.28, 0.0]


def test_metrics(spark):
    results = spark.createDataFrame([("a", 1, True, "ok"), ("a", 2, False, "bad"), ("b", 1, None, "ok")], "k string, i int, passed boolean, status string")
    rates = {r.k: (r.n, r.passes, r.rate) for r in metrics.pass_rates(results, "k").collect()}
    assert rates == {"a": (2, 1, 0.5), "b": (0, 0, 0.0)}
    assert {r.k: r.flaky for r in metrics.repeat_stability(results, ["k"], "status").collect()} == {"a": True, "b": False}
    totals = spark.createDataFrame([(9, 10, 0, 0)], "p int, n int, q int, m int")
    gate = metrics.release_gate(totals, {"x": ("p", "n", 0.9), "y": ("q", "m", 1.0)}).first()
    assert (gate.x, gate.y, gate.released) == (True, False, False)


def test_catalog(spark):
    sf = "/root/testdata/sf0.001"
    cols = catalog.columns(spark, sf, ("region", "nation"))
    print_ = catalog.fingerprint(cols).first().fingerprint
    assert print_ == catalog.fingerprint(cols.orderBy(F.desc("column_name"))).first().fingerprint
    assert print_ != catalog.fingerprint(cols.where("position > 1")).first().fingerprint
    few = cols.select("table_name").distinct()
    assert catalog.within(few, catalog.foreign_keys(spark)).count() == 1
    paths = join_paths(catalog.foreign_keys(spark), "supplier", "region").collect()
    assert [(p.hops, p.path) for p in paths][:1] == [(2, "supplier.s_nationkey=nation.n_nationkey > nation.n_regionkey=region.r_regionkey")]


@pytest.mark.parametrize(
    "sql",
    [
        "WITH t AS (SELECT 1 AS a) INSERT INTO x SELECT * FROM t", "FROM numbers INSERT INTO a SELECT id INSERT INTO b SELECT id",
        "BEGIN CREATE TABLE x (a INT); END", "REPLACE TABLE x (a INT) USING parquet", "CREATE OR REPLACE TEMP VIEW v AS SELECT 1", "CALL do_it(1)",
        "MSCK REPAIR TABLE x", "EXECUTE IMMEDIATE 'DROP TABLE x'", "SELECT TRANSFORM(id) USING 'cat' AS (a) FROM numbers", "SET x = 1", "RESET",
        "TRUNCATE TABLE x", "DELETE FROM x", "UPDATE x SET a = 1", "MERGE INTO x USING y ON x.a = y.a WHEN MATCHED THEN DELETE", "ANALYZE TABLE x COMPUTE STATISTICS",
        "REFRESH TABLE x", "ADD JAR 'x.jar'", "CACHE TABLE x", "USE other", "SHOW TABLES", "EXPLAIN SELECT 1", "SELECT 1; SELECT 2", "SELECT 1; DROP TABLE x",
        "SELECT * FROM (SELECT java_method('java.lang.Math', 'abs', -1))", "SELECT 1 WHERE EXISTS (SELECT `reflect`('java.lang.Math', 'random'))",
        "WITH c AS (SELECT try_reflect('java.lang.Math', 'random') AS a) SELECT a FROM c", "INSERT OVERWRITE DIRECTORY '/tmp/none' USING csv SELECT 1",
    ],
)
def test_what_is_no_read_is_refused(spark, sql):
    assert bounded.check(spark, sql).errors
    with pytest.raises(ValueError):
        bounded.run(spark, sql)


def test_reads_and_their_limits(spark):
    spark.range(1500).createOrReplaceTempView("many")
    for sql in (
        "SELECT 'drop table x; --' AS a", "SELECT id AS `delete` FROM many WHERE id IN (SELECT id FROM many)", "VALUES (1), (2)", "SELECT 1;",
        "SELECT count(*) FILTER (WHERE id > 1) FROM many GROUP BY id % 2 HAVING count(*) > 1", "SELECT id, sum(id) OVER w FROM many WINDOW w AS (ORDER BY id)",
        "SELECT x FROM many LATERAL VIEW explode(array(id)) t AS x", "SELECT * FROM range(3)", "TABLE many", "SELECT 1 UNION SELECT 2 EXCEPT SELECT 3",
        "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r",
    ):
        assert bounded.check(spark, sql).errors == [], sql
        assert len(bounded.run(spark, sql).rows) <= 100
    assert bounded.check(spark, "SELECT * FROM many").warnings == ["selects all columns", "no limit"]
    assert bounded.verify(spark, "SELECT id, 'a' AS b FROM many") == [("id", "bigint"), ("b", "string")]
    out = bounded.run(spark, "WITH c AS (SELECT id FROM many) SELECT * FROM c ORDER BY id LIMIT 200")
    assert (len(out.rows), out.truncated) == (200, False)
    assert bounded.run(spark, "SELECT * FROM (SELECT id FROM many LIMIT 200)").truncated
    with pytest.raises(ValueError, match="over 1000 rows"):
        bounded.run(spark, "SELECT id FROM many LIMIT 1000000000")
    with pytest.raises(TimeoutError) as e:
        bounded.run(spark, "SELECT sum(a.id * b.id) AS s FROM range(3000000) a JOIN range(3000000) b ON a.id % 7 = b.id % 5", seconds=1)
    assert bounded.diagnose(e.value) == "timedOut"
    with pytest.raises(Exception) as e:
        bounded.run(spark, "SELECT CAST('x' AS INT) AS a")
    assert bounded.diagnose(e.value) == "invalidText"


def test_nan_equals_nan_in_all_modes(spark):
    a = frame(spark, [(1, float("nan")), (2, None)])
    for mode in ("bag", "ordered"):
        assert compare.compare(a, a, mode) == compare.compare(a, a, mode, 0.1) == "equivalent"
    one = a.where("a = 1").select("b")
    assert compare.compare(one, one, "scalar") == "equivalent"
    whole, floating = frame(spark, [(1,)], "a int"), frame(spark, [(1.0,)], "a double")
    assert compare.compare(whole, floating) == compare.compare(whole, floating, "ordered") == "equivalent"
    assert compare.digest(whole).first() != compare.digest(floating).first()
    long = frame(spark, [("x" * 70_000,)], "a string")
    with pytest.raises(ValueError, match="a cell"):
        compare.compare(long, long, "ordered")


def test_sensitive_names():
    assert all(map(profile.is_sensitive, ("api_key", "auth", "user_session", "Email", "raw_user_meta_data")))
    assert not profile.is_sensitive("iban", "birth") and profile.is_sensitive("name", "auth", "text")


def test_names_and_bytes(spark):
    df = spark.createDataFrame([("abc",), ("Abc",), ("a b",), ("_a$1",), ("1a",)], "s string")
    assert [r.q for r in df.select(C.needs_quotes(F.col("s")).alias("q")).collect()] == [False, True, True, False, True]
    one = spark.createDataFrame([("a\tb\x00c" + "x" * 3000, bytearray(range(256)) + b"z")], "s string, b binary")
    row = one.select(C.sanitized(F.col("s")).alias("s"), C.capped_hex(F.col("b")).alias("b")).first()
    assert row.s.startswith("a b cx") and len(row.s) == 2048
    assert row.b == "\\x" + bytes(range(256)).hex() + "…"


def test_bind_placeholders_are_refused(spark):
    for sql in ("SELECT * FROM t WHERE a = ? LIMIT 1", "SELECT a FROM t WHERE b IN (SELECT c FROM u WHERE d > :least) LIMIT 1"):
        assert "holds a bind placeholder" in bounded.check(spark, sql).errors
    assert bounded.check(spark, "SELECT $1 FROM t LIMIT 1").errors
    assert not bounded.check(spark, "SELECT ':a ?' AS x FROM t LIMIT 1").errors
