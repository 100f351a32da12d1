"""Projections, filters, sorting, limits, set operations and subqueries over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import cents
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


@query("recent_orders", f"SELECT o_orderkey, o_orderdate, {CENTS} AS total_cents FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", cents(F.col("o_totalprice")).alias("total_cents"))
    return orders.orderBy(F.desc_nulls_first("o_orderdate"), "o_orderkey").limit(10)


@query(
    "orders_in_window",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-03-01' + INTERVAL 30 DAY",
)
def orders_in_window(spark, sf_dir):
    date, start = F.col("o_orderdate"), F.expr("TIMESTAMP_NTZ '1996-03-01'")
    return table(spark, sf_dir, "orders").where((date >= start) & (date < start + F.expr("INTERVAL '30' DAY"))).select("o_orderkey", "o_orderdate")


@query("orders_between", "SELECT count(*) AS n FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def orders_between(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderdate BETWEEN TIMESTAMP_NTZ '1997-01-01' AND TIMESTAMP_NTZ '1997-12-31'").agg(F.count(F.lit(1)).alias("n"))


@query("parts_like", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%1%' AND p_type NOT LIKE 'A%' AND p_size IN (1, 5, 9)")
def parts_like(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_name").ilike("%1%") & ~F.col("p_type").like("A%") & F.col("p_size").isin(1, 5, 9)).select("p_partkey", "p_name")


@query("status_not_in", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY o_orderstatus")
def status_not_in(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(~F.col("o_orderstatus").isin("F", "P"))
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "null_safe_comparison",
    "SELECT count(*) AS n FROM (SELECT nullif(o_orderstatus, 'P') AS a, nullif(o_orderpriority, '5-LOW') AS b FROM orders) WHERE a IS DISTINCT FROM 'F' AND b IS NOT NULL",
)
def null_safe_comparison(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.nullif("o_orderstatus", F.lit("P")).alias("a"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("b")
    )
    return orders.where(~F.col("a").eqNullSafe(F.lit("F")) & F.col("b").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query("distinct_segments", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct_segments(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query(
    "distinct_on_latest",
    f"""SELECT o_custkey, o_orderkey, {CENTS} AS total_cents FROM (SELECT *, row_number() OVER
        (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def distinct_on_latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    best = orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", -F.col("o_orderkey"))).alias("x"))
    return best.select("o_custkey", "x.o_orderkey", cents(F.col("x.o_totalprice")).alias("total_cents"))


@query("null_order", "SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) ORDER BY s DESC NULLS FIRST, o_orderkey LIMIT 50")
def null_order(spark, sf_dir):
    """Nulls come first in descending order and last in ascending order, always said explicitly."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return orders.orderBy(F.desc_nulls_first("s"), "o_orderkey").limit(50)


@query("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40")
def limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@query(
    "rank_with_ties",
    "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10",
)
def rank_with_ties(spark, sf_dir):
    """FETCH FIRST 10 ROWS WITH TIES: the tenth largest value comes from a bounded top-k, then all rows
    that reach it stay, so no window sorts the whole table in one task."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    top = part.orderBy(F.desc("p_size")).limit(10).agg(F.min("p_size").alias("least"))
    return part.join(F.broadcast(top), part["p_size"] >= top["least"]).select("p_partkey", "p_size")


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT l_suppkey FROM lineitem")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).union(table(spark, sf_dir, "lineitem").select("l_suppkey")).distinct()


@query("intersect_keys", "SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem")
def intersect_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf_dir, "lineitem").select("l_suppkey"))


@query("except_all_rows", "SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_linenumber <= 2 EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_linestatus = 'O'")
def except_all_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_linenumber <= 2").select("l_returnflag", "l_linenumber").exceptAll(lines.where("l_linestatus = 'O'").select("l_returnflag", "l_linenumber"))


@query("scalar_subquery", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT max(s_acctbal) FROM supplier) - 200")
def scalar_subquery(spark, sf_dir):
    most = table(spark, sf_dir, "supplier").agg(F.max("s_acctbal").alias("m"))
    customer = table(spark, sf_dir, "customer")
    return customer.join(F.broadcast(most), customer["c_acctbal"] > most["m"] - 200).select("c_custkey", "c_acctbal")


@query("recursive_dates", "WITH RECURSIVE d(day) AS (SELECT DATE '1996-01-01' UNION ALL SELECT CAST(day + INTERVAL 1 DAY AS DATE) FROM d WHERE day < DATE '1996-01-31') SELECT day, count(o_orderkey) AS n FROM d LEFT JOIN orders ON CAST(o_orderdate AS DATE) = day GROUP BY day")
def recursive_dates(spark, sf_dir):
    """A series without gaps: a recursive CTE in SQL, ``sequence`` here."""
    days = spark.range(1).select(F.explode(F.expr("sequence(DATE '1996-01-01', DATE '1996-01-31')")).alias("day"))
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= '1996-01-01' AND o_orderdate < '1996-02-01'")
    counts = orders.groupBy(F.to_date("o_orderdate").alias("on")).agg(F.count("o_orderkey").alias("n"))
    return days.join(counts, days["day"] == counts["on"], "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("json_prop_counts", "SELECT event_type, count(props ->> '$.k') AS with_k, count(*) AS n FROM events GROUP BY event_type")
def json_prop_counts(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.count(F.lit(1)).alias("n"))


@query("array_membership", "SELECT count(*) AS n FROM part WHERE p_size = ANY([3, 7, 11])")
def array_membership(spark, sf_dir):
    wanted = F.array(*map(F.lit, (3, 7, 11)))
    return table(spark, sf_dir, "part").where(F.array_contains(wanted, F.col("p_size"))).agg(F.count(F.lit(1)).alias("n"))


@query("unnest_with_ordinality", "SELECT p_partkey, w AS word, CAST(i AS BIGINT) AS position FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def unnest_with_ordinality(spark, sf_dir):
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word"))
    return words.select("p_partkey", "word", (F.col("i") + 1).cast("long").alias("position"))


@query("string_functions", "SELECT c_custkey, upper(trim(c_name)) AS a, substring(c_name, 1, 4) AS b, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS c, abs(round(c_acctbal)) AS d FROM customer")
def string_functions(spark, sf_dir):
    balance = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(F.trim("c_name")).alias("a"), F.substring("c_name", 1, 4).alias("b"),
        F.when(balance < 0, "debt").otherwise("credit").alias("c"), F.abs(F.round(balance)).alias("d"),
    )


@query("page_of_rows", "SELECT o_orderkey, page FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 20 + 1 AS page FROM orders) WHERE page = 3")
def page_of_rows(spark, sf_dir):
    """Page 3 of pages of 20: numbered within a bounded top-k only."""
    rows = table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(60).select("o_orderkey")
    number = F.row_number().over(Window.orderBy("o_orderkey"))
    return rows.withColumn("page", (F.floor((number - 1) / 20) + 1).cast("long")).where("page = 3")
