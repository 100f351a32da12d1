"""Aggregations over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import cents, nearest_rank
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query("tied_status_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def tied_status_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("n"))


@query("open_orders_by_segment", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus NOT IN ('F') GROUP BY c_mktsegment")
def open_orders_by_segment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where(~F.col("o_orderstatus").isin("F"))
    return orders.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("top_part_by_lineitems", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 1")
def top_part_by_lineitems(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(1)


@query(
    "avg_ship_delay_seconds",
    """SELECT CAST(round(avg(epoch(l_shipdate) - epoch(o_orderdate))) AS BIGINT) AS seconds FROM lineitem JOIN orders ON o_orderkey = l_orderkey
       WHERE o_orderdate >= TIMESTAMP '1996-06-01' AND o_orderdate < TIMESTAMP '1996-07-01'""",
)
def avg_ship_delay_seconds(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP_NTZ '1996-06-01' AND o_orderdate < TIMESTAMP_NTZ '1996-07-01'")
    delay = F.expr("timestampdiff(SECOND, o_orderdate, l_shipdate)")
    joined = table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.agg(F.round(F.avg(delay)).cast("long").alias("seconds"))


@query("active_users_by_type", "SELECT event_type, count(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY GROUP BY event_type")
def active_users_by_type(spark, sf_dir):
    recent = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-30' - INTERVAL '7' DAY")
    return recent.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("busy_customers", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def busy_customers(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 15")


PRICING = """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sum_qty,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_price_cents, min(l_discount) AS least_discount,
  max(l_tax) AS most_tax, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"""


@query("pricing_summary", PRICING)
def pricing_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("sum_qty"), F.sum(cents(F.col("l_extendedprice"))).alias("sum_price_cents"),
        F.min("l_discount").alias("least_discount"), F.max("l_tax").alias("most_tax"), F.count(F.lit(1)).alias("n"),
    )


def _grouped(kind: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY {kind}"


@query("rollup_counts", _grouped("ROLLUP (l_returnflag, l_linestatus)"))
def rollup_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("cube_counts", _grouped("CUBE (l_returnflag, l_linestatus)"))
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("grouping_sets_counts", _grouped("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets_counts(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupingSets([[flag], [status], []], flag, status).agg(F.count(F.lit(1)).alias("n"))


@query("conditional_count", "SELECT o_orderstatus, CAST(sum(CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END) AS BIGINT) AS large, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_orderstatus")
def conditional_count(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 200000).alias("large"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("avg_of_daily_counts", "SELECT event_type, round(avg(n), 4) AS daily FROM (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY event_type")
def avg_of_daily_counts(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy("event_type").agg(F.round(F.avg("n"), 4).alias("daily"))


@query("percentile_cont", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def percentile_cont(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_quantity", 0.9), 4).alias("p90"))


@query("null_counts", "SELECT count(*) - count(s) AS nulls, count(s) AS present, count(DISTINCT s) AS kinds FROM (SELECT nullif(o_orderstatus, 'P') AS s FROM orders)")
def null_counts(spark, sf_dir):
    s = F.nullif("o_orderstatus", F.lit("P"))
    return table(spark, sf_dir, "orders").agg((F.count(F.lit(1)) - F.count(s)).alias("nulls"), F.count(s).alias("present"), F.countDistinct(s).alias("kinds"))


@query(
    "latency_nearest_rank",
    """SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 4) AS mean,
       list_sort(list(value))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS p50,
       list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95 FROM events GROUP BY event_type""",
)
def latency_nearest_rank(spark, sf_dir):
    """Percentiles by nearest rank, of a value that may differ in every row."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return nearest_rank_summary(events.groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("m")))


BUCKETS = 4096


def nearest_rank_summary(by_value):
    """min, max, mean and nearest-rank p50 and p95 by event_type of rows (event_type, value, m).

    A histogram of ``BUCKETS`` equal ranges a type tells in which one a percentile lies; only the values in
    that range are ranked one by one, so a type's rows never meet in one task."""
    totals = by_value.groupBy("event_type").agg(
        F.sum("m").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.round(F.sum(F.col("value") * F.col("m")) / F.sum("m"), 4).alias("mean"),
    )
    share = F.coalesce(F.try_divide(F.col("value") - F.col("least"), F.col("most") - F.col("least")), F.lit(0.0))
    placed = by_value.join(totals, "event_type").select("event_type", "value", "m", "n", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket"))
    coarse = placed.groupBy("event_type", "n", "bucket").agg(F.sum("m").alias("inside"))
    coarse = coarse.withColumn("upto", F.sum("inside").over(Window.partitionBy("event_type").orderBy("bucket")))
    asked = coarse.withColumn("p", F.explode(F.array(F.lit(0.5), F.lit(0.95)))).withColumn("rank", F.floor((F.col("n") - 1) * F.col("p") + 0.5) + 1)
    asked = asked.where("upto >= rank AND upto - inside < rank").select("event_type", "bucket", "p", (F.col("rank") - F.col("upto") + F.col("inside")).alias("rank"))
    near = placed.join(asked, ["event_type", "bucket"])
    near = near.withColumn("upto", F.sum("m").over(Window.partitionBy("event_type", "p").orderBy("value"))).where("upto >= rank")
    found = near.groupBy("event_type").agg(*[F.min(F.when(F.col("p") == p, F.col("value"))).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"))])
    return totals.join(found, "event_type").select("event_type", "n", "least", "most", "mean", "p50", "p95")


@query("small_group_ranks", "SELECT n_regionkey, list_sort(list(n_nationkey))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS p50 FROM nation GROUP BY n_regionkey")
def small_group_ranks(spark, sf_dir):
    """The same percentile over groups known to be small, from a sorted array."""
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(nearest_rank(F.array_sort(F.collect_list("n_nationkey")), 0.5).alias("p50"))
