"""Window functions over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import cents
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(
    "running_total",
    "SELECT o_custkey, o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far FROM orders",
)
def running_total(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sum(cents(F.col("o_totalprice"))).over(w).alias("so_far"))


@query("partition_avg", "SELECT p_partkey, round(avg(p_size) OVER (PARTITION BY p_brand), 4) AS brand_size FROM part")
def partition_avg(spark, sf_dir):
    """The average of a brand, of which there are few, is joined back, so a brand's rows never meet."""
    part = table(spark, sf_dir, "part")
    means = part.groupBy("p_brand").agg(F.round(F.avg("p_size"), 4).alias("brand_size"))
    return part.join(means, "p_brand").select("p_partkey", "brand_size")


@query("share_of_total", "SELECT event_type, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def share_of_total(spark, sf_dir):
    """The total comes from the counts, one row a type."""
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("lag_gap", "SELECT event_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events")
def lag_gap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.expr("timestampdiff(MICROSECOND, before, ts)")
    return table(spark, sf_dir, "events").withColumn("before", F.lag("ts").over(w)).select("event_id", (micros / 1e6).alias("gap"))


@query("ranks_of_orders", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS i FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def ranks_of_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")).cast("long").alias("i"),
    )


@query("groups_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM part")
def groups_frame(spark, sf_dir):
    """A GROUPS frame: peers are counted first, so the frame runs over one row a brand and size."""
    part = table(spark, sf_dir, "part")
    peers = part.groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("m"))
    frame = Window.partitionBy("p_brand").orderBy("p_size").rowsBetween(-1, Window.currentRow)
    return part.join(peers.withColumn("n", F.sum("m").over(frame)), ["p_brand", "p_size"]).select("p_partkey", "n")


@query("filtered_window", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS finished FROM orders")
def filtered_window(spark, sf_dir):
    finished = F.count(F.when(F.col("o_orderstatus") == "F", 1)).over(Window.partitionBy("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", finished.alias("finished"))
