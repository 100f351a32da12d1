"""Joins of every kind over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.columns import cents
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(
    "revenue_per_customer",
    """SELECT c_custkey, c_name, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS revenue_cents
       FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
       GROUP BY c_custkey, c_name ORDER BY revenue_cents DESC, c_custkey LIMIT 100""",
)
def revenue_per_customer(spark, sf_dir):
    """Orders are summed by customer before the join, which then meets one row a customer."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    spent = orders.groupBy("o_custkey").agg(F.sum(cents(F.col("o_totalprice"))).alias("revenue_cents"))
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = spent.join(names, spent["o_custkey"] == names["c_custkey"])
    return joined.select("c_custkey", "c_name", "revenue_cents").orderBy(F.desc("revenue_cents"), "c_custkey").limit(100)


@query(
    "avg_order_value_by_nation",
    """SELECT n_name, round(avg(o_totalprice), 2) AS avg_value, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey
       JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
def avg_order_value_by_nation(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.avg("o_totalprice"), 2).alias("avg_value"), F.count(F.lit(1)).alias("n"))


@query(
    "trade_lanes",
    """SELECT cn.n_name AS customer_nation, sn.n_name AS supplier_nation, count(*) AS n FROM lineitem
       JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
       JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY 1, 2""",
)
def trade_lanes(spark, sf_dir):
    """One dimension in two roles; names are joined after counting, to a row a pair of nations."""
    lines, orders, customer, supplier = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "customer", "supplier"))
    joined = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("c_custkey") == F.col("o_custkey")).join(supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    counts = joined.groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation = table(spark, sf_dir, "nation")
    buyers = nation.select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("customer_nation"))
    sellers = nation.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("supplier_nation"))
    named = counts.join(buyers, F.col("ck") == F.col("c_nationkey")).join(sellers, F.col("sk") == F.col("s_nationkey"))
    return named.select("customer_nation", "supplier_nation", "n")


@query("orders_without_lineitems", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL")
def orders_without_lineitems(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query(
    "customers_without_finished_orders",
    "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' WHERE o_orderkey IS NULL",
)
def customers_without_finished_orders(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customer.join(orders, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "F"), "left_anti").select("c_custkey", "c_name")


@query("order_counts_incl_zero", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' GROUP BY c_custkey")
def order_counts_incl_zero(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("o_orderkey").alias("some"))
    customer = table(spark, sf_dir, "customer")
    return customer.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("some", F.lit(0)).alias("n"))


@query("semi_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)")
def semi_exists(spark, sf_dir):
    supplier, lines = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    return supplier.join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("s_suppkey")


@query("anti_not_exists", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_not_exists(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("unlabeled_documents", "SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL ORDER BY d.doc_id LIMIT 100")
def unlabeled_documents(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    return documents.join(labels, "doc_id", "left_anti").orderBy("doc_id").limit(100)


@query("using_join", "SELECT doc_id, quality, toxic, source FROM labels JOIN documents USING (doc_id) WHERE toxic = 1")
def using_join(spark, sf_dir):
    return table(spark, sf_dir, "labels").where("toxic = 1").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query("full_outer_counts", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) b ON a.k = b.k")
def full_outer_counts(spark, sf_dir):
    a = table(spark, sf_dir, "customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf_dir, "supplier").where("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full")


@query("right_join_regions", "SELECT r_name, count(n_nationkey) AS n FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_name LIKE 'NATION_1%' GROUP BY r_name")
def right_join_regions(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_name LIKE 'NATION_1%'")
    return nation.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "right").groupBy("r_name").agg(F.count("n_nationkey").alias("n"))


@query(
    "lateral_top1",
    "SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t",
)
def lateral_top1(spark, sf_dir):
    """The largest order of each customer: a partial aggregate instead of a sort per customer."""
    best = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))
    return table(spark, sf_dir, "customer").join(best, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@query(
    "either_key_join",
    "SELECT c_custkey, count(*) AS n FROM customer JOIN (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_quantity = 50) l ON c_custkey IN (a, b) GROUP BY c_custkey",
)
def either_key_join(spark, sf_dir):
    """A join on one of two keys, as one equi-join over both keys instead of a nested loop."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity = 50")
    keys = lines.select(F.explode(F.array_distinct(F.array("l_partkey", "l_suppkey"))).alias("k"))
    counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(counts, F.col("c_custkey") == F.col("k")).select("c_custkey", "n")


@query("update_from_rewrite", "SELECT c_custkey, coalesce(n, 0) AS finished FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def update_from_rewrite(spark, sf_dir):
    """What UPDATE ... FROM would set, as a new version of the rows."""
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").join(finished, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("finished"))
