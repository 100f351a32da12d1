"""Comparison and evaluation metrics over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import metrics
from sparkloom.operators.compare import bag_difference
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(
    "bag_diff",
    """SELECT l_returnflag, l_linestatus, CASE WHEN b > 0 THEN 'golden' ELSE 'candidate' END AS side, CAST(abs(b) AS BIGINT) AS extra FROM
       (SELECT l_returnflag, l_linestatus, sum(CASE WHEN l_linenumber <= 3 THEN 1 ELSE -1 END) AS b FROM lineitem GROUP BY 1, 2) WHERE b <> 0""",
)
def bag_diff(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return bag_difference(*[lines.where(c).select("l_returnflag", "l_linestatus") for c in ("l_linenumber <= 3", "l_linenumber > 3")])


@query("crosstab_quality_toxic", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic")
def crosstab_quality_toxic(spark, sf_dir):
    return metrics.crosstab(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("repeat_stability", "SELECT event_type, user_id, count(*) AS runs, count(DISTINCT value > 50) AS kinds, count(DISTINCT value > 50) > 1 AS flaky FROM events GROUP BY 1, 2")
def repeat_stability(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("status", F.col("value") > 50)
    return metrics.repeat_stability(events, ["event_type", "user_id"], "status")


@query("quality_pass_rates", "SELECT source, count(quality) AS n, count(*) FILTER (WHERE quality = 1) AS passes, round(avg(quality), 4) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY source")
def quality_pass_rates(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return metrics.pass_rates(joined.withColumn("passed", F.col("quality") == 1), "source")


@query(
    "ranking_recall",
    """WITH r AS (SELECT o_custkey AS c, o_orderkey AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders),
    q AS (SELECT o_custkey AS c, o_orderkey AS i FROM orders WHERE o_orderpriority = '1-URGENT'),
    b AS (SELECT q.c, min(k) AS f, count(*) AS n, count(*) FILTER (WHERE k <= 3) AS a3, count(*) FILTER (WHERE k <= 5) AS a5, count(*) FILTER (WHERE k <= 8) AS a8 FROM q JOIN r USING (c, i) GROUP BY q.c)
    SELECT round(sum(a3) * 1.0 / sum(n), 4) AS recall_at_3, round(avg((a3 = n)::INT), 4) AS all_at_3, round(sum(a5) * 1.0 / sum(n), 4) AS recall_at_5, round(avg((a5 = n)::INT), 4) AS all_at_5,
    round(sum(a8) * 1.0 / sum(n), 4) AS recall_at_8, round(avg((a8 = n)::INT), 4) AS all_at_8, round(avg(1.0 / f), 4) AS mrr FROM b""",
)
def ranking_recall(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case"), F.col("o_orderkey").alias("item"), "o_totalprice", "o_orderpriority")
    rank = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("o_totalprice"), "item"))
    return metrics.ranking_quality(orders.where("o_orderpriority = '1-URGENT'").select("case", "item"), orders.select("case", "item", rank.alias("rank")))


@query("last_result_wins", "SELECT c_custkey AS k, coalesce(s, 'missing') AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def last_result_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return metrics.completeness(expected, orders, ["k"], "o_orderkey", "o_orderstatus").select("k", "status")


@query("running_budgets", "SELECT o_orderkey, CAST(coalesce(sum(c) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 50000000 AS BOOLEAN) AS allowed FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)")
def running_budgets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("c", F.round(F.col("o_totalprice") * 100).cast("long"))
    return metrics.running_budget(orders, "o_custkey", ["o_orderkey"], "c", 50_000_000).select("o_orderkey", "allowed")


_RANKED = "r AS (SELECT o_custkey AS c, o_orderkey AS i, o_orderpriority AS name, o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)"


def _ranked(spark, sf_dir):
    rank = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("o_totalprice"), "item"))
    orders = table(spark, sf_dir, "orders").withColumns({"case": F.col("o_custkey"), "item": F.col("o_orderkey"), "name": F.col("o_orderpriority"), "status": F.col("o_orderstatus")})
    return orders.select("case", "item", "name", "status", rank.alias("rank"))


@query(
    "best_alternative_group",
    f"""WITH {_RANKED}, g AS (SELECT c, name, count(*) FILTER (WHERE k > 8) AS missing, max(k) FILTER (WHERE k <= 8) AS worst, count(*) AS n, string_agg(i::VARCHAR, '|' ORDER BY i::VARCHAR) AS names FROM r GROUP BY 1, 2)
       SELECT c AS "case", name AS "group", missing, CAST(worst AS INT) AS worst FROM g QUALIFY row_number() OVER (PARTITION BY c ORDER BY missing, worst NULLS LAST, n, names) = 1""",
)
def best_alternative_group(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    return metrics.best_groups(ranked.select("case", F.col("name").alias("group"), "item"), ranked.where("rank <= 8").select("case", "item", "rank"))


@query(
    "name_collisions",
    f"""WITH {_RANKED}, t AS (SELECT * FROM r WHERE k <= 10) SELECT q.c AS "case", CAST(sum((SELECT count(*) FROM t WHERE t.c = q.c AND t.name = q.name AND t.i <> q.i AND t.k < CASE WHEN q.k <= 10 THEN q.k ELSE 9 END)) AS BIGINT) AS collisions
       FROM r q WHERE q.s = 'P' GROUP BY 1""",
)
def name_collisions(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    return metrics.collisions(ranked.where("status = 'P'").select("case", "item", "name"), ranked.where("rank <= 10").select("case", "item", "name", "rank"))


@query("forbidden_distractors", f"""WITH {_RANKED} SELECT c AS "case", count(*) FILTER (WHERE k <= 3) AS violations FROM r WHERE s = 'P' GROUP BY 1""")
def forbidden_distractors(spark, sf_dir):
    ranked = _ranked(spark, sf_dir)
    return metrics.distractors(ranked.where("status = 'P'").select("case", "item"), ranked.select("case", "item", "rank"), 3)


@query(
    "usage_totals",
    """SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN c END) AS BIGINT) AS prompt_tokens, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN c // 2 END) AS BIGINT) AS cached_tokens,
       CASE WHEN sum(CASE WHEN o_orderstatus <> 'P' THEN c END) > 0 THEN round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN c // 2 END), 0) / sum(CASE WHEN o_orderstatus <> 'P' THEN c END), 4) END AS cache_hit_rate,
       CASE WHEN bool_or(o_orderstatus = 'O') THEN 'estimated' WHEN bool_or(o_orderstatus = 'F') THEN 'reported' END AS cost_source
       FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS c FROM orders) GROUP BY 1""",
)
def usage_totals(spark, sf_dir):
    status, c = F.col("o_orderstatus"), F.round("o_totalprice").cast("long")
    results = table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.when(status != "P", c).alias("prompt_tokens"),
        F.when(status == "F", F.floor(c / 2)).alias("cached_tokens"),
        F.when(status == "O", "estimated").when(status == "F", "reported").alias("source"),
    )
    return metrics.usage_totals(results, ["o_custkey"], ["prompt_tokens", "cached_tokens"], "cached_tokens", "prompt_tokens", "source")


@query(
    "extra_call_histogram",
    """WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS calls FROM events GROUP BY 1)
       SELECT calls, count(*) AS results, round(count(*) / (SELECT count(*) FROM n), 4) AS share FROM n GROUP BY 1""",
)
def extra_call_histogram(spark, sf_dir):
    return metrics.call_histogram(table(spark, sf_dir, "events").withColumn("call", F.when(F.col("event_type") == "error", 1)), "user_id")


@query(
    "paired_arms",
    """WITH s AS (SELECT user_id, bool_or(value > 60) FILTER (WHERE event_type = 'view') AS a, bool_or(value > 60) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY 1)
       SELECT count(*) AS pairs, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_on, count(*) FILTER (WHERE b AND NOT a) AS only_off,
       count(*) FILTER (WHERE NOT a AND NOT b) AS neither FROM s WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def paired_arms(spark, sf_dir):
    return metrics.paired_arms(table(spark, sf_dir, "events").withColumn("passed", F.col("value") > 60), "user_id", "event_type", "passed", "view", "click")


@query(
    "withheld_summary",
    """SELECT count(*) AS withheld, count(*) FILTER (WHERE lang <> 'en') AS expected, count(quality) AS scored, count(*) FILTER (WHERE quality = 1) AS passes
       FROM documents LEFT JOIN (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) WHERE n_chars < 1000 HAVING count(*) > 0""",
)
def withheld_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.first("quality", ignorenulls=True).alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") < 1000).alias("withheld"), (F.col("lang") == "en").alias("decision_matches"))
    return metrics.withheld_summary(docs.join(labels, "doc_id", "left").withColumn("passed", F.col("quality") == 1))


@query(
    "resume_plan",
    """SELECT c_custkey AS k, s AS last_status, CASE WHEN s IS NULL OR s = 'P' THEN 'run' ELSE 'reuse' END AS action
       FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def resume_plan(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return metrics.resume_plan(expected, table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k"), ["k"], "o_orderkey", "o_orderstatus", ["P"])


@query(
    "threshold_acceptance",
    """SELECT a AND b AS passed, concat_ws('; ', CASE WHEN NOT a THEN 'finished below 0.9' END, CASE WHEN NOT b THEN 'urgent above zero' END) AS messages
       FROM (SELECT avg((o_orderstatus = 'F')::INT) >= 0.9 AS a, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') = 0 AS b FROM orders)""",
)
def threshold_acceptance(spark, sf_dir):
    summary = table(spark, sf_dir, "orders").agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("finished"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    return metrics.acceptance(summary, {"finished": 0.9}, ("urgent",))
