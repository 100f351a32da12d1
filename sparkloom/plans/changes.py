"""Changes of tables as rewrites, and results as texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.columns import ranker_tokens
from sparkloom.operators import sinks, writes
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))


@query("rows_after_update", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN {_CENTS} + 100 ELSE {_CENTS} END AS cents FROM orders")
def rows_after_update(spark, sf_dir):
    """The second assignment still sees the row as it was before the first."""
    pending = writes.Change("update", F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("F"), "cents": F.col("cents") + 100})
    return writes.after(_orders(spark, sf_dir), pending)


@query("rows_after_delete", f"SELECT o_orderkey, o_orderstatus, {_CENTS} AS cents FROM orders WHERE o_orderstatus <> 'P'")
def rows_after_delete(spark, sf_dir):
    return writes.after(_orders(spark, sf_dir), writes.Change("delete", F.col("o_orderstatus") == "P"))


@query(
    "rows_after_upsert",
    """SELECT c_custkey, CASE WHEN n IS NULL THEN c_mktsegment ELSE 'BUYER' END AS segment FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12) ON o_custkey = c_custkey
       UNION ALL SELECT -1, 'NEW'""",
)
def rows_after_upsert(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    busy = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")).where("n > 12")
    source = busy.select("c_custkey", F.lit("BUYER").alias("segment")).union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("NEW")))
    return writes.after(target, writes.Change("upsert", source=source, keys=("c_custkey",)))


@query(
    "returning_capped",
    f"""WITH h AS (SELECT o_orderkey, {_CENTS} + 100 AS cents FROM orders WHERE o_orderstatus = 'P')
       SELECT (SELECT count(*) FROM h) AS affected_rows, CAST(row_number() OVER (ORDER BY o_orderkey) AS INT) AS position, o_orderkey, cents FROM (SELECT * FROM h ORDER BY o_orderkey LIMIT 20)""",
)
def returning_capped(spark, sf_dir):
    pending = writes.Change("update", F.col("o_orderstatus") == "P", {"cents": F.col("cents") + 100})
    return writes.returning(_orders(spark, sf_dir), pending, ["o_orderkey", "cents"], ["o_orderkey"], 20)


@query("returning_nothing", "SELECT CAST(0 AS BIGINT) AS affected_rows, CAST(NULL AS INT) AS position, CAST(NULL AS BIGINT) AS o_orderkey")
def returning_nothing(spark, sf_dir):
    return writes.returning(_orders(spark, sf_dir), writes.Change("delete", F.col("o_orderstatus") == "X"), ["o_orderkey"], ["o_orderkey"], 20)


@query("file_names", r"SELECT p_partkey, trim(regexp_replace(lower(p_type || ' / ' || p_name), '[^\p{L}\p{M}\p{N}]+', '-', 'g'), '-') || '.csv' AS file_name FROM part")
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sinks.file_name(F.concat_ws(" / ", "p_type", "p_name")).alias("file_name"))


@query("json_lines", """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""")
def json_lines(spark, sf_dir):
    return sinks.json_lines(table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name"))


@query("canonical_json", """SELECT event_id, '{"a":{"y":' || user_id || ',"z":"' || event_type || '"},"b":1}' AS json FROM events""")
def canonical_json(spark, sf_dir):
    text = F.concat(F.lit('{ "b": 1, "a": {"z": "'), "event_type", F.lit('", "y": '), F.col("user_id").cast("string"), F.lit("} }"))
    return table(spark, sf_dir, "events").select("event_id", sinks.canonical_json(text).alias("json"))


@query(
    "capped_texts",
    """SELECT doc_id, left(text, list_max(list_filter(range(0, 201), lambda k: octet_length(encode(left(text, CAST(k AS BIGINT)))) <= 200))) AS shown,
       octet_length(encode(text)) AS bytes, octet_length(encode(text)) > 200 AS truncated FROM documents""",
)
def capped_texts(spark, sf_dir):
    """The first 200 bytes are what the feature shows; ``bytes`` counts the whole text."""
    capped = sinks.capped_text(F.col("text"), 200)
    return table(spark, sf_dir, "documents").select("doc_id", capped["text"].alias("shown"), capped["bytes"].cast("long").alias("bytes"), capped["truncated"].alias("truncated"))


@query(
    "percents",
    """SELECT l_returnflag, CAST(round(100.0 * count(*) FILTER (WHERE l_tax > 0.04) / count(*)) AS BIGINT) AS percent,
       printf('%.1f%%', 100.0 * count(*) FILTER (WHERE l_tax > 0.04) / count(*)) AS precise FROM lineitem GROUP BY 1""",
)
def percents(spark, sf_dir):
    share = 100 * F.count_if(F.col("l_tax") > 0.04) / F.count(F.lit(1))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(share).cast("long").alias("percent"), F.format_string("%.1f%%", share).alias("precise"))


@query("floored_seconds", "SELECT o_orderkey, CAST(floor(epoch(o_orderdate - TIMESTAMP '1995-06-17 00:00:07') / 3600) AS BIGINT) AS hours FROM orders")
def floored_seconds(spark, sf_dir):
    """Hours since a moment; those before it count down, as floor division has it."""
    seconds = F.unix_micros(F.col("o_orderdate").cast("timestamp")) - F.unix_micros(F.lit("1995-06-17 00:00:07").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(seconds / 3_600_000_000).alias("hours"))


@query(
    "token_overlap",
    """WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_type), '[^a-z]+'), lambda w: w <> '')) AS a FROM part)
       SELECT p_partkey, CAST(len(list_intersect(a, ['promo', 'tin', 'small'])) AS INT) AS shared, CAST(3 - len(list_intersect(a, ['promo', 'tin', 'small'])) AS INT) AS unmet FROM t""",
)
def token_overlap(spark, sf_dir):
    """Words of the question that a part's type has, and those that it hasn't."""
    asked = F.array(*map(F.lit, ("promo", "tin", "small")))
    has = ranker_tokens(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(asked, has)).alias("shared"), F.size(F.array_except(asked, has)).alias("unmet"))


_PAGE = 20


@query(
    "last_page",
    """WITH n AS (SELECT CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM part), r AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part)
       SELECT p_partkey, pages AS page, pages FROM r, n WHERE k > (pages - 1) * 20""",
)
def last_page(spark, sf_dir):
    """A page beyond the last one is clamped to it. The keys before the page come from one ordered offset."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    pages = max(1, -(-part.count() // _PAGE))
    page = min(pages, 10**9)
    return part.orderBy("p_partkey").offset((page - 1) * _PAGE).limit(_PAGE).select("p_partkey", F.lit(page).cast("long").alias("page"), F.lit(pages).cast("long").alias("pages"))
