"""Scalar functions, literals and clauses of the SQL surface: each in one query over a whole test table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.functions.columns import cents
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(
    "orders_by_month",
    "SELECT date_trunc('month', o_orderdate)::DATE AS month, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1",
)
def orders_by_month(spark, sf_dir):
    month = F.trunc("o_orderdate", "month").alias("month")
    return table(spark, sf_dir, "orders").groupBy(month).agg(F.count(F.lit(1)).alias("n"))


@query(
    "extracted_parts",
    """SELECT CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(quarter FROM o_orderdate) AS INT) AS q,
       CAST(extract(isodow FROM o_orderdate) AS INT) AS dow, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
)
def extracted_parts(spark, sf_dir):
    date = F.col("o_orderdate")
    parts = F.year(date).alias("y"), F.quarter(date).alias("q"), (F.weekday(date) + 1).alias("dow")
    return table(spark, sf_dir, "orders").groupBy(*parts).agg(F.count(F.lit(1)).alias("n"))


@query(
    "date_arithmetic",
    """SELECT o_orderkey, o_orderdate::DATE + 7 AS week_later, o_orderdate::DATE - 1 AS day_before,
       CAST(o_orderdate::DATE - DATE '1995-01-01' AS INT) AS days FROM orders""",
)
def date_arithmetic(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_add(day, 7).alias("week_later"), F.date_sub(day, 1).alias("day_before"), F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days")
    )


@query(
    "in_time_zone",
    "SELECT event_id, strftime(ts + INTERVAL '5 hours 30 minutes', '%Y-%m-%d %H:%M') AS local_time FROM events",
)
def in_time_zone(spark, sf_dir):
    """A zone without daylight saving, so that the oracle needs no zone data."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), "ts")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm").alias("local_time"))


@query("binary_collation", "SELECT c_mktsegment, min(c_name) AS first_name, max(c_name) AS last_name FROM customer GROUP BY 1")
def binary_collation(spark, sf_dir):
    name = F.collate("c_name", "UTF8_BINARY")
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.min(name).alias("first_name"), F.max(name).alias("last_name"))


@query(
    "array_subscripts",
    "SELECT p_partkey, len(string_split(p_type, ' ')) AS words, string_split(p_type, ' ')[1] AS first_word, string_split(p_type, ' ')[9] AS ninth FROM part",
)
def array_subscripts(spark, sf_dir):
    words = F.split("p_type", " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(words).cast("long").alias("words"), F.get(words, F.lit(0)).alias("first_word"), F.get(words, F.lit(8)).alias("ninth")
    )


@query(
    "json_array_elements",
    """SELECT event_id, u.e AS element, CAST(u.o AS BIGINT) AS position
       FROM (SELECT event_id, ['a', event_type, CAST(user_id AS VARCHAR)] AS x FROM events), LATERAL (SELECT unnest(x) AS e, generate_subscripts(x, 1) AS o) u""",
)
def json_array_elements(spark, sf_dir):
    """An array as JSON text, parsed again, one row an element."""
    text = F.to_json(F.array(F.lit("a"), "event_type", F.col("user_id").cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", F.posexplode(F.from_json(text, "array<string>")).alias("k", "element"))
    return rows.select("event_id", "element", (F.col("k") + 1).cast("long").alias("position"))


@query("boolean_tests", "SELECT (toxic = 1) IS TRUE AS is_toxic, (quality = 1) IS NOT TRUE AS not_good, count(*) AS n FROM labels GROUP BY 1, 2")
def boolean_tests(spark, sf_dir):
    toxic, good = F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 1, F.lit(False))
    return table(spark, sf_dir, "labels").groupBy(toxic.alias("is_toxic"), (~good).alias("not_good")).agg(F.count(F.lit(1)).alias("n"))


@query("repeatable_sample", "SELECT o_orderkey FROM orders WHERE md5('7:' || o_orderkey) < '1999999a'")
def repeatable_sample(spark, sf_dir):
    """TABLESAMPLE BERNOULLI (10) REPEATABLE (7), where sampling is the feature: each row by a hash of seed and
    key, so that the sample doesn't depend on partitions as that of ``DataFrame.sample`` does."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.where(F.md5(F.concat(F.lit("7:"), F.col("o_orderkey").cast("string"))) < "1999999a")


@query("random_ids", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT gen_random_uuid()) AS BIGINT) AS ids, true AS well_formed FROM orders")
def random_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.uuid().alias("id"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.bool_and(F.col("id").rlike("^[0-9a-f-]{36}$")).alias("well_formed"))


@query(
    "escaped_patterns",
    r"SELECT event_id, event_type LIKE '%\_%' ESCAPE '\' AS has_underscore, 'a\b' AS backslash FROM events",
)
def escaped_patterns(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr("event_type LIKE '%!_%' ESCAPE '!'").alias("has_underscore"), F.lit("a\\b").alias("backslash")
    )


@query("similar_to", "SELECT p_partkey, regexp_full_match(p_brand, '(Brand#1|Brand#2).*') AS low_brand FROM part")
def similar_to(spark, sf_dir):
    """SIMILAR TO '(Brand#1|Brand#2)%': the pattern spans the whole value."""
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").rlike("^(?:(Brand#1|Brand#2).*)$").alias("low_brand"))


@query("trimmed_both", "SELECT p_partkey, trim(p_type, 'SLEN') AS trimmed, substring(p_name, 2, 3) AS part_of_name FROM part")
def trimmed_both(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.expr("trim(BOTH 'SLEN' FROM p_type)").alias("trimmed"), F.substring("p_name", 2, 3).alias("part_of_name")
    )


@query(
    "nested_ctes",
    """WITH spent(custkey, total) AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) FROM orders GROUP BY 1),
       large AS (SELECT * FROM spent WHERE total > (SELECT avg(total) FROM spent))
       SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM large JOIN customer ON c_custkey = custkey GROUP BY 1""",
)
def nested_ctes(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.sum(cents(F.col("o_totalprice"))).alias("total"))
    mean = spent.agg(F.avg("total").alias("mean"))  # one row
    large = spent.join(F.broadcast(mean), F.col("total") > F.col("mean"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return large.join(customers, large["custkey"] == customers["c_custkey"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "derived_table_aliases",
    "SELECT d.seg, d.customers FROM (SELECT c_mktsegment, count(*) FROM customer GROUP BY 1) AS d(seg, customers)",
)
def derived_table_aliases(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").count().toDF("seg", "customers")


@query(
    "natural_join",
    "SELECT r_name, n_name FROM (SELECT n_regionkey AS regionkey, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS regionkey, r_name FROM region)",
)
def natural_join(spark, sf_dir):
    left = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("regionkey"), "n_name")
    right = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("regionkey"), "r_name")
    return left.join(right, [c for c in left.columns if c in right.columns]).select("r_name", "n_name")


STATUS = (("F", "finished"), ("O", "open"), ("P", "partial"))


@query(
    "values_relation",
    f"SELECT v.label, count(*) AS n FROM orders JOIN (VALUES {', '.join(map(str, STATUS))}) AS v(status, label) ON o_orderstatus = v.status GROUP BY 1",
)
def values_relation(spark, sf_dir):
    values = spark.createDataFrame(STATUS, "status string, label string")
    orders = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return orders.join(values, orders["o_orderstatus"] == values["status"]).select("label", "n")


@query("star_expansion", "SELECT r.*, n_name FROM region r JOIN nation ON n_regionkey = r_regionkey")
def star_expansion(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    return region.join(nation, region["r_regionkey"] == nation["n_regionkey"]).select(*[region[c] for c in region.columns], "n_name")


@query(
    "delete_using_rewrite",
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')",
)
def delete_using_rewrite(spark, sf_dir):
    """What DELETE … USING leaves."""
    gone = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(gone, "o_custkey", "left_anti").select("o_orderkey")


@query(
    "having_against_column",
    "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY p_brand, p_size HAVING count(*) > p_size",
)
def having_against_column(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n")).where("n > p_size")


@query(
    "quoted_identifiers",
    "SELECT p_brand AS name, NOT regexp_full_match(p_brand, '[a-z_][a-z0-9_$]*') AS quoted, count(*) AS n FROM part GROUP BY 1",
)
def quoted_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), C.needs_quotes(F.col("p_brand")).alias("quoted")).agg(F.count(F.lit(1)).alias("n"))


@query("sanitized_texts", r"SELECT doc_id, left(regexp_replace(text, '[\x00-\x1F\x7F-\x9F]', ' ', 'g'), 2048) AS comment FROM documents")
def sanitized_texts(spark, sf_dir):
    """A comment's first 2,048 characters are what the feature shows."""
    return table(spark, sf_dir, "documents").select("doc_id", C.sanitized(F.col("text")).alias("comment"))


@query(
    "hex_of_names",
    r"SELECT p_partkey, '\x' || lower(hex(left(p_name, 4))) || CASE WHEN octet_length(encode(p_name)) > 4 THEN '…' ELSE '' END AS hex FROM part",
)
def hex_of_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.capped_hex(F.col("p_name").cast("binary"), 4).alias("hex"))


@query(
    "similar_brands",
    """WITH b AS (SELECT DISTINCT lower(p_brand) AS x FROM part), p AS (SELECT x, left(x, 6) AS a FROM b)
       SELECT x, CASE WHEN a = x THEN 1.0 WHEN starts_with(x, a) THEN 0.28 ELSE 0.0 END::DOUBLE AS by_prefix FROM p""",
)
def similar_brands(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_brand").alias("x")).distinct()
    return names.select("x", C.similarity(F.left("x", F.lit(6)), F.col("x")).alias("by_prefix"))
