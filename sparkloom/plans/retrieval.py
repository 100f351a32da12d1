"""Search and join paths over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators.retrieval import bm25, join_paths
from sparkloom.plans.registry import query
from sparkloom.sources.catalog import FOREIGN_KEYS, foreign_keys
from sparkloom.sources.tables import table


@query(
    "bm25_documents",
    """WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS t FROM documents),
    c AS (SELECT doc_id, len(t) AS length, least(18.0, len(list_filter(t, lambda w: w = 'the'))) AS a, least(18.0, len(list_filter(t, lambda w: w = 'der'))) AS b FROM d),
    s AS (SELECT count(*) AS n, avg(length) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
    SELECT doc_id, round(ln((n - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.38 + 0.62 * length / m))
      + ln((n - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.38 + 0.62 * length / m)), 4) AS score FROM c, s WHERE a > 0 OR b > 0""",
)
def bm25_documents(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    found = bm25(table(spark, sf_dir, "documents"), "doc_id", words, ["the", "der"])
    return found.select("doc_id", F.round("score", 4).alias("score"))


_EDGES = ", ".join(f"('{a}', '{b}', '{a}.{x}', '{b}.{y}'), ('{b}', '{a}', '{b}.{y}', '{a}.{x}')" for a, x, b, y in FOREIGN_KEYS)


@query(
    "fk_join_paths",
    f"""WITH RECURSIVE e(a, b, x, y) AS (VALUES {_EDGES}), p(hops, here, seen, path) AS (
      SELECT 1, b, [a, b], x || '=' || y FROM e WHERE a = 'customer' UNION ALL
      SELECT hops + 1, b, list_append(seen, b), path || ' > ' || x || '=' || y FROM p JOIN e ON e.a = here
      WHERE hops < 3 AND here <> 'part' AND NOT list_contains(seen, b))
    SELECT hops, path FROM p WHERE here = 'part' ORDER BY hops, path LIMIT 8""",
)
def fk_join_paths(spark, sf_dir):
    return join_paths(foreign_keys(spark), "customer", "part")
