"""Ranking of tables by points, pinned tables, compaction and texts that read as statements, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions.columns import DIRECT_SQL, direct_sql
from sparkloom.operators import schema_rank
from sparkloom.operators.schema_rank import Request
from sparkloom.plans.registry import query
from sparkloom.plans.schema import _CHECKS, _COLS, _FKS, _KEYS, _ORDERED, _column_order, _values
from sparkloom.sources import catalog
from sparkloom.sources.tables import table

PLAIN = Request("How many orders did each customer place last month", context="status of the shipments", bindings=("parts of a supplier",))
FAILED = Request(
    "discount of each part by nation", sql='SELECT * FROM main.orders o JOIN "parts" p ON true', forbidden=("parts",),
    diagnostic='42P01 relation "parts" does not exist', named="parts", missing_relation=True,
)


def _tokens(x: str) -> str:
    singular = "CASE WHEN ends_with(w, 'ies') AND len(w) > 3 THEN left(w, len(w) - 3) || 'y' WHEN ends_with(w, 's') AND len(w) > 3 THEN left(w, len(w) - 1) END"
    words = rf"list_filter(string_split_regex(lower(regexp_replace({x}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(list_filter(flatten(list_transform({words}, lambda w: [w, {singular}])), lambda v: v IS NOT NULL))"


def _ranked_sql(request: Request, used: str, temporal: bool, rest: str) -> str:
    def asked(*texts: str) -> str:
        return _tokens("'" + " ".join(texts).replace("'", "''") + "'")

    def hits(*texts: str) -> str:
        return f"len(list_intersect({asked(*texts)}, words))"

    refused = asked(*request.forbidden, request.named)
    return f"""WITH {_COLS}, {_FKS}, {_CHECKS},
      own AS (SELECT t, list_distinct(flatten(list({_tokens("c")}))) AS own, bool_or(regexp_matches(ty, 'date|time') OR regexp_matches(c, '_at$|date|time|scheduled')) AS temporal, count(*) AS n FROM cols GROUP BY t),
      listed AS (SELECT t, list_distinct(flatten(list({_tokens("x")}))) AS listed FROM (SELECT t, unnest(list_append(allowed, e)) AS x FROM chk) GROUP BY t),
      w AS (SELECT t, {_tokens("t")} AS nm, list_distinct(list_concat(['main'], {_tokens("t")}, own, coalesce(listed, []))) AS words, temporal, n FROM own LEFT JOIN listed USING (t)),
      h AS (SELECT t, len(list_intersect({asked(request.question, *request.searches)}, nm)) AS named, {hits(*request.bindings)} AS bound, list_contains({used}, t) AS referenced,
        len({refused}) > 0 AND len(list_intersect({refused}, nm)) >= greatest(1, len({refused}) - 1) AS replacement,
        len(list_intersect({asked(request.question, *request.searches)}, list_filter(words, lambda z: NOT list_contains(nm, z)))) AS by_column,
        {hits(request.context)} AS context, {hits(request.sql, *request.forbidden)} AS failed, {hits(request.diagnostic)} AS diagnosed, temporal, n FROM w),
      s AS (SELECT t, named > 0 AS named, bound > 0 AS bound, replacement, referenced, CAST(500 * referenced::INT + 150 * named + 50 * by_column + 100 * ({temporal} AND temporal)::INT + least(30 * context, 150)
        + least(70 * bound, 350) + 50 * failed + 80 * diagnosed + 900 * replacement::INT - least(n // 8, 30) AS BIGINT) AS score FROM h),
      e AS (SELECT a, b FROM fk UNION SELECT b, a FROM fk),
      lifted AS (SELECT * REPLACE (score + CASE WHEN neighbour THEN 80 ELSE 0 END AS score) FROM
        (SELECT *, score < 150 AND EXISTS (SELECT 1 FROM e JOIN s o ON o.t = e.b WHERE e.a = s.t AND o.score >= 150) AS neighbour FROM s)),
      ranked AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, t) AS INT) AS place, t AS table_name, score, named, bound, replacement, referenced, neighbour FROM lifted) {rest}"""


def _ranked(spark, sf_dir, request):
    return schema_rank.ranked(catalog.columns(spark, sf_dir), catalog.foreign_keys(spark), catalog.checks(spark), request)


@query("ranked_tables", _ranked_sql(PLAIN, "[]::VARCHAR[]", True, "SELECT * FROM ranked"))
def ranked_tables(spark, sf_dir):
    return _ranked(spark, sf_dir, PLAIN)


@query("ranked_tables_after_failure", _ranked_sql(FAILED, "['orders', 'parts']", False, "SELECT * FROM ranked"))
def ranked_tables_after_failure(spark, sf_dir):
    return _ranked(spark, sf_dir, FAILED)


@query("pinned_dominant", _ranked_sql(PLAIN, "[]::VARCHAR[]", True, "SELECT table_name FROM ranked r WHERE place = 1 AND score >= 140 AND (named OR bound) AND NOT EXISTS (SELECT 1 FROM ranked q WHERE q.place = 2 AND q.score >= 140 AND (q.named OR q.bound) AND r.score - q.score < 100)"))
def pinned_dominant(spark, sf_dir):
    return schema_rank.pinned(_ranked(spark, sf_dir, PLAIN), PLAIN, schema_rank.level(1000, PLAIN))


@query("pinned_after_failure", _ranked_sql(FAILED, "['orders', 'parts']", False, "SELECT table_name FROM ranked WHERE referenced OR place <= 3 AND replacement"))
def pinned_after_failure(spark, sf_dir):
    return schema_rank.pinned(_ranked(spark, sf_dir, FAILED), FAILED, schema_rank.level(9000, FAILED))


_TIMES = "[" + ", ".join(f"'{w}'" for w in schema_rank.TEMPORAL_WORDS) + "]"


@query("temporal_questions", f"SELECT conv_id, turn, list_has_any({_tokens("CASE WHEN turn % 3 = 1 THEN text || ' sinceYesterday' ELSE text END")}, {_TIMES}) AS temporal FROM conversations")
def temporal_questions(spark, sf_dir):
    x = F.when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" sinceYesterday"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", schema_rank.temporal_intent(x).alias("temporal"))


@query("temporal_columns", f"WITH {_COLS} SELECT t AS table_name, c AS column_name FROM cols WHERE regexp_matches(ty, 'date|time') OR regexp_matches(lower(c), '_at$|date|time|scheduled')")
def temporal_columns(spark, sf_dir):
    cols = catalog.columns(spark, sf_dir)
    return cols.where(schema_rank.temporal_column(F.col("column_name"), F.col("type"))).select("table_name", "column_name")


_HITS = [("lineitem", 1), ("orders", 2), ("customer", 3)]


def _cards(spark, sf_dir):
    hits = spark.createDataFrame(_HITS, "table_name string, hit int").coalesce(1)
    cards = catalog.table_cards(_column_order(spark, sf_dir), catalog.foreign_keys(spark).limit(0), 8)
    return cards.join(hits, "table_name")


for _name, _budget in (("compacted_columns", 150), ("compacted_hits", 30), ("compacted_to_the_last", 5)):
    query(
        _name,
        f"""WITH {_COLS}, {_KEYS}, {_FKS}, {_CHECKS}, {_ORDERED}, hit(t, hit) AS ({_values(_HITS)}), cards AS (SELECT hit, t, c, row_number() OVER (PARTITION BY t ORDER BY pri, p, c) AS place FROM ordered JOIN hit USING (t)),
          state(k, m, h) AS (VALUES (0, 8, 3), (1, 4, 3), (2, 2, 3), (3, 1, 3), (4, 1, 2), (5, 1, 1)), size AS (SELECT k, m, h, CAST(sum(strlen(t || '.' || c) + 1) AS BIGINT) AS bytes FROM cards JOIN state ON hit <= h AND place <= m GROUP BY ALL),
          best AS (SELECT * FROM size WHERE k = (SELECT coalesce(min(k) FILTER (WHERE bytes <= {_budget}), max(k)) FROM size))
          SELECT CAST(hit AS INT) AS hit, t AS table_name, place, c AS column_name, bytes, bytes <= {_budget} AS fits FROM cards, best WHERE hit <= h AND place <= m""",
    )(lambda spark, sf_dir, budget=_budget: schema_rank.compacted(_cards(spark, sf_dir), 8, 3, budget))


@query(
    "catalog_fingerprint",
    f"""WITH {_COLS}, {_FKS}, {_KEYS}, {_CHECKS}, line(l) AS (SELECT concat_ws(':', 'column', t, lpad(p::VARCHAR, 5, '0'), c, ty, 'true') FROM cols
        UNION ALL SELECT concat_ws(':', 'comment', t, x) FROM ({_values(catalog.COMMENTS)}) AS m(t, x)
        UNION ALL SELECT concat_ws(':', 'key', t, n, kind, string_agg(c, ',' ORDER BY p)) FROM key GROUP BY t, n, kind UNION ALL SELECT concat_ws(':', 'foreign', a, x, b, y) FROM fk
        UNION ALL SELECT concat_ws(':', 'check', t, c, n, e, array_to_string(allowed, ',')) FROM chk)
      SELECT sha256(string_agg(l, chr(10) ORDER BY l)) AS fingerprint FROM line""",
)
def catalog_fingerprint(spark, sf_dir):
    return catalog.retrieval_fingerprint(
        catalog.columns(spark, sf_dir), catalog.keys(spark), catalog.foreign_keys(spark), catalog.checks(spark), catalog.comments(spark)
    )


@query(
    "texts_that_are_sql",
    f"""WITH s AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN 'Update main."Orders" o SET x = ' || text WHEN 2 THEN 'selected ' || text ELSE 'delete from orders where ' || text END AS x FROM conversations)
      SELECT conv_id, turn, regexp_matches(x, '{DIRECT_SQL.replace("'", "''")}') AS is_sql FROM s""",
)
def texts_that_are_sql(spark, sf_dir):
    """Texts of conversations, with and without the beginning of a statement before them."""
    k, text = F.col("turn") % 4, F.col("text")
    x = F.when(k == 0, text).when(k == 1, F.concat(F.lit('Update main."Orders" o SET x = '), text)).when(k == 2, F.concat(F.lit("selected "), text)).otherwise(F.concat(F.lit("delete from orders where "), text))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", direct_sql(x).alias("is_sql"))
