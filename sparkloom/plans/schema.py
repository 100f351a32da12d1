"""The catalog, search for tables and paths to columns, with oracles over the same constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import retrieval, schema_search
from sparkloom.plans.registry import query
from sparkloom.sources import catalog
from sparkloom.sources.tables import TABLES, table


def _values(rows) -> str:
    quoted = [[str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row] for row in rows]
    return "VALUES " + ", ".join(f"({', '.join(row)})" for row in quoted)


_TYPE = "CASE column_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(column_type) END"
_COLS = "cols(t, p, c, ty) AS (" + " UNION ALL ".join(f"SELECT '{t}', row_number() OVER (), column_name, {_TYPE} FROM (DESCRIBE {t})" for t in TABLES) + ")"
_FKS = f"fk(a, x, b, y) AS ({_values(catalog.FOREIGN_KEYS)})"
_KEYS = "key(t, n, kind, p, c) AS (" + _values([(t, n, kind, k + 1, c) for t, n, kind, cols in catalog.KEYS for k, c in enumerate(cols)]) + ")"
_LITERALS = "list_transform(regexp_extract_all(e, '''((?:''''|[^''])*)''', 1), lambda v: replace(v, '''''', ''''))"
_CHECKS = f"""raw(t, c, n, e) AS ({_values(catalog.CHECKS)}), lit AS (SELECT *, {_LITERALS} AS l, lower(regexp_replace(e, '''(?:''''|[^''])*''', '''''', 'g')) AS o FROM raw),
  chk AS (SELECT t, c, n, e, CASE WHEN (regexp_matches(lower(e), '\\bin\\s*\\(') OR regexp_matches(lower(e), '=\\s*any\\s*\\(\\s*array\\s*\\[') OR regexp_matches(lower(e), '=\\s*'''))
    AND NOT regexp_matches(o, '[<>]|!=|!~|\\bnot\\b') THEN list_filter(l, lambda v, i: list_position(l, v) = i) ELSE [] END AS allowed FROM lit)"""


@query("key_constraints", f"WITH {_KEYS} SELECT t AS table_name, n AS constraint_name, kind, string_agg(c, ',' ORDER BY p) AS columns FROM key GROUP BY 1, 2, 3")
def key_constraints(spark, sf_dir):
    return catalog.grouped_keys(catalog.keys(spark)).withColumn("columns", F.array_join("columns", ","))


@query("check_constraints", f"WITH {_CHECKS} SELECT t AS table_name, c AS column_name, n AS constraint_name, e AS expression, array_to_string(allowed, '|') AS allowed, len(allowed) = 0 AS unparsed FROM chk")
def check_constraints(spark, sf_dir):
    return catalog.constraints(catalog.checks(spark)).withColumn("allowed", F.array_join("allowed", "|"))


@query(
    "values_outside_checks",
    """SELECT 'orders' AS table_name, o_orderstatus AS value, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 2
       UNION ALL SELECT 'lineitem', l_linestatus, count(*) FROM lineitem WHERE l_linestatus NOT IN ('F', 'O') GROUP BY 2
       UNION ALL SELECT 'lineitem', l_returnflag, count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R') GROUP BY 2
       UNION ALL SELECT 'conversations', role, count(*) FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY 2""",
)
def values_outside_checks(spark, sf_dir):
    """Values of constrained columns that their CHECK doesn't list; the lists come from the catalog's few rows."""
    out = None
    for t, c, allowed in [(r["table_name"], r["column_name"], r["allowed"]) for r in catalog.checks(spark).where(F.size("allowed") > 0).collect()]:
        rows = table(spark, sf_dir, t).where(~F.col(c).isin(*allowed)).groupBy(F.lit(t).alias("table_name"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "assembled_catalog",
    f"""WITH {_COLS}, {_KEYS}, {_FKS}, {_CHECKS} SELECT t AS table_name, count(*) AS column_count, string_agg(c, ',' ORDER BY p) AS column_names,
       coalesce((SELECT count(DISTINCT n) FROM key WHERE key.t = cols.t), 0) AS key_count, coalesce((SELECT count(*) FROM fk WHERE a = cols.t), 0) AS fk_count,
       coalesce((SELECT count(*) FROM chk WHERE chk.t = cols.t), 0) AS check_count FROM cols GROUP BY t""",
)
def assembled_catalog(spark, sf_dir):
    all_ = catalog.assembled(catalog.columns(spark, sf_dir), catalog.keys(spark), catalog.foreign_keys(spark), catalog.checks(spark))
    counts = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for c, n in (("columns", "column_count"), ("keys", "key_count"), ("foreign_keys", "fk_count"), ("checks", "check_count"))]
    # size(null) is -1 or null by setting: nulls become empty arrays first
    filled = all_.select("table_name", *[F.when(F.col(c).isNotNull(), F.col(c)).alias(c) for c in ("columns", "keys", "foreign_keys", "checks")])
    return filled.select("table_name", F.array_join(F.col("columns.column_name"), ",").alias("column_names"), *[F.greatest(F.lit(0), c).alias(n) for c, n in zip(counts, ("column_count", "key_count", "fk_count", "check_count"), strict=True)])


_ORDERED = """ends AS (SELECT a AS t, x AS c FROM fk UNION SELECT b, y FROM fk), ordered AS (SELECT t, p, c, CASE WHEN t || '.' || c = 'lineitem.l_tax' THEN 0
    WHEN EXISTS (SELECT 1 FROM key k WHERE k.t = cols.t AND k.c = cols.c AND kind = 'primary') THEN 1 WHEN EXISTS (SELECT 1 FROM key k WHERE k.t = cols.t AND k.c = cols.c) THEN 2
    WHEN EXISTS (SELECT 1 FROM ends e WHERE e.t = cols.t AND e.c = cols.c) THEN 3 WHEN NOT regexp_full_match(c, '[a-z_][a-z0-9_$]*') THEN 4
    WHEN EXISTS (SELECT 1 FROM chk h WHERE h.t = cols.t AND h.c = cols.c AND len(allowed) > 0) THEN 5
    WHEN regexp_matches(ty, 'date|time') OR regexp_matches(lower(c), 'date|time|created|scheduled|_at$') OR regexp_matches(lower(c), '^(name|slug|label|title)$|_(name|slug|label)$|status') THEN 6
    ELSE 8 END AS pri FROM cols)"""


def _column_order(spark, sf_dir):
    cols = catalog.columns(spark, sf_dir)
    return catalog.column_order(cols, catalog.keys(spark), catalog.foreign_keys(spark), catalog.checks(spark), ("lineitem.l_tax",))


@query("column_priorities", f"WITH {_COLS}, {_KEYS}, {_FKS}, {_CHECKS}, {_ORDERED} SELECT t AS table_name, c AS column_name, pri AS priority FROM ordered")
def column_priorities(spark, sf_dir):
    return _column_order(spark, sf_dir).select("table_name", "column_name", "priority")


@query(
    "table_cards",
    f"""WITH {_COLS}, {_KEYS}, {_FKS}, {_CHECKS}, {_ORDERED}, r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY pri, p, c) AS place FROM ordered)
       SELECT t AS table_name, c AS column_name, place FROM r WHERE place <= 3 OR EXISTS (SELECT 1 FROM ends e WHERE e.t = r.t AND e.c = r.c)""",
)
def table_cards(spark, sf_dir):
    return catalog.table_cards(_column_order(spark, sf_dir), catalog.foreign_keys(spark), 3)


@query("tables_named_like", f"WITH {_COLS} SELECT DISTINCT t AS table_name FROM cols WHERE contains(lower(t), 'er')")
def tables_named_like(spark, sf_dir):
    return catalog.named_like(catalog.columns(spark, sf_dir).select("table_name").distinct(), "ER")


def _tokens(x: str) -> str:
    spaced = rf"regexp_replace({x}, '([\p{{Ll}}\p{{Nd}}])(\p{{Lu}})', '\1 \2', 'g')"
    for a, b in ((r"\p{L}", r"\p{Nd}"), (r"\p{Nd}", r"\p{L}")):
        spaced = rf"regexp_replace({spaced}, '({a})({b})', '\1 \2', 'g')"
    singular = (
        "CASE WHEN ends_with(w, 'ies') AND len(w) > 4 THEN left(w, len(w) - 3) || 'y' WHEN ends_with(w, 'es') AND len(w) > 4 THEN left(w, len(w) - 2)"
        " WHEN ends_with(w, 's') AND len(w) > 3 THEN left(w, len(w) - 1) END"
    )
    words = rf"list_filter(string_split_regex(lower({spaced}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(list_filter(flatten(list_transform({words}, lambda w: [w, {singular}])), lambda v: v IS NOT NULL))"


_S = schema_search.SCHEMA
_TERMS = f"""{_COLS}, {_KEYS}, {_FKS}, {_CHECKS}, ends AS (SELECT a AS t, b AS other, a || '_' || x || '_fkey' AS fk, x || ' ' || y AS pair FROM fk),
  both_ends AS (SELECT * FROM ends UNION ALL SELECT other, t, fk, pair FROM ends),
  entry(t, f, o, x) AS (SELECT DISTINCT t, 'table_qualified', t, '{_S}.' || t FROM cols UNION ALL SELECT DISTINCT t, 'table', t, t FROM cols UNION ALL SELECT DISTINCT t, 'schema', '{_S}', '{_S}' FROM cols
    UNION ALL SELECT t, 'table_comment', t, x FROM ({_values(catalog.COMMENTS)}) AS m(t, x) UNION ALL SELECT t, 'column', t || '.' || c, c FROM cols UNION ALL SELECT t, 'type', t || '.' || c, ty FROM cols
    UNION ALL SELECT t, 'value', t || '.' || c, unnest(allowed) FROM chk UNION ALL SELECT t, 'value', t || '.' || c, e FROM chk UNION ALL SELECT t, 'constraint', t || '.' || c, n FROM chk
    UNION ALL SELECT t, 'constraint', n, n FROM key UNION ALL SELECT t, 'key_column', n, c FROM key UNION ALL SELECT t, 'constraint', fk, fk FROM both_ends
    UNION ALL SELECT t, 'connected_table', fk, other FROM both_ends UNION ALL SELECT t, 'neighbour_schema', fk, '{_S}' FROM both_ends UNION ALL SELECT t, 'connected_columns', fk, pair FROM both_ends),
  terms AS (SELECT DISTINCT t, f, o, unnest({_tokens("x")}) AS w FROM entry)"""


@query("schema_terms", f"WITH {_TERMS} SELECT t AS table_name, f AS field, o AS object_id, w AS term FROM terms")
def schema_terms(spark, sf_dir):
    return schema_search.terms(spark, sf_dir)


def _search_sql(asked: str, context: str, rest: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in schema_search.STOPWORDS) + "]"
    fields = _values([(f, *(str(x) for x in v)) for f, v in schema_search.FIELDS.items()])

    def asked_tokens(text: str) -> str:
        literal = "'" + text.replace("'", "''") + "'"
        return f"SELECT unnest(list_filter({_tokens(literal)}, lambda z: NOT list_contains({stop}, z))) AS w"

    def holds(text: str, name: str) -> str:
        return f"regexp_matches(' {text} ', '[^\\p{{L}}\\p{{N}}_$.]' || {name} || '[^\\p{{L}}\\p{{N}}_$]')"

    full = f"'{_S}[.]' || t"
    checks = [(holds(asked, full), 30, 3), (holds(asked, "t"), 12, 2), (holds(asked.lower(), full), 18, 2), (holds(asked.lower(), "t"), 7, 1)]
    by_name = " + ".join(f"CASE WHEN {c} THEN {s} ELSE 0 END" for c, s, _ in checks)
    quality = ", ".join(f"CASE WHEN {c} THEN {q} ELSE 0 END" for c, _, q in checks)
    alike = """CASE WHEN q.w = s.w THEN 1.0 WHEN len(q.w) < 3 OR len(s.w) < 3 THEN 0.0 WHEN starts_with(s.w, q.w) OR starts_with(q.w, s.w) THEN 0.28
      WHEN len(q.w) >= 4 AND contains(s.w, q.w) THEN 0.16 WHEN len(q.w) >= 6 AND len(s.w) >= 6 AND levenshtein(q.w, s.w) = 1 THEN 0.42
      WHEN len(q.w) >= 9 AND len(s.w) >= 9 AND levenshtein(q.w, s.w) = 2 THEN 0.24 ELSE 0.0 END::DOUBLE"""
    return f"""WITH {_TERMS}, q AS ({asked_tokens(asked)}), heard AS ({asked_tokens(context)}), fields AS (SELECT f, a::DOUBLE AS a, b::DOUBLE AS b, k::DOUBLE AS k FROM ({fields}) AS x(f, a, b, k)),
      n AS (SELECT t, w, f, count(*)::DOUBLE AS n FROM terms GROUP BY ALL), tf AS (SELECT t, w, least(sum(least(n, b) * a), 18.0) AS tf FROM n JOIN fields USING (f) GROUP BY t, w),
      len AS (SELECT t, least(count(*), 120)::DOUBLE AS len FROM terms GROUP BY t), st AS (SELECT count(*) AS docs, greatest(avg(len), 1.0) AS mean FROM len),
      df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
      s AS (SELECT t, w, docs, df, ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.38 + 0.62 * len / mean)) AS bm FROM tf JOIN df USING (w) JOIN len USING (t), st),
      met AS (SELECT t, q.w AS q, bm, {alike} AS alike FROM s, q), best AS (SELECT t, q, coalesce(max(bm) FILTER (WHERE alike = 1), max(bm * alike * 0.35)) AS v FROM met WHERE alike > 0 GROUP BY t, q),
      lex AS (SELECT t, sum(v) AS lexical, list(q) AS matched FROM best GROUP BY t),
      words AS (SELECT t, least(sum(CASE f WHEN 'table' THEN 0.9 ELSE 0.55 END), 2.4)::DOUBLE AS words FROM terms JOIN q USING (w) WHERE f IN ('table', 'table_qualified') GROUP BY t),
      direct AS (SELECT t, ({by_name}) + coalesce(words, 0) AS exact, greatest({quality}) AS quality, coalesce(lexical, 0) AS lexical, matched FROM (SELECT DISTINCT t FROM cols) LEFT JOIN lex USING (t) LEFT JOIN words USING (t)),
      top20 AS (SELECT *, row_number() OVER (ORDER BY round(exact + lexical, 9) DESC, quality DESC, t) - 1 AS i FROM direct WHERE exact > 0 OR lexical > 0 QUALIFY i < 20),
      edge AS (SELECT t, other, fk FROM both_ends), deg AS (SELECT t, greatest(1, least(count(*), 8)) AS deg FROM edge GROUP BY t),
      near AS (SELECT edge.t, other, i, deg, row_number() OVER (PARTITION BY edge.t ORDER BY other, fk) AS k FROM edge JOIN top20 ON top20.t = edge.t AND i < 5 AND exact + lexical > 0.8 JOIN deg ON deg.t = edge.t),
      graph AS (SELECT other AS t, max(least(1.2 / deg, 0.65) * pow(0.78, i)) AS graph FROM near WHERE k <= 12 AND other <> t GROUP BY 1),
      ctx AS (SELECT t, least(sum(wt * greatest(0.12, ln((docs + 1) / (df + 1))) * 0.72), 6.0) AS context FROM
        (SELECT t, w, least(sum(k), 3.2) AS wt FROM terms JOIN heard USING (w) JOIN fields USING (f) WHERE len(w) >= 3 GROUP BY t, w) JOIN s USING (t, w) GROUP BY t),
      found AS (SELECT t, coalesce(exact, 0) AS exact, coalesce(quality, 0) AS quality, coalesce(lexical, 0) AS lexical, coalesce(context, 0) AS context, coalesce(graph, 0) AS graph, matched,
        round(coalesce(exact, 0) + coalesce(lexical, 0) + coalesce(context, 0) + coalesce(graph, 0), 9) AS total FROM top20 FULL JOIN graph USING (t) LEFT JOIN ctx USING (t)),
      ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY total DESC, quality DESC, t) AS INT) AS rank FROM found WHERE total > 0) {rest}"""


_HITS = "SELECT rank, t AS table_name, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("total", "exact", "lexical", "context", "graph")) + " FROM ranked WHERE rank <= 8"
_RESPONSE = """, c AS (SELECT count(*) FILTER (WHERE w IN (SELECT unnest(matched) FROM ranked WHERE rank <= 8)) / count(*) AS c FROM q), m AS (SELECT max(total) FILTER (WHERE rank = 1) AS a, max(total) FILTER (WHERE rank = 2) AS b,
  coalesce(max(quality) > 0, false) AS e FROM ranked) SELECT round(c, 4) AS coverage, round(a - b, 4) AS margin, e AS exact_match, a IS NULL OR (NOT e AND (a < 1.2 OR c < 0.25)) AS no_strong_match FROM c, m"""
#: What is asked, and the context that is known.
ASKED = {
    "search": ("status of customer orders by market segment", "suppliers ship parts to nations"),
    "approximate": ("custommer shipdates and discouns", ""),
    "qualified": ("rows of main.Lineitem with returnflag", "orders"),
    "weak": ("photosynthesis", ""),
}


def _found(spark, sf_dir, asked, context):
    # a few hundred rows that the scores read many times
    index = schema_search.terms(spark, sf_dir).coalesce(1).persist()
    return schema_search.candidates(index, catalog.foreign_keys(spark), asked, context)


for _name, (_asked, _context) in ASKED.items():
    if _name != "weak":
        query(f"schema_{_name}_hits", _search_sql(_asked, _context, _HITS))(lambda spark, sf_dir, a=_asked, c=_context: schema_search.hits(_found(spark, sf_dir, a, c)))
    if _name in ("search", "weak"):
        query(f"schema_{_name}_response", _search_sql(_asked, _context, _RESPONSE))(
            lambda spark, sf_dir, a=_asked, c=_context: schema_search.response(_found(spark, sf_dir, a, c), a)
        )


@query(
    "paths_to_missing_column",
    f"""WITH {_COLS}, {_FKS}, e(a, b, p) AS (SELECT a, b, a || '.' || x || '=' || b || '.' || y FROM fk UNION ALL SELECT b, a, b || '.' || y || '=' || a || '.' || x FROM fk),
      own AS (SELECT t FROM cols WHERE c = 'n_name'), r(f) AS (VALUES ('orders'), ('supplier')),
      p AS (SELECT f, 1 AS hops, b, p AS path FROM r JOIN e ON a = f UNION ALL SELECT f, 2, e2.b, e1.p || ' > ' || e2.p FROM r JOIN e e1 ON e1.a = f JOIN e e2 ON e2.a = e1.b
        WHERE e2.b NOT IN (e1.a, e1.b) AND e1.b NOT IN (SELECT t FROM own))
      SELECT f AS from_table, t AS to_table, hops, path FROM p JOIN own ON t = b QUALIFY row_number() OVER (PARTITION BY f, t ORDER BY hops, path) <= 2""",
)
def paths_to_missing_column(spark, sf_dir):
    """For a column that the referenced tables lack: the ways to the tables that own it."""
    return retrieval.paths_to_column(catalog.columns(spark, sf_dir), catalog.foreign_keys(spark), "n_name", ["orders", "supplier"])


@query(
    "packed_catalog",
    f"""WITH RECURSIVE {_COLS}, s AS (SELECT t, sum(len(c) + 1) AS size, row_number() OVER (ORDER BY t) AS k FROM cols GROUP BY t),
      g(k, used, taken) AS (SELECT 0::BIGINT, 0::HUGEINT, NULL::VARCHAR UNION ALL SELECT s.k, CASE WHEN used + size <= 200 THEN used + size ELSE used END, CASE WHEN used + size <= 200 THEN t END FROM g JOIN s ON s.k = g.k + 1)
      SELECT taken AS table_name FROM g WHERE taken IS NOT NULL""",
)
def packed_catalog(spark, sf_dir):
    """Tables by name while their columns fit into 200 characters; one that doesn't is passed over."""
    sizes = catalog.columns(spark, sf_dir).groupBy("table_name").agg(F.sum(F.length("column_name") + 1).alias("size"))
    return retrieval.packed(sizes, "table_name", "size", ["table_name"], 200).select("table_name")


_IDS = ["orders", "orders.o_orderdate", "conversations_pkey", "lineitem_l_partkey_fkey", "orders_status_check", "nothing"]


@query(
    "described_objects",
    f"""WITH {_COLS}, {_KEYS}, {_FKS}, {_CHECKS}, obj(kind, id, d) AS (SELECT 'table', t, string_agg(c, ', ' ORDER BY p) FROM cols GROUP BY t UNION ALL SELECT 'column', t || '.' || c, ty FROM cols
      UNION ALL SELECT 'key', n, kind || ' key of ' || t || ': ' || string_agg(c, ', ' ORDER BY p) FROM key GROUP BY t, n, kind
      UNION ALL SELECT 'foreign_key', a || '_' || x || '_fkey', a || '.' || x || ' = ' || b || '.' || y FROM fk UNION ALL SELECT 'check', n, e FROM chk)
      SELECT i AS object_id, kind, d AS description FROM (SELECT unnest({_IDS}) AS i) LEFT JOIN obj ON id = i""",
)
def described_objects(spark, sf_dir):
    all_ = catalog.objects(catalog.columns(spark, sf_dir), catalog.keys(spark), catalog.foreign_keys(spark), catalog.checks(spark))
    return catalog.describe(all_, _IDS)


@query("named_relations", "SELECT event_id, 'main.orders ' || lower(event_type) || '_log nation' AS names FROM events")
def named_relations(spark, sf_dir):
    text = F.concat(F.lit('select order_id from "main" . "Orders" join '), "event_type", F.lit("_log using (id); update Nation set x = 1; DELETE FROM main.orders"))
    names = schema_search.relation_names(text)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(names, " ").alias("names"))


@query(
    "join_path_pairs",
    """SELECT hops, pair, CAST(position AS INT) AS position FROM (VALUES (2, 1, 'customer.c_nationkey=nation.n_nationkey'), (2, 2, 'nation.n_nationkey=supplier.s_nationkey'),
       (3, 1, 'customer.c_custkey=orders.o_custkey'), (3, 2, 'orders.o_orderkey=lineitem.l_orderkey'), (3, 3, 'lineitem.l_suppkey=supplier.s_suppkey')) AS v(hops, position, pair)""",
)
def join_path_pairs(spark, sf_dir):
    """The pairs of columns of at most three paths between two tables, with the number of hops."""
    paths = retrieval.join_paths(catalog.foreign_keys(spark), "customer", "supplier", most_paths=3)
    return paths.select("hops", F.posexplode(F.split("path", " > ")).alias("k", "pair")).select("hops", "pair", (F.col("k") + 1).alias("position"))
