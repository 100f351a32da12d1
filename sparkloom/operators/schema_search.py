"""Ranked search for tables over the catalog: weighted fields, approximate terms, exact names, boosts from context and
from neighbours. Index and scores are joins and aggregates; the query's words are a literal array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import needs_quotes, search_tokens, similarity
from sparkloom.operators.retrieval import B, K1, MOST_COUNT
from sparkloom.sources import catalog

#: By field: weight, cap of its count, weight in context (fixed values).
FIELDS = {
    "table_qualified": (9.0, 1.0, 1.15),
    "table": (8.0, 1.0, 1.05),
    "column": (8.0, 1.15, 1.25),
    "table_comment": (5.0, 2.0, 0.85),
    "column_comment": (5.0, 2.0, 0.85),
    "key_column": (5.0, 1.5, 0.65),
    "value": (3.0, 1.5, 0.65),
    "constraint": (3.0, 1.0, 0.22),
    "connected_table": (3.0, 1.0, 0.04),
    "connected_columns": (3.0, 1.0, 0.3),
    "type": (1.0, 1.0, 0.03),
    "schema": (1.0, 1.0, 0.03),
    "neighbour_schema": (1.0, 1.0, 0.03),
}
#: Words that a query doesn't search for (fixed values).
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "get", "give", "in", "is", "it", "last", "list", "me", "most", "of", "on",
    "or", "over", "per", "show", "that", "the", "these", "this", "to", "top", "what", "which", "with",
)
SCHEMA, LONGEST = "main", 120


def _by_field(which: int) -> Column:
    pairs = [F.lit(x) for field, values in FIELDS.items() for x in (field, values[which])]
    return F.create_map(*pairs)[F.col("field")]


def query_tokens(text: str) -> Column:
    return F.array_except(search_tokens(F.lit(text)), F.array(*map(F.lit, STOPWORDS)))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: (table_name, field, object_id, term), each once."""
    cols, fks, checks = catalog.columns(spark, sf_dir), catalog.foreign_keys(spark), catalog.checks(spark)
    column_id = F.concat_ws(".", "table_name", "column_name").alias("object_id")

    def entry(rows: DataFrame, field: str, text: Column | str, object_id: Column | str = "table_name") -> DataFrame:
        return rows.select("table_name", F.lit(field).alias("field"), (F.col(object_id) if isinstance(object_id, str) else object_id).alias("object_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))

    tables = cols.select("table_name").distinct()
    ends = fks.select(F.col("from_table").alias("table_name"), F.col("to_table").alias("other"), F.concat_ws("_", "from_table", "from_column", F.lit("fkey")).alias("fk"), F.concat_ws(" ", "from_column", "to_column").alias("pair"))
    both = ends.unionByName(ends.select(F.col("other").alias("table_name"), F.col("table_name").alias("other"), "fk", "pair"))
    keys = catalog.keys(spark)
    parts = [
        entry(tables, "table_qualified", F.concat(F.lit(f"{SCHEMA}."), F.col("table_name"))),
        entry(tables, "table", "table_name"),
        entry(tables, "schema", F.lit(SCHEMA), F.lit(SCHEMA)),
        entry(catalog.comments(spark), "table_comment", "comment"),
        entry(cols, "column", "column_name", column_id),
        entry(cols, "type", "type", column_id),
        entry(checks.select("table_name", "column_name", F.explode("allowed").alias("listed")), "value", "listed", column_id),
        entry(checks, "value", "expression", column_id),
        entry(checks, "constraint", "constraint_name", column_id),
        entry(keys, "constraint", "constraint_name", "constraint_name"),
        entry(keys, "key_column", "column_name", "constraint_name"),
        entry(both, "constraint", "fk", "fk"),
        entry(both, "connected_table", "other", "fk"),
        entry(both, "neighbour_schema", F.lit(SCHEMA), "fk"),
        entry(both, "connected_columns", "pair", "fk"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("table_name", "field", "object_id", F.explode(search_tokens(F.col("text"))).alias("term")).distinct()


def term_scores(index: DataFrame) -> DataFrame:
    """(table_name, term, docs, df, bm25) of every term, whatever is asked."""
    by_field = index.groupBy("table_name", "term", "field").agg(F.count(F.lit(1)).cast("double").alias("n"))
    tf = F.least(F.sum(F.least("n", _by_field(1)) * _by_field(0)), F.lit(float(MOST_COUNT)))
    counted = by_field.groupBy("table_name", "term").agg(tf.alias("tf"))
    lengths = index.groupBy("table_name").agg(F.least(F.count(F.lit(1)), F.lit(LONGEST)).cast("double").alias("length"))
    stats = lengths.agg(F.count(F.lit(1)).alias("docs"), F.greatest(F.avg("length"), F.lit(1.0)).alias("mean"))
    df = counted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row of statistics
    joined = counted.join(df, "term").join(lengths, "table_name").join(F.broadcast(stats))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    return joined.select("table_name", "term", "docs", "df", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)).alias("bm25"))


def candidates(index: DataFrame, fks: DataFrame, asked: str, context: str = "", first: int = 20) -> DataFrame:
    """Tables that may answer ``asked``, with all parts of their score: (table_name, exact, quality, lexical,
    context, graph, total, matched).

    lexical: a query word counts by its own term, or else by the best approximate one at .35 of its similarity.
    exact: the table's name in the query, 30 qualified and 12 bare, 18 and 7 more without regard to case, and
    .55 and .9 a word of the name, 2.4 at most. graph: neighbours of the five best tables. context: words of
    ``context`` of three letters or more by their rarity. Only the ``first`` best by exact and lexical score and
    the neighbours stay."""
    tokens, scored = query_tokens(asked), term_scores(index)
    met = scored.withColumn("asked", F.explode(tokens)).withColumn("alike", similarity(F.col("asked"), F.col("term"))).where("alike > 0")
    same = F.col("alike") == 1
    value = F.when(same, F.col("bm25")).otherwise(F.col("bm25") * F.col("alike") * 0.35)
    best = met.groupBy("table_name", "asked").agg(F.max(F.struct(same.alias("same"), value.alias("value"))).alias("best"))
    lexical = best.groupBy("table_name").agg(F.sum("best.value").alias("lexical"), F.array_sort(F.collect_set("asked")).alias("matched"))

    tables = index.select("table_name").distinct()
    blind = F.lit('"' in asked) | (F.lit(asked.strip()).rlike(r"^[\p{L}\p{N}._$]+$") & needs_quotes(F.col("table_name")))
    named = index.where(F.col("field").isin("table", "table_qualified") & F.array_contains(tokens, F.col("term")) & ~blind)
    worth = F.when(F.col("field") == "table", 0.9).otherwise(0.55)
    words = named.groupBy("table_name").agg(F.least(F.sum(worth), F.lit(2.4)).alias("words"))

    def holds(text: str, name: Column) -> Column:
        pattern = F.concat(F.lit(r"[^\p{L}\p{N}_$.]\Q"), name, F.lit(r"\E[^\p{L}\p{N}_$]"))
        return F.rlike(F.lit(f" {text} "), pattern)

    full, bare = F.concat(F.lit(f"{SCHEMA}."), F.col("table_name")), F.col("table_name")
    hits = [
        (holds(asked, full), 30.0, 3), (holds(asked, bare), 12.0, 2),
        (holds(asked.lower(), F.lower(full)), 18.0, 2), (holds(asked.lower(), F.lower(bare)), 7.0, 1),
    ]
    by_name = sum((F.when(hit, score).otherwise(0.0) for hit, score, _ in hits), F.lit(0.0))
    quality = F.greatest(*[F.when(hit, q).otherwise(0) for hit, _, q in hits])
    direct = tables.join(lexical, "table_name", "left").join(words, "table_name", "left").select(
        "table_name", (by_name + F.coalesce("words", F.lit(0.0))).alias("exact"), quality.alias("quality"), F.coalesce("lexical", F.lit(0.0)).alias("lexical"), "matched"
    )
    order = [F.desc(F.round(F.col("exact") + F.col("lexical"), 9)), F.desc("quality"), F.asc("table_name")]
    top = direct.where("exact > 0 OR lexical > 0").orderBy(*order).limit(first)
    # a window over at most ``first`` rows
    anchors = top.withColumn("offset", F.row_number().over(Window.orderBy(*order)) - 1).where("offset < 5 AND exact + lexical > 0.8").select("table_name", "offset")

    name = F.concat_ws("_", "from_table", "from_column", F.lit("fkey")).alias("fk")
    edges = fks.select(F.col("from_table").alias("table_name"), F.col("to_table").alias("other"), name)
    edges = edges.union(fks.select("to_table", "from_table", name))
    degree = edges.groupBy("table_name").agg(F.greatest(F.lit(1), F.least(F.count(F.lit(1)), F.lit(8))).alias("degree"))
    near = edges.join(F.broadcast(anchors), "table_name").join(degree, "table_name")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("table_name").orderBy("other", "fk"))).where("k <= 12 AND other <> table_name")
    graph = near.groupBy(F.col("other").alias("table_name")).agg(F.max(F.least(1.2 / F.col("degree"), F.lit(0.65)) * F.pow(F.lit(0.78), F.col("offset"))).alias("graph"))

    heard = index.where(F.array_contains(query_tokens(context), F.col("term")) & (F.length("term") >= 3))
    by_term = heard.groupBy("table_name", "term").agg(F.least(F.sum(_by_field(2)), F.lit(3.2)).alias("weight"))
    rarity = F.greatest(F.lit(0.12), F.log((F.col("docs") + 1) / (F.col("df") + 1)))
    boosts = by_term.join(scored, ["table_name", "term"]).groupBy("table_name").agg(F.least(F.sum(F.col("weight") * rarity * 0.72), F.lit(6.0)).alias("context"))

    kept = top.join(graph, "table_name", "full").join(tables, "table_name", "left_semi").join(boosts, "table_name", "left")
    zero = {c: 0.0 for c in ("exact", "lexical", "context", "graph")} | {"quality": 0}
    total = F.round(F.col("exact") + F.col("lexical") + F.col("context") + F.col("graph"), 9)
    return kept.na.fill(zero).withColumn("total", total).where("total > 0")


def hits(found: DataFrame, limit: int = 8) -> DataFrame:
    """(rank, table_name, total, exact, lexical, context, graph) of the best ``limit``: by score, quality of the name's
    match, and name."""
    order = [F.desc("total"), F.desc("quality"), F.asc("table_name")]
    top = found.orderBy(*order).limit(limit)
    parts = [F.round(c, 4).alias(c) for c in ("total", "exact", "lexical", "context", "graph")]
    # a window over at most ``limit`` rows
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "table_name", *parts)


def response(found: DataFrame, asked: str, limit: int = 8) -> DataFrame:
    """One row: share of the query's words that the best tables match, margin of the first to the second (null for
    one), whether a name matched exactly, and whether nothing matched strongly."""
    asked_tokens = query_tokens(asked)
    best = found.orderBy(F.desc("total"), F.desc("quality"), F.asc("table_name")).limit(max(limit, 3))
    row = best.agg(F.sort_array(F.collect_list("total"), asc=False).alias("totals"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("matched", F.array().cast("array<string>"))))).alias("matched"))
    # one row each
    row = row.join(found.agg(F.coalesce(F.max("quality") > 0, F.lit(False)).alias("exact_match")))
    coverage = F.when(F.size(asked_tokens) == 0, 0.0).otherwise(F.size(F.array_intersect(asked_tokens, "matched")) / F.size(asked_tokens))
    first = F.coalesce(F.get("totals", F.lit(0)), F.lit(0.0))
    weak = (F.size("totals") == 0) | (~F.col("exact_match") & ((first < 1.2) | (coverage < 0.25)))
    return row.select(F.round(coverage, 4).alias("coverage"), F.round(first - F.get("totals", F.lit(1)), 4).alias("margin"), "exact_match", weak.alias("no_strong_match"))


def saved_terms(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The index as Parquet below ``folder``, under the fingerprint of the catalog that it was built from: another
    catalog is another index, and one without its _SUCCESS file was never finished and is built again."""
    version = catalog.fingerprint(catalog.columns(spark, sf_dir)).first()["fingerprint"]
    path = f"{folder.rstrip('/')}/terms-{version}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        terms(spark, sf_dir).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def relation_names(text: Column) -> Column:
    """The relations that a statement's text names after FROM, JOIN, UPDATE, INTO or DELETE FROM: lower case, without
    quotes and spaces, each once, in order."""
    name = r'(?:"[^"]+"|[A-Za-z_][A-Za-z0-9_$]*)'
    found = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:delete\s+from|from|join|update|into)\s+({name}(?:\s*\.\s*{name})?)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, '[" ]', ""))))
