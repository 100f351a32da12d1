"""Ranked search by fielded BM25, and join paths along foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Saturation, length norm and cap of term counts (fixed values).
K1, B, MOST_COUNT = 1.2, 0.62, 18


def bm25(docs: DataFrame, doc_id: str, tokens: Column, query_terms: list[str]) -> DataFrame:
    """(doc_id, score): the sum over terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean)),
    idf = ln((N - df + .5) / (df + .5) + 1), for documents with any of the terms.

    One pass counts the terms inside each document; no row a token is made. Statistics are two numbers
    and one count a query term."""
    terms = list(dict.fromkeys(query_terms))

    def count(term: str) -> Column:
        return F.least(F.lit(float(MOST_COUNT)), F.size(F.filter("tokens", lambda w: w == term)).cast("double"))

    tf = [count(t).alias(f"tf{k}") for k, t in enumerate(terms)]
    counted = docs.select(F.col(doc_id), tokens.alias("tokens")).select(doc_id, F.size("tokens").alias("length"), *tf)
    stats = counted.agg(
        F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))]
    )
    score = F.lit(0.0)
    for k in range(len(terms)):
        df = F.col(f"df{k}")
        idf = F.log((F.col("docs") - df + 0.5) / (df + 0.5) + 1)
        norm = K1 * (1 - B + B * F.col("length") / F.col("mean"))
        score = score + idf * F.col(f"tf{k}") * (K1 + 1) / (F.col(f"tf{k}") + norm)
    hit = F.greatest(F.lit(0.0), *[F.col(f"tf{k}") for k in range(len(terms))]) > 0
    return counted.where(hit).join(F.broadcast(stats)).select(doc_id, score.alias("score"))


def join_paths(keys: DataFrame, start: str, end: str, most_hops: int = 3, most_paths: int = 8) -> DataFrame:
    """(hops, path) of simple paths over foreign keys, walked both ways, shortest first, then by name.

    Each hop is one join of the frontier with the edges, and a table is entered once a path."""
    ahead = keys.select(F.col("from_table").alias("a"), F.col("to_table").alias("b"), F.concat_ws(".", "from_table", "from_column").alias("x"), F.concat_ws(".", "to_table", "to_column").alias("y"))
    edges = ahead.union(ahead.select("b", "a", "y", "x"))
    frontier = edges.where(F.col("a") == start).select(F.col("b").alias("at"), F.array("a", "b").alias("seen"), F.concat_ws("=", "x", "y").alias("path"))
    found = None
    for hops in range(1, most_hops + 1):
        done = frontier.where(F.col("at") == end).select(F.lit(hops).alias("hops"), "path")
        found = done if found is None else found.union(done)
        step = frontier.where(F.col("at") != end).join(edges, F.col("at") == F.col("a"))
        frontier = step.where(~F.array_contains("seen", F.col("b"))).select(
            F.col("b").alias("at"), F.concat("seen", F.array("b")).alias("seen"), F.concat_ws(" > ", "path", F.concat_ws("=", "x", "y")).alias("path")
        )
    return found.orderBy("hops", "path").limit(most_paths)


def paths_to_column(cols: DataFrame, keys: DataFrame, missing: str, referenced: list[str]) -> DataFrame:
    """(from_table, to_table, hops, path): from each referenced table to each other one that owns the column ``missing``,
    at most two of the shortest paths of one or two hops."""
    ahead = keys.select(F.col("from_table").alias("a"), F.col("to_table").alias("b"), F.concat_ws(".", "from_table", "from_column").alias("x"), F.concat_ws(".", "to_table", "to_column").alias("y"))
    edges = ahead.union(ahead.select("b", "a", "y", "x")).select("a", "b", F.concat_ws("=", "x", "y").alias("path"))
    owners = cols.where(F.col("column_name") == missing).select(F.col("table_name").alias("to_table")).distinct()
    one = edges.where(F.col("a").isin(*referenced)).select(F.col("a").alias("from_table"), F.lit(1).alias("hops"), F.col("b").alias("to_table"), "path")
    through = one.join(owners, "to_table", "left_anti").withColumnRenamed("path", "before")
    two = through.join(edges, F.col("to_table") == F.col("a")).where("b <> from_table AND b <> to_table")
    two = two.select("from_table", F.lit(2).alias("hops"), F.col("b").alias("to_table"), F.concat_ws(" > ", "before", "path").alias("path"))
    found = one.unionByName(two).join(owners, "to_table", "left_semi").where("from_table <> to_table")
    place = F.row_number().over(Window.partitionBy("from_table", "to_table").orderBy("hops", "path"))
    return found.withColumn("place", place).where("place <= 2").select("from_table", "to_table", "hops", "path")


def packed(items: DataFrame, name: str, size: str, order: list[str], budget: int) -> DataFrame:
    """Items of a catalog taken in ``order`` while their sizes fit into ``budget``; one that doesn't fit is passed over,
    and smaller ones after it may still be taken. One fold over one row of (order, name, size): for tables of a catalog,
    not for data."""
    row = items.where(F.col(size) <= budget).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(name).alias("name_"), F.col(size).cast("long").alias("size_")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("names"))

    def take(state: Column, x: Column) -> Column:
        fits = state["used"] + x["size_"] <= budget
        return F.when(fits, F.struct((state["used"] + x["size_"]).alias("used"), F.concat(state["names"], F.array(x["name_"])).alias("names"))).otherwise(state)

    return row.select(F.aggregate("all", start, take).alias("s")).select(F.explode("s.names").alias(name))
