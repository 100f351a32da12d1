"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

A source's target over its size is the expected number of copies of each of its documents. The
whole part is certain; the fractions are rounded dependently: two documents move word mass
between their fractions, in a random direction whose odds keep each document's expectation, as
far as it goes until one fraction is 0 or 1. That one is decided; the other goes on. A group's
fold leaves one residual, and residuals meet in a tree of fan-in ``fan_in``, so a source's taken
words miss its target by less than one document. The tree's depth is the logarithm of the
number of documents; a hot source has more groups, not larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.shared import WORD, fraction, written

WEIGHTS = (5, 2, 1)
MOST = 3
FAN_IN = 32


def sizes(docs: DataFrame) -> Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target) for items (source, size, m).

    Weights go round the sources in code point order, null last. Targets share all words by
    weight, none above ``most`` times its source's size. With the caps sorted by cap over weight, the
    share a unit of weight gets is the greatest of (words - caps before) / (weights from here on).
    One row a source passes through the two windows, never a document.
    """
    by_source = items.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * F.col("m")).alias("source_size")
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = by_source.withColumn("weight", F.element_at(cycle, F.pmod(turn, F.lit(len(weights))) + 1))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    return weighted.withColumn("share", share).select(
        "source", "n", "source_size",
        F.least(F.col("cap"), F.max("share").over(everything) * F.col("weight")).alias("target"),
    )


def _fold(level: int, seed: int) -> Column:
    """A group's documents (column ``group``) folded to {carry, done}: the pivotal method."""
    entry = "struct<doc_id:bigint,size:bigint,m:bigint,base:bigint,p:double>"

    def settle(p: Column) -> Column:
        return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["m"].alias("m"), x["base"].alias("base"), p.alias("p"))

    def meet(acc: Column, x: Column) -> Column:
        i = acc["carry"]
        up = F.least(i["size"] * (1 - i["p"]), x["size"] * x["p"])
        down = F.least(i["size"] * i["p"], x["size"] * (1 - x["p"]))
        odds = fraction(F.lit(seed), F.lit(level), i["doc_id"], i["size"], x["doc_id"], x["size"])
        moves = F.array(F.struct(up.alias("up"), down.alias("down"), odds.alias("u")))
        moved = F.transform(moves, lambda s: F.when(s["u"] * (s["up"] + s["down"]) < s["down"], s["up"]).otherwise(-s["down"]))
        after = F.transform(
            moved,
            lambda t: F.struct(
                settle(i["p"] + t / i["size"]).alias("pi"), settle(x["p"] - t / x["size"]).alias("px")
            ),
        )

        def state(t: Column) -> Column:
            whole = (t["pi"] == 0) | (t["pi"] == 1)
            mine, other = with_p(i, t["pi"]), with_p(x, t["px"])
            return F.struct(
                F.when(whole, other).otherwise(mine).alias("carry"),
                F.concat(acc["done"], F.array(F.when(whole, mine).otherwise(other))).alias("done"),
            )

        first = F.struct(with_p(x, x["p"]).alias("carry"), acc["done"].alias("done"))
        return F.when(i.isNull(), first).otherwise(F.element_at(F.transform(after, state), 1))

    start = F.struct(F.lit(None).cast(entry).alias("carry"), F.array().cast(f"array<{entry}>").alias("done"))
    return F.aggregate("group", start, meet)


def copies(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, fan_in: int = FAN_IN, seed: int = 7) -> DataFrame:
    """(source, doc_id, size, m, source_size, target, copies) for items (source, doc_id, size, m).

    ``m`` counts rows that are alike; ``copies`` is for all of them together. Documents without
    words take no part in the rounding and get the whole part of their expectation.
    """
    targets = written(source_targets(items, weights, most), "mix-sources")
    rate = F.least(F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0)), F.lit(float(most)))
    wanted = items.join(targets, items["source"].eqNullSafe(targets["source"])).select(
        items["source"], "doc_id", "size", "m", "source_size", "target",
        F.ceil(F.col("n") / fan_in).alias("groups"), (rate * F.col("m")).alias("expected"),
    )
    wanted = wanted.withColumn("base", F.floor("expected")).withColumn("p", F.col("expected") - F.col("base"))
    certain = (F.col("size") == 0) | (F.col("p") < 1e-9)
    keys = ("source", "source_size", "target")
    done = [
        wanted.where(certain).select(*keys, "doc_id", "size", "m", F.col("base").alias("copies"))
    ]
    level, todo = 0, wanted.where(~certain).withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("groups"))
    )
    widest = targets.agg(F.max(F.ceil(F.col("n") / fan_in))).first()[0] or 0
    while widest:
        member = F.struct((-F.col("size")).alias("order"), "doc_id", "size", "m", "base", "p")
        folded = (
            todo.groupBy(*keys, "groups", "bucket")
            .agg(F.array_sort(F.collect_list(member)).alias("group"))
            .select(*keys, "groups", "bucket", _fold(level, seed).alias("state"))
        )
        folded = written(folded, f"mix-level-{level}")
        whole = folded.select(*keys, F.explode("state.done").alias("x")).select(
            *keys, "x.doc_id", "x.size", "x.m", (F.col("x.base") + F.col("x.p")).cast("long").alias("copies")
        )
        done.append(whole)
        todo = folded.select(*keys, "groups", "bucket", "state.carry.*")
        if widest == 1:
            break
        widest = -(-widest // fan_in)
        todo = todo.withColumn("groups", F.ceil(F.col("groups") / fan_in)).withColumn(
            "bucket", F.pmod(F.col("bucket"), F.col("groups"))
        )
        level += 1
    last = F.when(F.col("p") >= 0.5, 1).otherwise(0)  # the one document that nothing is left to pair with
    if widest:
        done.append(todo.select(*keys, "doc_id", "size", "m", (F.col("base") + last).alias("copies")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def items_of(docs: DataFrame) -> DataFrame:
    """One row for rows of equal source, doc_id and number of words, with their number ``m``."""
    rows = docs.select("source", "doc_id", sizes(docs).alias("size"))
    return written(rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")), "mix-items")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to 3 times).

    Of m rows with equal source, doc_id and size, each gets copies div m and the first (copies mod m)
    one more. Null texts have size 0, null sources are a source, and no row is lost to nulls. An empty
    table gives an empty one.
    """
    taken = copies(items_of(docs), **options).select(
        F.col("source").alias("of"), F.col("doc_id").alias("id"), F.col("size").alias("words"), "m", "copies"
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.col("source").alias("s"), F.col("doc_id").alias("d"), sizes(docs).alias("n"),
    )
    met = rows.join(
        taken,
        rows["s"].eqNullSafe(taken["of"]) & rows["d"].eqNullSafe(taken["id"]) & (rows["n"] == taken["words"]),
    )
    rank = F.row_number().over(Window.partitionBy("s", "d", "n").orderBy("tag"))
    times = F.floor(F.col("copies") / F.col("m")) + (rank <= F.col("copies") % F.col("m")).cast("long")
    return (
        met.withColumn("tag", F.monotonically_increasing_id())
        .withColumn("times", times)
        .where("times > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("doc.*")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    found = copies(items_of(docs)).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    each = F.floor(F.col("copies") / F.col("m")) + (F.col("row") <= F.col("copies") % F.col("m")).cast("long")
    return found.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * each).cast("long").alias("taken"), "source"
    )
