"""Evaluation metrics as aggregates over result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pass_rates(results: DataFrame, key: str) -> DataFrame:
    """(key, n, passed, rate); ``passed`` is null where a result was not judged, and such rows don't count."""
    return results.groupBy(key).agg(
        F.count("passed").alias("n"), F.count_if("passed").alias("passes"), F.coalesce(F.round(F.avg(F.col("passed").cast("int")), 4), F.lit(0.0)).alias("rate")
    )


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def repeat_stability(results: DataFrame, keys: list[str], status: str) -> DataFrame:
    """A row a key: number of runs, of kinds of status, and whether the key is flaky (more than one kind)."""
    kinds = F.countDistinct(status)
    return results.groupBy(*keys).agg(F.count(F.lit(1)).alias("runs"), kinds.alias("kinds"), (kinds > 1).alias("flaky"))


def ranking_quality(required: DataFrame, ranked: DataFrame, ks: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """One row: recall at each k over all required (case, item), the share of cases with all of them, and the
    mean reciprocal rank of each case's first required item. ``ranked`` has (case, item, rank) from 1."""
    met = required.join(ranked, ["case", "item"], "left")
    by_case = met.groupBy("case").agg(
        F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") <= k).alias(f"at{k}") for k in ks]
    )
    out = []
    for k in ks:
        out.append(F.round(F.coalesce(F.sum(f"at{k}") / F.sum("n"), F.lit(1.0)), 4).alias(f"recall_at_{k}"))
        out.append(F.round(F.avg((F.col(f"at{k}") == F.col("n")).cast("int")), 4).alias(f"all_at_{k}"))
    return by_case.agg(*out, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


def completeness(expected: DataFrame, results: DataFrame, keys: list[str], order: str, status: str) -> DataFrame:
    """Expected keys with the status of their last result, or ``missing``."""
    last = results.groupBy(*keys).agg(F.max_by(status, order).alias("status"))
    return expected.join(last, keys, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def running_budget(results: DataFrame, group: str, order: list[str], cost: str, most: float) -> DataFrame:
    """Each result with the cost so far in its group, and whether the budget still allowed it."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = F.sum(cost).over(w)
    return results.withColumn("so_far", so_far).withColumn("allowed", so_far - F.col(cost) < most)


def release_gate(totals: DataFrame, criteria: dict[str, tuple[str, str, float]]) -> DataFrame:
    """One row: for each criterion (passes column, total column, least share) whether it holds, and ``released``.
    A criterion over no cases fails."""
    checks = [F.coalesce((F.col(n) > 0) & (F.col(p) >= least * F.col(n)), F.lit(False)).alias(name) for name, (p, n, least) in criteria.items()]
    all_ = checks[0]
    for c in checks[1:]:
        all_ = all_ & c
    return totals.select(*checks, all_.alias("released"))


def best_groups(groups: DataFrame, ranked: DataFrame) -> DataFrame:
    """(case, group, missing, worst): of a case's alternative groups of items the one with the fewest items that have no
    rank, then the best worst rank (none is worst of all), then the fewest items, then the first by its items' names.
    ``groups`` has (case, group, item), ``ranked`` (case, item, rank)."""
    met = groups.join(ranked, ["case", "item"], "left").groupBy("case", "group")
    each = met.agg(
        F.count_if(F.col("rank").isNull()).alias("missing"),
        F.max("rank").alias("worst"),
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.col("item").cast("string"))), "|").alias("names"),
    )
    order = F.struct("missing", F.col("worst").isNull().alias("none"), "worst", "n", "names")
    return each.groupBy("case").agg(F.min_by(F.struct("group", "missing", "worst"), order).alias("b")).select("case", "b.*")


def collisions(required: DataFrame, ranked: DataFrame, most: int = 8) -> DataFrame:
    """(case, collisions): items of another place but the same name that rank before a required item, or among the first
    ``most`` if that has no rank. ``required`` has (case, item, name), ``ranked`` (case, item, name, rank).

    An item's place among those of its name gives the count, so that no pairs are made."""
    w = Window.partitionBy("case", "name").orderBy("rank")
    placed = ranked.select("case", "item", (F.row_number().over(w) - 1).alias("before"))
    top = ranked.where(F.col("rank") <= most).groupBy("case", "name").agg(F.count(F.lit(1)).alias("in_top"))
    met = required.join(placed, ["case", "item"], "left").join(top, ["case", "name"], "left")
    return met.groupBy("case").agg(F.sum(F.coalesce("before", "in_top", F.lit(0))).cast("long").alias("collisions"))


def distractors(forbidden: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """(case, violations): forbidden (case, item) among the first ``k``."""
    hit = forbidden.join(ranked.where(F.col("rank") <= k), ["case", "item"], "left")
    return hit.groupBy("case").agg(F.count("rank").alias("violations"))


def usage_totals(results: DataFrame, keys: list[str], amounts: list[str], cached: str, prompt: str, source: str) -> DataFrame:
    """Totals a key, null where no row has a value; the share of prompt tokens that came from a cache, null without any;
    and the source of costs: an estimate if any row's is."""
    totals = [F.sum(c).alias(c) for c in amounts]
    share = F.when(F.sum(prompt) > 0, F.round(F.coalesce(F.sum(cached), F.lit(0)) / F.sum(prompt), 4)).alias("cache_hit_rate")
    kind = F.when(F.coalesce(F.bool_or(F.col(source) == "estimated"), F.lit(False)), "estimated").otherwise(F.max(source)).alias("cost_source")
    return results.groupBy(*keys).agg(*totals, share, kind)


def call_histogram(calls: DataFrame, key: str) -> DataFrame:
    """(calls, results, share): how many results made so many extra calls, and their share of all results."""
    n = calls.groupBy(key).agg(F.count("call").alias("calls")).groupBy("calls").agg(F.count(F.lit(1)).alias("results"))
    # one row of all results
    total = n.agg(F.sum("results").alias("all_results"))
    return n.join(F.broadcast(total)).select("calls", "results", F.round(F.col("results") / F.col("all_results"), 4).alias("share"))


def paired_arms(results: DataFrame, key: str, arm: str, passed: str, on: str, off: str) -> DataFrame:
    """One row over the keys that have results in both arms: pairs, both passed, only ``on``, only ``off``, neither.
    A key passes in an arm if any of its results there does."""
    sides = results.groupBy(key).agg(*[F.bool_or(F.when(F.col(arm) == a, F.col(passed))).alias(n) for a, n in ((on, "a"), (off, "b"))])
    both = sides.where("a IS NOT NULL AND b IS NOT NULL")
    kinds = {"both": "a AND b", "only_on": "a AND NOT b", "only_off": "b AND NOT a", "neither": "NOT a AND NOT b"}
    return both.agg(F.count(F.lit(1)).alias("pairs"), *[F.count_if(F.expr(c)).alias(n) for n, c in kinds.items()])


def withheld_summary(results: DataFrame) -> DataFrame:
    """One row over results with ``withheld`` true: how many, where the decision didn't match, how many were judged
    (``passed`` not null), how many of these passed. All null if none was withheld."""
    n = F.count(F.lit(1))
    parts = {"withheld": n, "expected": F.count_if(~F.col("decision_matches")), "scored": F.count("passed"), "passes": F.count_if("passed")}
    return results.where("withheld").agg(*[F.when(n > 0, c).alias(name) for name, c in parts.items()])


def resume_plan(expected: DataFrame, results: DataFrame, keys: list[str], order: str, status: str, rerun: list[str], missing: bool = True) -> DataFrame:
    """Expected keys with the status of their last result (null: none) and what to do: ``run`` where there is none (if
    ``missing``) or its status is among ``rerun``, ``reuse`` where there is one otherwise, or else ``skip``."""
    last = results.groupBy(*keys).agg(F.max_by(status, order).alias("last_status"))
    action = (
        F.when(F.col("last_status").isNull(), "run" if missing else "skip").when(F.col("last_status").isin(*rerun), "run").otherwise("reuse")
    )
    return expected.join(last, keys, "left").withColumn("action", action)


def acceptance(summary: DataFrame, least: dict[str, float], none: tuple[str, ...] = ()) -> DataFrame:
    """The one row of ``summary`` as (passed, messages): columns of ``least`` below their threshold and columns of
    ``none`` above zero, in that order."""
    found = [F.when(F.col(c) < x, f"{c} below {x:g}") for c, x in least.items()] + [F.when(F.col(c) > 0, f"{c} above zero") for c in none]
    messages = F.array_compact(F.array(*found))
    return summary.select((F.size(messages) == 0).alias("passed"), F.array_join(messages, "; ").alias("messages"))
