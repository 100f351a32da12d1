"""Changes of a table by rewriting it: what a change makes of the rows, how many it affects, and what it returns.

Files of Parquet are never changed in place: a change reads one version and writes the next one beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


class NotConfirmed(ValueError):
    """The change needs a confirmation that wasn't given."""


@dataclass(frozen=True)
class Change:
    """``kind``: delete, update or upsert. ``where`` (null counts as false; none: all rows) picks rows to delete or to
    update by ``assign``; an upsert takes the rows of ``source`` by ``keys``, each key once in it."""

    kind: str
    where: Column | None = None
    assign: dict[str, Column] | None = None
    source: DataFrame | None = None
    keys: tuple[str, ...] = ()

    @property
    def needs_confirmation(self) -> bool:
        """Every delete, every upsert, and an update of all rows."""
        return self.kind != "update" or self.where is None

    @property
    def picked(self) -> Column:
        return F.lit(True) if self.where is None else F.coalesce(self.where, F.lit(False))


def marked(target: DataFrame, change: Change) -> DataFrame:
    """The rows after the change, deleted ones still among them, with ``affected``."""
    if change.kind == "delete":
        return target.withColumn("affected", change.picked)
    if change.kind == "update":
        # both the old values and the mark are of the row as it was
        assign = change.assign or {}
        new = [F.when(change.picked, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in target.columns]
        return target.select(*new, change.picked.alias("affected"))
    if change.kind == "upsert":
        keys = list(change.keys)
        rest = target.join(change.source.select(*keys), keys, "left_anti").select(*target.columns)
        return rest.withColumn("affected", F.lit(False)).unionByName(change.source.select(*target.columns).withColumn("affected", F.lit(True)))
    raise ValueError(f"unknown change {change.kind!r}")


def after(target: DataFrame, change: Change) -> DataFrame:
    """The table as the change leaves it."""
    rows = marked(target, change)
    return (rows.where("NOT affected") if change.kind == "delete" else rows).drop("affected")


def returning(target: DataFrame, change: Change, columns: list[str], order: list[str], limit: int) -> DataFrame:
    """The affected rows' ``columns``, at most ``limit`` by ``order``, each with ``position`` and the count of all affected
    rows; one row of nulls with the count if there are none."""
    hit = marked(target, change).where("affected")
    count = hit.agg(F.count(F.lit(1)).alias("affected_rows"))
    top = hit.orderBy(*order).limit(limit).select(*columns, *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    # a window over at most ``limit`` rows
    placed = top.withColumn("position", F.row_number().over(Window.orderBy(*[f"_o{k}" for k in range(len(order))])))
    return count.join(placed.select("position", *columns), F.lit(True), "left")


def run_write(target: DataFrame, change: Change, path: str, confirmed: bool = False) -> int:
    """Writes the changed table to the new folder ``path`` in one pass and returns the number of affected rows."""
    if change.needs_confirmation and not confirmed:
        raise NotConfirmed(f"a {change.kind} like this one needs to be confirmed")
    seen = Observation()
    rows = marked(target, change).observe(seen, F.count_if("affected").alias("n"))
    rows = rows.where("NOT affected") if change.kind == "delete" else rows
    rows.drop("affected").write.mode("errorifexists").parquet(path)
    return seen.get["n"]
