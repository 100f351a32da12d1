"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import scratch, written


def _hooked(links: DataFrame) -> DataFrame:
    """(node, root): every node goes to its smallest neighbour if that is smaller, and on to the
    end of that chain by pointer jumping. Parents are smaller than children, so no cycles form."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parents = both.groupBy("a").agg(F.min("b").alias("least"))
    tree = written(parents.select(F.col("a").alias("node"), F.least("a", "least").alias("root")), "cc-tree")
    while True:
        up = tree.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = written(tree.join(up, "root").select("node", "root", "higher"), "cc-jump")
        moved = not jumped.where("root != higher").isEmpty()
        tree = jumped.select("node", F.col("higher").alias("root"))
        if not moved:
            return tree


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b: long); a component is named by its
    smallest node. Each round contracts every node into a root, so the links left at least halve."""
    with scratch(links.sparkSession):
        return written(_contracted(links), "cc-components", outlive=True)


def _contracted(links: DataFrame) -> DataFrame:
    todo = written(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc-links"
    )
    found = todo.select(F.col("a").alias("node")).union(todo.select("b")).distinct()
    found = found.withColumn("component", F.col("node"))
    while not todo.isEmpty():
        tree = _hooked(todo)
        found = found.join(tree.select(F.col("node").alias("component"), "root"), "component", "left").select(
            "node", F.coalesce("root", "component").alias("component")
        )
        left = tree.select(F.col("node").alias("a"), F.col("root").alias("u"))
        right = tree.select(F.col("node").alias("b"), F.col("root").alias("v"))
        joined = todo.join(left, "a").join(right, "b").where("u != v")
        todo = written(
            joined.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "cc-links"
        )
        found = written(found, "cc-found")
    return found
