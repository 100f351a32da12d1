"""Readers of the Parquet tables that the queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set at ``sf_dir``; a file or a folder of Parquet parts."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views over the tables, so that SQL text can name them."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
