"""Profiling: exact column profiles, distinct values, samples without sensitive values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERED = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
MOST_DISTINCT = MOST_ROWS = 20
MOST_COLUMNS = 8

#: Parts of names that mark a sensitive column (fixed values).
SENSITIVE = (
    "password", "passwd", "token", "secret", "api_key", "apikey", "key", "auth", "credential", "session",
    "email", "phone", "address", "raw_user_meta_data", "user_metadata", "app_metadata",
)


def is_sensitive(*names: str) -> bool:
    """Whether a column's schema, table, name, comment or type says that its values must not be shown."""
    text = " ".join(names).lower()
    return any(part in text for part in SENSITIVE)


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: row_count, null_count, null_fraction (null for an empty table), distinct_count, least, most.
    Least and most are given, as text, for ordered types only; distinct_count for atomic types only."""
    c, kind = F.col(f"`{column}`"), df.schema[column].dataType
    n, present = F.count(F.lit(1)), F.count(c)
    none = F.lit(None).cast("string")
    return df.select(c).agg(
        n.alias("row_count"), (n - present).alias("null_count"), F.when(n > 0, F.round((n - present) / n, 4)).alias("null_fraction"),
        (F.countDistinct(c) if isinstance(kind, ORDERED) else F.lit(None).cast("long")).alias("distinct_count"),
        (F.min(c).cast("string") if isinstance(kind, ORDERED) else none).alias("least"),
        (F.max(c).cast("string") if isinstance(kind, ORDERED) else none).alias("most"),
    ).select(F.lit(column).alias("column_name"), "*")


def column_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, null_fraction, distinct_estimate) of many columns in one pass, by sketches."""
    names = columns or df.columns
    parts = [F.struct(F.lit(x).alias("column_name"), F.avg(F.col(f"`{x}`").isNull().cast("int")).alias("null_fraction"), F.approx_count_distinct(F.col(f"`{x}`")).alias("distinct_estimate")) for x in names]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def distinct_values(df: DataFrame, column: str, limit: int = MOST_DISTINCT) -> DataFrame:
    """(value, n, truncated): the most frequent values first, ties by value, nulls last."""
    counts = df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(limit + 1)
    more = top.agg((F.count(F.lit(1)) > limit).alias("truncated"))
    return top.limit(limit).join(F.broadcast(more))


def sample_rows(df: DataFrame, columns: list[str], redacted: set[str] | None = None, limit: int = MOST_ROWS) -> DataFrame:
    """At most ``limit`` rows of at most eight columns; redacted ones are never read, and show as null with a flag."""
    if len(columns) > MOST_COLUMNS or limit > MOST_ROWS:
        raise ValueError(f"at most {MOST_COLUMNS} columns and {MOST_ROWS} rows")
    hidden = redacted if redacted is not None else {c for c in columns if is_sensitive(c)}
    shown = []
    for c in columns:
        if c in hidden:
            shown += [F.lit(None).cast(df.schema[c].dataType).alias(c), F.lit(True).alias(f"{c}_redacted")]
        else:
            shown.append(F.col(f"`{c}`"))
    return df.limit(limit).select(*shown)
