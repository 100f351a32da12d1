"""Profiles of the test tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators.profile import column_profile, distinct_values, sample_rows
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


def _profile_sql(name: str, column: str) -> str:
    c = f'"{column}"'
    return f"""SELECT '{column}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count,
      CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) * 1.0 / count(*), 4) END AS null_fraction,
      count(DISTINCT {c}) AS distinct_count, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS most FROM {name}"""


for _table, _columns in {
    "customer": ("c_custkey", "c_mktsegment", "c_nationkey"), "orders": ("o_orderstatus", "o_orderpriority"),
    "part": ("p_brand", "p_size"), "labels": ("quality", "toxic"), "documents": ("lang", "source"), "events": ("event_type", "user_id"),
}.items():
    for _column in _columns:
        query(f"profile_{_table}_{_column}", _profile_sql(_table, _column))(
            lambda spark, sf_dir, t=_table, c=_column: column_profile(table(spark, sf_dir, t), c)
        )


@query("distinct_o_orderpriority", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value NULLS LAST LIMIT 20")
def distinct_priorities(spark, sf_dir):
    return distinct_values(table(spark, sf_dir, "orders"), "o_orderpriority", 20).drop("truncated")


@query("sample_customers", "SELECT c_custkey, NULL::VARCHAR AS c_name, TRUE AS c_name_redacted FROM customer ORDER BY c_custkey LIMIT 20")
def sample_customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey")
    return sample_rows(rows, ["c_custkey", "c_name"], redacted={"c_name"}, limit=20)


@query("table_sizes", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ("region", "nation", "orders", "documents")))
def table_sizes(spark, sf_dir):
    out = None
    for name in ("region", "nation", "orders", "documents"):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.union(one)
    return out
