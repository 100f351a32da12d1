"""The catalog of the test tables: keys, foreign keys and value lists, which Parquet doesn't carry, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import check_values, needs_quotes
from sparkloom.sources.tables import TABLES, table

#: (from table, from column, to table, to column)
FOREIGN_KEYS = (
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
)
#: (table, constraint, kind, columns in order)
KEYS = (
    ("region", "region_pkey", "primary", ("r_regionkey",)), ("region", "region_name_key", "unique", ("r_name",)),
    ("nation", "nation_pkey", "primary", ("n_nationkey",)), ("nation", "nation_name_key", "unique", ("n_name",)),
    ("customer", "customer_pkey", "primary", ("c_custkey",)), ("supplier", "supplier_pkey", "primary", ("s_suppkey",)),
    ("part", "part_pkey", "primary", ("p_partkey",)), ("orders", "orders_pkey", "primary", ("o_orderkey",)),
    ("events", "events_pkey", "primary", ("event_id",)), ("conversations", "conversations_pkey", "primary", ("conv_id", "turn")),
)
#: (table, column, constraint, expression)
CHECKS = (
    ("orders", "o_orderstatus", "orders_status_check", "o_orderstatus IN ('F', 'O')"),
    ("lineitem", "l_linestatus", "lineitem_linestatus_check", "l_linestatus = ANY (ARRAY['F', 'O'])"),
    ("lineitem", "l_returnflag", "lineitem_returnflag_check", "l_returnflag IN ('A', 'N', 'R')"),
    ("events", "event_type", "events_type_check", "event_type <> 'it''s'"),
    ("conversations", "role", "conversations_role_check", "role = 'user' OR role = 'assistant' OR role = 'user'"),
    ("part", "p_size", "part_size_check", "p_size >= 1"),
)
#: (table, comment)
COMMENTS = (("customer", "Buyers with their market segment"), ("lineitem", "One position of an order: the part, its supplier and the discount"), ("events", "What users did, by time"))


def _rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table of metadata, in one partition."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def keys(spark: SparkSession) -> DataFrame:
    """(table_name, constraint_name, kind, position, column_name): a row a column of a primary or unique key."""
    rows = [(t, name, kind, k + 1, c) for t, name, kind, cols in KEYS for k, c in enumerate(cols)]
    return _rows(spark, rows, "table_name string, constraint_name string, kind string, position int, column_name string")


def checks(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, constraint_name, expression, allowed): ``allowed`` holds the values that a
    positive expression lists, each once in their order, and is empty for one that isn't."""
    rows = _rows(spark, CHECKS, "table_name string, column_name string, constraint_name string, expression string")
    return rows.withColumn("allowed", check_values(F.col("expression")))


def comments(spark: SparkSession) -> DataFrame:
    return _rows(spark, COMMENTS, "table_name string, comment string")


def grouped_keys(key_columns: DataFrame) -> DataFrame:
    """(table_name, constraint_name, kind, columns): the columns of each key in its order."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "column_name")))
    return key_columns.groupBy("table_name", "constraint_name", "kind").agg(F.transform(ordered, lambda x: x["column_name"]).alias("columns"))


def constraints(check_rows: DataFrame) -> DataFrame:
    """The CHECK constraints with ``unparsed`` for those that list no values."""
    return check_rows.withColumn("unparsed", F.size("allowed") == 0)


def assembled(cols: DataFrame, key_columns: DataFrame, fks: DataFrame, check_rows: DataFrame) -> DataFrame:
    """A row a table: its columns in order, its keys, and its foreign and CHECK constraints by name."""

    def gathered(rows: DataFrame, name: str, *sort: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(*sort, *[c for c in rows.columns if c not in (*sort, "table_name")])))
        return rows.groupBy("table_name").agg(items.alias(name))

    out = gathered(cols, "columns", "position")
    for name, rows, sort in (
        ("keys", grouped_keys(key_columns), "constraint_name"),
        ("foreign_keys", fks.withColumnRenamed("from_table", "table_name"), "from_column"),
        ("checks", check_rows, "constraint_name"),
    ):
        out = out.join(gathered(rows, name, sort), "table_name", "left")
    return out


def column_order(cols: DataFrame, key_columns: DataFrame, fks: DataFrame, check_rows: DataFrame, focus: tuple[str, ...] = ()) -> DataFrame:
    """The columns with ``priority``: 0 in focus (``table.column``), 1 of a primary key, 2 of a unique one, 3 an end of
    a foreign key, 4 to be quoted, 5 with listed values, 6 temporal, a name or a status, 8 any other."""
    ends = fks.select(F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name"))
    ends = ends.union(fks.select("to_table", "to_column")).distinct().withColumn("joins", F.lit(True))
    held = key_columns.groupBy("table_name", "column_name").agg(F.min(F.when(F.col("kind") == "primary", 1).otherwise(2)).alias("key_rank"))
    listed = check_rows.where(F.size("allowed") > 0).select("table_name", "column_name").distinct().withColumn("listed", F.lit(True))
    on = ["table_name", "column_name"]
    name, kind = F.lower("column_name"), F.lower("type")
    temporal = kind.rlike("date|time") | name.rlike("date|time|created|scheduled|_at$")
    priority = (
        F.when(F.concat_ws(".", "table_name", "column_name").isin(*focus), 0)
        .when(F.col("key_rank").isNotNull(), F.col("key_rank"))
        .when(F.col("joins"), 3)
        .when(needs_quotes(F.col("column_name")), 4)
        .when(F.col("listed"), 5)
        .when(temporal | name.rlike("^(name|slug|label|title)$|_(name|slug|label)$|status"), 6)
        .otherwise(8)
    )
    joined = cols.join(held, on, "left").join(ends, on, "left").join(listed, on, "left")
    return joined.withColumn("priority", priority).drop("key_rank", "joins", "listed")


def table_cards(ordered: DataFrame, fks: DataFrame, most: int) -> DataFrame:
    """(table_name, column_name, place): the first ``most`` columns of each table by priority, position and name;
    ends of foreign keys stay beyond that. ``ordered`` comes from ``column_order``."""
    w = Window.partitionBy("table_name").orderBy("priority", "position", "column_name")
    ends = fks.select(F.col("from_table").alias("table_name"), F.col("from_column").alias("column_name")).union(fks.select("to_table", "to_column"))
    ends = ends.distinct().withColumn("required", F.lit(True))
    placed = ordered.withColumn("place", F.row_number().over(w)).join(ends, ["table_name", "column_name"], "left")
    return placed.where((F.col("place") <= most) | F.col("required")).select("table_name", "column_name", "place")


def named_like(tables: DataFrame, part: str) -> DataFrame:
    """Tables whose name holds ``part``, in either case, by name."""
    return tables.where(F.contains(F.lower("table_name"), F.lit(part.lower()))).orderBy("table_name")


def foreign_keys(spark: SparkSession) -> DataFrame:
    return _rows(spark, FOREIGN_KEYS, "from_table string, from_column string, to_table string, to_column string")


def columns(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """(table_name, position, column_name, type, nullable) from the files' schemas; no data is read."""
    rows = [(t, k + 1, f.name, f.dataType.simpleString(), f.nullable) for t in names for k, f in enumerate(table(spark, sf_dir, t).schema)]
    return _rows(spark, rows, "table_name string, position int, column_name string, type string, nullable boolean")


def within(tables: DataFrame, keys: DataFrame) -> DataFrame:
    """The foreign keys of which both ends are among ``tables`` (table_name)."""
    left = keys.join(tables.select(F.col("table_name").alias("from_table")), "from_table", "left_semi")
    return left.join(tables.select(F.col("table_name").alias("to_table")), "to_table", "left_semi").select(keys.columns)


def fingerprint(cols: DataFrame) -> DataFrame:
    """One row with the SHA-256 of the schema's sorted lines: changes when any column does."""
    line = F.concat_ws(":", "table_name", F.format_string("%05d", "position"), "column_name", "type", F.col("nullable").cast("string"))
    return cols.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


def retrieval_fingerprint(cols: DataFrame, key_columns: DataFrame, fks: DataFrame, check_rows: DataFrame, table_comments: DataFrame) -> DataFrame:
    """One row with the SHA-256 of all that a search for tables reads: columns, comments, keys, foreign keys and CHECK
    constraints, as sorted lines. No sizes and no times are in it, so a table that only grows keeps its index."""
    lines = [
        cols.select(F.concat_ws(":", F.lit("column"), "table_name", F.format_string("%05d", "position"), "column_name", "type", F.col("nullable").cast("string")).alias("line")),
        table_comments.select(F.concat_ws(":", F.lit("comment"), "table_name", "comment")),
        grouped_keys(key_columns).select(F.concat_ws(":", F.lit("key"), "table_name", "constraint_name", "kind", F.array_join("columns", ","))),
        fks.select(F.concat_ws(":", F.lit("foreign"), "from_table", "from_column", "to_table", "to_column")),
        check_rows.select(F.concat_ws(":", F.lit("check"), "table_name", "column_name", "constraint_name", "expression", F.array_join("allowed", ","))),
    ]
    out = lines[0]
    for part in lines[1:]:
        out = out.union(part)
    return out.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("fingerprint"))


def objects(cols: DataFrame, key_columns: DataFrame, fks: DataFrame, check_rows: DataFrame) -> DataFrame:
    """(kind, object_id, description) of all tables, columns, keys, foreign keys and CHECK constraints."""
    column_id = F.concat_ws(".", "table_name", "column_name")
    fk_id = F.concat_ws("_", "from_table", "from_column", F.lit("fkey"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"])
    parts = [
        cols.groupBy(F.col("table_name").alias("object_id")).agg(F.array_join(names, ", ").alias("description")).withColumn("kind", F.lit("table")),
        cols.select(column_id.alias("object_id"), F.col("type").alias("description"), F.lit("column").alias("kind")),
        grouped_keys(key_columns).select(F.col("constraint_name").alias("object_id"), F.concat("kind", F.lit(" key of "), "table_name", F.lit(": "), F.array_join("columns", ", ")).alias("description"), F.lit("key").alias("kind")),
        fks.select(fk_id.alias("object_id"), F.concat("from_table", F.lit("."), "from_column", F.lit(" = "), "to_table", F.lit("."), "to_column").alias("description"), F.lit("foreign_key").alias("kind")),
        check_rows.select(F.col("constraint_name").alias("object_id"), F.col("expression").alias("description"), F.lit("check").alias("kind")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def describe(all_objects: DataFrame, ids: list[str]) -> DataFrame:
    """The objects of ``ids``, each once; an id that names nothing has a null kind."""
    asked = all_objects.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(ids)], "object_id string").coalesce(1)
    return asked.join(all_objects, "object_id", "left")
