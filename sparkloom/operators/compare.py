"""Typed comparison of two results, as bags of rows, in order, or as scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators import bounded


def bag_difference(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """The rows that one side has more often, with ``side`` and ``extra``; no rows: equal bags. One
    aggregate over both sides, so copies of a row never travel."""
    names = golden.columns
    signed = golden.withColumn("sign", F.lit(1)).unionByName(candidate.withColumn("sign", F.lit(-1)))
    counts = signed.groupBy(*names).agg(F.sum("sign").alias("balance")).where("balance != 0")
    side = F.when(F.col("balance") > 0, "golden").otherwise("candidate")
    return counts.select(*names, side.alias("side"), F.abs("balance").alias("extra"))


def canonical(field: T.StructField) -> Column:
    """A value as text with its kind before it; whole numbers and decimals share a kind."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.IntegralType, T.DecimalType)):
        text = F.concat(F.lit("number:"), c.cast("decimal(38,10)").cast("string"))
    elif isinstance(field.dataType, T.FractionalType):
        text = F.concat(F.lit("float:"), c.cast("double").cast("string"))
    elif isinstance(field.dataType, T.BinaryType):
        text = F.concat(F.lit("bytes:"), F.lower(F.hex(c)))
    elif isinstance(field.dataType, T.AtomicType):
        text = F.concat(F.lit(field.dataType.typeName() + ":"), c.cast("string"))
    else:
        raise TypeError(f"{field.name}: {field.dataType.simpleString()} can't be compared")
    return F.coalesce(text, F.lit("null:"))


def digest(df: DataFrame) -> DataFrame:
    """One row: the number of rows and an order-free SHA-256 of a whole table.

    Rows' 256-bit digests are summed by 32-bit words, which needs no sort and no list of all rows."""
    row = F.sha2(F.concat_ws("\x1f", *[canonical(f) for f in df.schema]), 256)
    hashed = df.select(row.alias("h"))
    words = [F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"w{k}") for k in range(8)]
    total = hashed.agg(F.count(F.lit(1)).alias("n"), *words)
    return total.select("n", F.sha2(F.concat_ws(",", "n", *[F.coalesce(F.col(f"w{k}").cast("string"), F.lit("0")) for k in range(8)]), 256).alias("digest"))


MOST_ROWS, MOST_CELLS, MOST_BYTES = 1000, 50_000, 65_536


def compare(golden: DataFrame, candidate: DataFrame, mode: str = "bag", tolerance: float = 0.0) -> str:
    """``equivalent`` or the category of the first mismatch. ``mode``: bag, ordered or scalar.

    Bags without tolerance are compared by Spark at any size. The other modes are for results that
    were already limited: over ``MOST_ROWS`` rows they raise. With a tolerance, rows are matched as
    pairs by augmenting paths, as closeness is not transitive. In all modes NaN equals NaN, as it does
    in Spark's own grouping, and a whole number equals the same floating one, which ``digest`` tells apart."""
    if mode == "scalar":
        a, b = golden.take(2), candidate.take(2)
        if not (len(a) == len(b) == 1 and len(golden.columns) == len(candidate.columns) == 1):
            return "scalarShapeMismatch"
        return "equivalent" if _close(a[0][0], b[0][0], tolerance) else "scalarValueMismatch"
    missing = [c for c in golden.columns if c not in candidate.columns]
    if missing or len(set(candidate.columns)) < len(candidate.columns):
        return "missingCandidateColumn" if missing else "ambiguousCandidateColumn"
    if len(candidate.columns) > len(golden.columns):
        return "unexpectedExtraColumns"
    for f in [*golden.schema, *candidate.schema]:
        try:
            canonical(f)
        except TypeError:
            return "comparatorUnsupportedType"
    candidate = candidate.select(*[f"`{c}`" for c in golden.columns])
    if mode == "bag" and not tolerance:
        if golden.count() != candidate.count():
            return "rowCountMismatch"
        return "equivalent" if bag_difference(golden, candidate).isEmpty() else "rowBagMismatch"
    a, b = golden.take(MOST_ROWS + 1), candidate.take(MOST_ROWS + 1)
    if max(len(a), len(b)) > MOST_ROWS or len(a) * len(golden.columns) > MOST_CELLS:
        raise ValueError(f"over {MOST_ROWS} rows or {MOST_CELLS} cells")
    if any(isinstance(x, (str, bytes, bytearray)) and len(x) > MOST_BYTES for row in (*a, *b) for x in row):
        raise ValueError(f"a cell of over {MOST_BYTES} bytes")
    if len(a) != len(b):
        return "rowCountMismatch"

    def alike(x, y) -> bool:
        return all(_close(p, q, tolerance) for p, q in zip(x, y, strict=True))

    if mode == "ordered":
        return "equivalent" if all(map(alike, a, b)) else "orderedRowMismatch"
    partner: dict[int, int] = {}

    def place(k: int, tried: set[int]) -> bool:
        for j in range(len(b)):
            if j not in tried and alike(a[k], b[j]):
                tried.add(j)
                if j not in partner or place(partner[j], tried):
                    partner[j] = k
                    return True
        return False

    return "equivalent" if all(place(k, set()) for k in range(len(a))) else "rowBagMismatch"


def snapshot(spark: SparkSession, paths: dict[str, str]) -> SparkSession:
    """A session of its own whose views, by name, are Parquet tables with the files that they have now. Files that are
    added later are in none of its queries; one that is removed makes them fail rather than mix two states."""
    session = spark.newSession()
    for name, path in paths.items():
        session.read.parquet(path).createOrReplaceTempView(name)
    return session


def compare_statements(spark: SparkSession, paths: dict[str, str], golden: str, candidate: str, mode: str = "bag", tolerance: float = 0.0) -> str:
    """``compare`` of two reads over one snapshot of the tables; anything but a read raises."""
    session = snapshot(spark, paths)
    for sql in (golden, candidate):
        verdict = bounded.check(session, sql)
        if verdict.errors:
            raise ValueError("; ".join(verdict.errors))
    return compare(session.sql(golden), session.sql(candidate), mode, tolerance)


def _close(x, y, tolerance: float) -> bool:
    if x is not None and y is not None and x != x and y != y:  # NaN
        return True
    if isinstance(x, bool) or isinstance(y, bool) or not tolerance:
        return x == y
    try:
        return x == y or abs(float(x) - float(y)) <= tolerance
    except (TypeError, ValueError):
        return False
