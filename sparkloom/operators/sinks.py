"""Results as files and texts: CSV, JSON lines, a Markdown table, and fixtures read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_name(title: Column, ending: str = "csv") -> Column:
    """A title's letters and digits in lower case, joined by hyphens; ``results`` if it has none."""
    slug = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", "-"), F.lit("-"))
    return F.concat(F.when(slug == "", "results").otherwise(slug), F.lit(f".{ending}"))


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as JSON with its keys sorted; nulls are left out."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def canonical_json(text: Column) -> Column:
    """JSON with its keys sorted at every depth and no spaces; null if it can't be read."""
    return F.to_json(F.try_parse_json(text))


def capped_text(text: Column, most: int) -> Column:
    """(text, bytes, truncated): at most ``most`` bytes of UTF-8, cut between characters, and the bytes of the whole.

    A byte that continues a character is 10xxxxxx; up to three of them are dropped at the cut."""
    size = F.octet_length(text)
    data = F.encode(text, "UTF-8")

    def starts(k: int) -> Column:
        after = F.hex(F.substring(data, most + 1 - k, 1))
        return ~F.substring(after, 1, 1).isin("8", "9", "A", "B")

    cut = F.when(starts(0), most)
    for k in (1, 2, 3):
        cut = cut.when(starts(k), most - k)
    kept = F.when(size <= most, text).otherwise(F.decode(F.substring(data, F.lit(1), cut), "UTF-8"))
    return F.struct(kept.alias("text"), size.alias("bytes"), (size > most).alias("truncated"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, values quoted where they need it and quotes doubled, nulls empty; a file a partition."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with sorted keys; ``append`` adds files to what is there, as an audit log does."""
    json_lines(df).write.mode("append" if append else "errorifexists").text(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A report's table of aggregated rows in their order; fails beyond ``most`` rows, and cuts none."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")

    def cell(v) -> str:
        return "-" if v is None else str(v).replace("|", "\\|").replace("\n", " ")

    lines = [df.columns, ["---"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def fixture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array or of JSON lines; keys that are missing are null, others are passed over."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _versions(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    """The versions below ``folder`` and whether they were finished."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    return sorted((int(n[8:]), files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))) for n in names if n.startswith("version-"))


def save_state(df: DataFrame, folder: str) -> None:
    """Replaces a stored table of settings or metadata by its next version, as JSON lines: readers see the version before
    until the new one is finished, and of two writers at a time one fails."""
    found = _versions(df.sparkSession, folder)
    write_json_lines(df, f"{folder}/version-{found[-1][0] + 1 if found else 1:06d}")


def state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last finished version; keys that it lacks are null, none at all is an empty table."""
    done = [n for n, finished in _versions(spark, folder) if finished]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{folder}/version-{done[-1]:06d}")
