"""Bounded execution of SQL text: reads only, a row limit with a truncation flag, a timeout, CSV."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, SECONDS = 100, 10.0
#: A result with a limit of its own may have so many rows and cells; beyond, the run fails and nothing is cut.
MOST_ROWS, MOST_CELLS = 1000, 50_000
#: Functions that a statement may not call: they leave the engine.
FORBIDDEN = {"java_method", "reflect", "try_reflect"}
#: Nodes of parsed plans that only read. Any other node makes a statement something else than a read.
READING = frozenset(
    "Aggregate AsOfJoin Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation"
    " Offset OneRowRelation Pivot Project Range RebalancePartitions Repartition RepartitionByExpression ResolvedInlineTable Sample Sort Subquery"
    " SubqueryAlias Tail Union UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases"
    " UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Unpivot UnpivotTransformer Window WithWindowDefinition".split()
)
WRITING = re.compile("Insert|Update|Delete|Merge|Replace|Overwrite|Append")


@dataclass
class Verdict:
    kind: str = "read"
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    has_limit: bool = False


def _seq(values) -> list:
    return [values.apply(k) for k in range(values.size())]


def _expressions(plan) -> Iterator:
    todo = _seq(plan.expressions())
    while todo:
        x = todo.pop()
        yield x
        todo += _seq(x.children())


def _nodes(plan) -> Iterator[tuple[str, object]]:
    """(class, node) of a parsed plan, those of common table expressions and subqueries among them."""
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        yield name, node
        todo += _seq(node.children())
        if name == "UnresolvedWith":
            todo += _seq(node.innerChildren())
        if name in READING:
            todo += _seq(node.subqueries())


def _limited(plan) -> bool:
    """Whether a statement's rows have a limit of its own at the top."""
    while (name := plan.getClass().getSimpleName()) in ("UnresolvedWith", "WithWindowDefinition", "Sort", "SubqueryAlias"):
        plan = plan.children().last()
    return name == "GlobalLimit"


def check(spark: SparkSession, sql: str) -> Verdict:
    """Judges a statement by the plan that Spark's own parser makes of it; nothing runs. A read has none but
    reading nodes anywhere, in common table expressions and subqueries too, and calls no forbidden function."""
    out = Verdict()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        return Verdict("invalid", [str(e).splitlines()[0]])
    for name, node in _nodes(plan):
        if name not in READING:
            kind = "write" if WRITING.search(name) else "command"
            out.kind = kind if out.kind == "read" else out.kind
            out.errors.append(f"only reads run here: {name}")
            continue
        if name == "UnresolvedTableValuedFunction":
            called = [node.name().mkString(".")]
        else:
            called = [x.nameParts().mkString(".") for x in _expressions(node) if x.getClass().getSimpleName() == "UnresolvedFunction"]
        out.errors += [f"{x} is not allowed" for x in called if x.lower().split(".")[-1] in FORBIDDEN]
        if any(x.getClass().getSimpleName() in ("NamedParameter", "PosParameter") for x in _expressions(node)):
            out.errors.append("holds a bind placeholder")
        if name == "Project" and any(x.getClass().getSimpleName() == "UnresolvedStar" for x in _seq(node.expressions())):
            out.warnings.append("selects all columns")
    if out.kind == "read":
        out.has_limit = _limited(plan)
        if not out.has_limit:
            out.warnings.append("no limit")
    out.errors, out.warnings = list(dict.fromkeys(out.errors)), list(dict.fromkeys(out.warnings))
    return out


def verify(spark: SparkSession, sql: str) -> list[tuple[str, str]]:
    """(column, type) of a read's result: Spark analyzes it, and nothing runs."""
    verdict = check(spark, sql)
    if verdict.errors:
        raise ValueError("; ".join(verdict.errors))
    return spark.sql(sql).dtypes


@dataclass
class Result:
    columns: list[str]
    rows: list
    truncated: bool


def run(spark: SparkSession, sql: str, rows: int = ROWS, seconds: float = SECONDS) -> Result:
    """Runs a read. Without a limit of its own one row more than ``rows`` is fetched, which tells whether
    there are more; with one, the rows come as they are or, over ``MOST_ROWS`` or ``MOST_CELLS``, an error.
    The job is cancelled after ``seconds``: then a TimeoutError is raised."""
    verdict = check(spark, sql)
    if verdict.errors:
        raise ValueError("; ".join(verdict.errors))
    df = spark.sql(sql)
    tag, late = f"bounded-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def stop():
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    context.addJobTag(tag)
    timer.start()
    try:
        got = df.limit((MOST_ROWS if verdict.has_limit else rows) + 1).collect()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"over {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    if verdict.has_limit and (len(got) > MOST_ROWS or len(got) * len(df.columns) > MOST_CELLS):
        raise ValueError(f"over {MOST_ROWS} rows or {MOST_CELLS} cells")
    more = not verdict.has_limit and len(got) > rows
    return Result(df.columns, got[:rows] if more else got, more)


#: SQLSTATE to the kind of an error; the second line has what Spark calls the same.
KINDS = {
    "42P01": "missingTable", "42703": "missingColumn", "42702": "ambiguousColumn", "42601": "syntax", "42803": "grouping", "42804": "type",
    "42883": "missingFunction", "22P02": "invalidText", "42501": "insufficientPrivilege", "57014": "timedOut",
    "42704": "ambiguousColumn", "42K09": "type", "42846": "type", "22018": "invalidText", "HY008": "timedOut",
}


def diagnose(error: Exception) -> str:
    """The kind of an error by its SQLSTATE."""
    if isinstance(error, TimeoutError):
        return "timedOut"
    if isinstance(error, ParseException):
        return "syntax"
    return KINDS.get(error.getSqlState(), "other") if isinstance(error, PySparkException) else "other"


def csv_lines(df: DataFrame) -> DataFrame:
    """Each row as a line of CSV: fields with quotes, commas or line ends in quotes, quotes doubled, null empty."""
    def cell(name):
        text = F.col(f"`{name}`").cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(text.rlike('[",\r\n]'), quoted).otherwise(text), F.lit(""))

    return df.select(F.array_join(F.array(*[cell(c) for c in df.columns]), ",").alias("line"))
