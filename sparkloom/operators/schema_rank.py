"""The ranking of a catalog's tables by whole points, the tables that a packed catalog must hold, and its compaction.

All frames here are metadata: a row a table, column or constraint."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.columns import ranker_tokens
from sparkloom.operators.schema_search import SCHEMA, relation_names

#: Words of a question that ask for a time (fixed values).
TEMPORAL_WORDS = (
    "today", "yesterday", "week", "month", "year", "day", "date", "time", "recent",
    "last", "next", "since", "between", "before", "after",
)
#: Points a hit, and at most, by part (fixed values).
REFERENCED, NAME, COLUMN, TEMPORAL, CONTEXT, BINDING, FAILED, DIAGNOSED, REPLACEMENT, NEIGHBOUR = 500, 150, 50, 100, 30, 70, 50, 80, 900, 80
MOST_CONTEXT, MOST_BINDING, MOST_COLUMNS = 150, 350, 30
#: Scores from which a table lifts its neighbours, and from which its match is strong; the lead of a dominant one (fixed values).
HIGH, STRONG, LEAD = 150, 140, 100


@dataclass(frozen=True)
class Request:
    """What is asked, and what is known of a statement that failed."""

    question: str
    searches: tuple[str, ...] = ()
    context: str = ""
    bindings: tuple[str, ...] = ()
    sql: str = ""
    forbidden: tuple[str, ...] = ()
    #: all texts of the error, the identifier that it names, and whether it is a missing relation
    diagnostic: str = ""
    named: str = ""
    missing_relation: bool = False


def _words(*texts: str) -> Column:
    return ranker_tokens(F.lit(" ".join(texts).replace('"', "")))


def temporal_intent(text: Column) -> Column:
    return F.arrays_overlap(ranker_tokens(F.replace(text, F.lit('"'), F.lit(""))), F.array(*map(F.lit, TEMPORAL_WORDS)))


def temporal_column(name: Column, type_: Column) -> Column:
    return F.lower(type_).rlike("date|time") | F.lower(name).rlike("_at$|date|time|scheduled")


def table_words(cols: DataFrame, check_rows: DataFrame) -> DataFrame:
    """(table_name, name_words, words, temporal, n_columns) of every table; ``words`` are those of its schema, name,
    columns, listed values and CHECK expressions, each once."""
    schema, name = ranker_tokens(F.lit(SCHEMA)), ranker_tokens(F.col("table_name"))
    texts = check_rows.select("table_name", F.explode(F.concat("allowed", F.array("expression"))).alias("text"))
    listed = texts.groupBy("table_name").agg(F.flatten(F.collect_list(ranker_tokens(F.col("text")))).alias("listed"))
    own = cols.groupBy("table_name").agg(
        F.flatten(F.collect_list(ranker_tokens(F.col("column_name")))).alias("own"),
        F.max(temporal_column(F.col("column_name"), F.col("type"))).alias("temporal"), F.count(F.lit(1)).alias("n_columns"),
    )
    none = F.array().cast("array<string>")
    words = F.array_distinct(F.concat(schema, name, "own", F.coalesce("listed", none)))
    return own.join(listed, "table_name", "left").select("table_name", name.alias("name_words"), words.alias("words"), "temporal", "n_columns")


def ranked(cols: DataFrame, fks: DataFrame, check_rows: DataFrame, request: Request) -> DataFrame:
    """(place, table_name, score, named, bound, replacement, referenced, neighbour) of all tables, by score and name."""
    words, bare, full = F.col("words"), F.lower("table_name"), F.concat(F.lit(f"{SCHEMA}."), F.lower("table_name"))
    asked = _words(request.question, *request.searches)
    refused = _words(*request.forbidden, request.named)

    def hits(tokens: Column, among: Column) -> Column:
        return F.size(F.array_intersect(tokens, among))

    used = relation_names(F.lit(request.sql))
    named, bound = hits(asked, F.col("name_words")), hits(_words(*request.bindings), words)
    replaces = (F.size(refused) > 0) & (hits(refused, F.col("name_words")) >= F.greatest(F.lit(1), F.size(refused) - 1))
    referenced = F.array_contains(used, bare) | F.array_contains(used, full)
    when = temporal_intent(F.lit(request.question)) & F.col("temporal")

    def worth(condition: Column, points: int) -> Column:
        return F.when(condition, points).otherwise(0)

    score = (
        worth(referenced, REFERENCED) + named * NAME + hits(asked, F.array_except(words, "name_words")) * COLUMN + worth(when, TEMPORAL)
        + F.least(hits(_words(request.context), words) * CONTEXT, F.lit(MOST_CONTEXT)) + F.least(bound * BINDING, F.lit(MOST_BINDING))
        + hits(_words(request.sql, *request.forbidden), words) * FAILED + hits(_words(request.diagnostic), words) * DIAGNOSED + worth(replaces, REPLACEMENT)
        - F.least(F.floor(F.col("n_columns") / 8), F.lit(MOST_COLUMNS))
    )
    parts = [(named > 0).alias("named"), (bound > 0).alias("bound"), replaces.alias("replacement"), referenced.alias("referenced")]
    scored = table_words(cols, check_rows).select("table_name", score.cast("long").alias("score"), *parts)
    high = scored.where(F.col("score") >= HIGH).select(F.col("table_name").alias("other"))
    ends = fks.select(F.col("from_table").alias("table_name"), F.col("to_table").alias("other"))
    near = ends.union(ends.select("other", "table_name")).join(high, "other", "left_semi").select("table_name").distinct()
    met = scored.join(near.withColumn("near", F.lit(True)), "table_name", "left")
    neighbour = (F.col("score") < HIGH) & F.coalesce("near", F.lit(False))
    out = met.withColumn("neighbour", neighbour).withColumn("score", F.col("score") + worth(F.col("neighbour"), NEIGHBOUR)).drop("near")
    # a window over a row a table
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.asc("table_name")))
    return out.select(place.alias("place"), "table_name", "score", "named", "bound", "replacement", "referenced", "neighbour")


def level(budget: int, request: Request) -> str:
    """How much a packed catalog of ``budget`` characters tells of a table: minimal, focused or full."""
    if budget < 1200:
        return "minimal"
    failed = request.diagnostic or request.named or request.missing_relation or request.forbidden
    return "focused" if budget < 5000 or failed else "full"


def pinned(ranks: DataFrame, request: Request, detail: str = "full") -> DataFrame:
    """(table_name) of the tables that are packed whatever their place: those that the statement or a search names; for a
    missing relation the replacements among the first three; in a minimal one the dominant table, strong by its name or
    a binding and ``LEAD`` points ahead of a second strong one."""
    sought = [x.replace('"', "").replace(" ", "").lower() for x in request.searches]
    bare, full = F.lower("table_name"), F.concat(F.lit(f"{SCHEMA}."), F.lower("table_name"))
    keep = F.col("referenced") | bare.isin(*sought) | full.isin(*sought)
    if request.missing_relation:
        keep |= (F.col("place") <= 3) & F.col("replacement")
    if detail == "minimal":
        strong = (F.col("score") >= STRONG) & (F.col("named") | F.col("bound"))
        second = F.lead(F.when(strong, F.col("score"))).over(Window.orderBy("place"))
        ranks = ranks.withColumn("dominant", (F.col("place") == 1) & strong & (second.isNull() | (F.col("score") - second >= LEAD)))
        keep |= F.col("dominant")
    return ranks.where(keep).select("table_name")


def compacted(cards: DataFrame, most_columns: int, most_hits: int, budget: int) -> DataFrame:
    """(hit, table_name, place, column_name, bytes, fits): the rows of ``cards`` (hit, table_name, place, column_name)
    that are shown. The columns of a table are halved down to one, and then the last hits dropped down to one, until the
    lines ``table.column`` fit into ``budget`` bytes; what is left then doesn't have to fit."""
    states, columns, n = [], most_columns, most_hits
    while True:
        states.append(F.struct(F.lit(len(states)).alias("k"), F.lit(columns).alias("columns"), F.lit(n).alias("hits")))
        if columns > 1:
            columns //= 2
        elif n > 1:
            n -= 1
        else:
            break
    shown = cards.withColumn("s", F.explode(F.array(*states))).where("hit <= s.hits AND place <= s.columns")
    line = F.octet_length(F.concat_ws(".", "table_name", "column_name")) + 1
    sizes = shown.groupBy("s").agg(F.sum(line).alias("bytes")).withColumn("fits", F.col("bytes") <= budget)
    # the first state that fits, or the last one
    chosen = sizes.agg(F.min_by(F.struct("s", "bytes", "fits"), F.struct(~F.col("fits"), F.when(F.col("fits"), F.col("s.k")).otherwise(-F.col("s.k")))).alias("c")).select("c.*")
    return shown.join(F.broadcast(chosen), "s").select("hit", "table_name", "place", "column_name", "bytes", "fits")
