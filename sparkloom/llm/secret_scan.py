"""Secret scans through a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived: every text that the
rule can match holds all trigrams of one of its alternatives. The index has a posting (trigram,
text key) for each trigram that some query names and each text that holds it; queries are answered
by counting a text's postings within an alternative. The candidates are then verified with the
expression itself. A rule without mandatory trigrams has no query and scans every text.

A text's key is a hash of its content, so copies share postings, and a clash of keys only adds a
candidate. Candidates go to the texts by broadcast while they are few, counted first, and by a
shuffle join otherwise. Spans are in code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as syntax

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.shared import small, written


@dataclass(frozen=True)
class Rule:
    """``least`` code points are asked of group ``group`` of each leftmost match of ``regex``."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)

#: Exact strings that a stretch of an expression is unfolded into, at most.
MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings that a parsed piece can match, lower-cased; None if they are many."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(value).lower()}
    if kind == "IN":
        if len(value) <= 8 and all(str(k) == "LITERAL" for k, _ in value):
            return {chr(v).lower() for _, v in value}
        return None
    if kind == "SUBPATTERN":
        return _joined(value[3])
    if kind == "BRANCH":
        parts = [_joined(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind == "MAX_REPEAT" and value[1] == 1:
        inner = _joined(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _joined(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(regex: str) -> list[frozenset[str]]:
    """Alternatives, each a set of trigrams; a matching text, lower-cased, holds all of one.

    Empty if nothing is mandatory. Stretches of exact strings give clauses; the clause with the
    most trigrams in its weakest alternative becomes the query.
    """
    clauses, run = [], {""}
    for node in [*syntax.parse(regex), None]:
        more = None if node is None else _strings(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        clauses.append(run)
        run = more or {""}
        if node is None and more:
            clauses.append(run)
    found = []
    for strings in clauses:
        sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings}
        if all(sets):
            found.append(sorted({a for a in sets if not any(b < a for b in sets)}, key=sorted))
    return max(found, key=lambda x: (min(map(len, x)), -len(x)), default=[])


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key): which texts hold which of the trigrams; copies of a text have one posting."""
    lower = F.lower(F.coalesce(F.col("text"), F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams]))
    rows = docs.select(_key(F.coalesce(F.col("text"), F.lit(""))).alias("key"), lower.alias("low"))
    return rows.select("key", F.explode(held).alias("trigram")).distinct()


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the texts that answer the query of each rule that has one."""
    rows = [
        (rule.kind, number, trigram, len(alternative))
        for rule in rules
        for number, alternative in enumerate(trigram_query(rule.regex))
        for trigram in sorted(alternative)
    ]
    spark = index.sparkSession
    asked = spark.createDataFrame(rows, "kind string, alternative int, trigram string, needed long")
    # the rules' own trigrams: some dozens of rows
    met = index.join(F.broadcast(asked), "trigram").groupBy("key", "kind", "alternative", "needed").count()
    return met.where("count = needed").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """The rule's matches in ``text`` as an array of {start, end}: gaps and matches take turns."""
    pattern = _long_enough(rule)
    regex = F.lit(pattern)
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    part = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, pattern, -1)
    pieces = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(whole)), F.length).alias("gap"),
        F.transform(whole, F.length).alias("long"),
        F.transform(part, F.length).alias("asked"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["long"]
        one = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["asked"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def scan(docs: DataFrame, keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (columns ``keep`` as the struct ``doc``) with ``found``: {start, rank, kind, end} of every
    secret, by start, then by the rules' order. Null texts count as empty and hold none; repeated rows
    have equal spans, and spans of different rules may start together or overlap. Works on empty tables."""
    kept = keep or docs.columns
    queried = [r for r in rules if trigram_query(r.regex)]
    trigrams = sorted({t for r in queried for a in trigram_query(r.regex) for t in a})
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("key", _key(F.col("text")))
    if trigrams:
        found = written(candidates(postings(docs.select("text"), trigrams), rules), "secret-candidates")
        rows = rows.join(small(found), "key", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    parts = []
    for rank, rule in enumerate(rules):
        found = spans(F.col("text"), rule)
        if rule in queried:
            found = F.when(F.array_contains("kinds", rule.kind), found).otherwise(none)
        else:  # no mandatory trigram: look whether there is any long enough match, then take its spans
            found = F.when(F.col("text").rlike(_long_enough(rule)), found).otherwise(none)
        parts.append(_placed(found, rank, rule.kind))
    return rows.select("doc", F.array_sort(F.concat(*parts)).alias("found"))


def _placed(found: Column, rank: int, kind: str) -> Column:
    """Spans of a rule as {start, rank, kind, end}."""

    def entry(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end"))

    return F.transform(found, entry)


def _long_enough(rule: Rule) -> str:
    """For a run of one class, the same run of at least ``least``, which matches the same long runs;
    else the expression."""
    single = re.fullmatch(r"(\[[^\]]+\])\+", rule.regex)
    return f"{single[1]}{{{rule.least},}}" if single and rule.least and not rule.group else rule.regex


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = [r.kind for r in RULES if r.base]
    found = scan(docs, ["doc_id"])

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc.doc_id",
        *[number(kind) for kind in base],
        F.sha2(listed(F.filter("found", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
