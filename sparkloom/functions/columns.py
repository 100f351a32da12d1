"""Column expressions that several operators share; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """An amount of money as a whole number of cents: sums of it don't depend on their order."""
    return F.round(amount * 100).cast("long")


def search_tokens(text: Column) -> Column:
    """Search tokens of an identifier or phrase, in order, each once: camel case and letter-digit
    borders split, lower case, and next to each plural its singular (ies to y and es dropped above four
    letters, s above three)."""
    spaced = F.regexp_replace(text, r"(\p{Ll}|\p{Nd})(\p{Lu})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{L})(\p{Nd})", "$1 $2")
    spaced = F.regexp_replace(spaced, r"(\p{Nd})(\p{L})", "$1 $2")
    words = F.filter(F.split(F.lower(spaced), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def singular(w: Column) -> Column:
        n = F.length(w)
        return (
            F.when(w.endswith("ies") & (n > 4), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
            .when(w.endswith("es") & (n > 4), F.substring(w, F.lit(1), n - 2))
            .when(w.endswith("s") & (n > 3), F.substring(w, F.lit(1), n - 1))
        )

    return F.array_distinct(F.array_compact(F.flatten(F.transform(words, lambda w: F.array(w, singular(w))))))


def ranker_tokens(text: Column) -> Column:
    """The other tokenizer: only lower-to-upper borders split, sorted, no es rule, ies above three."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"(\p{Ll})(\p{Lu})", "$1 $2")), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def singular(w: Column) -> Column:
        n = F.length(w)
        return F.when(w.endswith("ies") & (n > 3), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y"))).when(
            w.endswith("s") & (n > 3), F.substring(w, F.lit(1), n - 1)
        )

    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.transform(words, lambda w: F.array(w, singular(w)))))))


def edit_distance(a: Column, b: Column, limit: int) -> Column:
    """Levenshtein distance, limit + 1 for all that is farther."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def similarity(asked: Column, found: Column) -> Column:
    """1 if equal; .28 if one is a prefix of the other; .16 if the found word holds the asked one, of four
    letters or more; .42 and .24 for an edit distance of 1 and 2 of words of six letters and more (2 only
    from nine on); else 0, as for words under three letters. The first that holds counts."""
    n, m = F.length(asked), F.length(found)
    d = edit_distance(asked, found, 2)
    return (
        F.when(asked == found, 1.0)
        .when((n < 3) | (m < 3), 0.0)
        .when(found.startswith(asked) | asked.startswith(found), 0.28)
        .when((n >= 4) & F.contains(found, asked), 0.16)
        .when((n >= 6) & (m >= 6) & (d == 1), 0.42)
        .when((n >= 9) & (m >= 9) & (d == 2), 0.24)
        .otherwise(0.0)
    )


def sanitized(text: Column, most: int = 2048) -> Column:
    """Control characters as spaces, at most ``most`` characters."""
    return F.left(F.regexp_replace(text, r"\p{Cc}", " "), F.lit(most))


def needs_quotes(name: Column) -> Column:
    """Whether an identifier can't stand unquoted."""
    return ~name.rlike("^[a-z_][a-z0-9_$]*$")


def capped_hex(data: Column, most: int = 256) -> Column:
    """Lower-case hexadecimal of the first ``most`` bytes, an ellipsis after it if there are more."""
    shown = F.concat(F.lit("\\x"), F.lower(F.hex(F.substring(data, 1, most))))
    return F.when(F.octet_length(data) > most, F.concat(shown, F.lit("…"))).otherwise(shown)


def nearest_rank(values: Column, p: float) -> Column:
    """The percentile by nearest rank, position round((n - 1) * p) half up, of a sorted array."""
    return F.element_at(values, (F.floor((F.size(values) - 1) * p + 0.5) + 1).cast("int"))


def check_values(expression: Column) -> Column:
    """The string literals of a CHECK expression, each once in their order, doubled quotes as one; none if the
    expression compares otherwise than by IN, = ANY (ARRAY[...]) or = or holds NOT."""
    outside = F.lower(F.regexp_replace(expression, r"'(?:''|[^'])*'", "''"))
    positive = F.lower(expression).rlike(r"\bin\s*\(|=\s*any\s*\(\s*array\s*\[|=\s*'") & ~outside.rlike(r"[<>]|!=|!~|\bnot\b")
    found = F.regexp_extract_all(expression, F.lit(r"'((?:''|[^'])*)'"), F.lit(1))
    values = F.array_distinct(F.transform(found, lambda v: F.replace(v, F.lit("''"), F.lit("'"))))
    return F.when(positive, values).otherwise(F.array().cast("array<string>"))


_NAME = r'(?:[A-Za-z_][A-Za-z0-9_$]*|"(?:""|[^"])+")'
_TARGET = rf"(?:{_NAME}\.)?{_NAME}"
_ALIAS = rf"(?:\s+(?:as\s+)?{_NAME})?"
_END = r"\s*(?:--[^\n\r]*|/\*(?s:.*?)\*/)?\s*;?\s*$"
#: What the text of a statement begins with.
DIRECT_SQL = (
    r"(?i)^\s*(?:(?:select|with)\b"
    rf"|insert\s+into\s+{_TARGET}\s*(?:\([^)]*\)\s*)?(?:default\s+values|values\s*\(|(?:select|with)\b)"
    rf"|delete\s+from\s+(?:only\s+)?{_TARGET}{_ALIAS}(?:{_END}|\s+(?:where|using|returning)\b)"
    rf"|update\s+(?:only\s+)?{_TARGET}{_ALIAS}\s+set\s+[^=]+=)"
)


def direct_sql(text: Column) -> Column:
    """Whether a text reads as a statement rather than as a question. One that opens with a comment doesn't."""
    return text.rlike(DIRECT_SQL)
