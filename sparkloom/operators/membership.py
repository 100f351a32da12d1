"""Literals that a statement compares with a column although the column never holds them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from sparkloom.operators.bounded import _expressions, _seq


def _plans(plan) -> Iterator[tuple[str, object]]:
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node.getClass().getSimpleName(), node
        todo += _seq(node.children()) + _seq(node.subqueries()) + _seq(node.innerChildren())


def _name(x) -> str:
    return x.getClass().getSimpleName()


def unlisted_literals(spark: SparkSession, sql: str, allowed: dict[tuple[str, str], tuple[str, ...]]) -> list[tuple[str, str, str]]:
    """(table, column, literal), sorted, for strings that ``sql`` compares by = or IN, or their negation, with a column
    of a view whose ``allowed`` values don't hold them. Names are resolved by Spark's analyzer, so that aliases
    and subqueries don't matter; nothing runs."""
    plan = spark.sql(sql)._jdf.queryExecution().analyzed()
    owner: dict[int, tuple[str, str]] = {}
    nodes = list(_plans(plan))
    for name, node in nodes:
        # a view's columns keep their ids under the aliases above it
        if name == "SubqueryAlias" and _name(node.child()) == "View":
            for a in _seq(node.output()):
                owner.setdefault(a.exprId().id(), (node.identifier().name().lower(), a.name().lower()))
    found = set()
    for _, node in nodes:
        for x in _expressions(node):
            kids = _seq(x.children())
            if _name(x) not in ("EqualTo", "EqualNullSafe", "In") or len(kids) < 2:
                continue
            for column, others in ((kids[0], kids[1:]), (kids[-1], kids[:-1])):
                key = owner.get(column.exprId().id()) if _name(column) == "AttributeReference" else None
                if key not in allowed:
                    continue
                values = [str(v.value()) for v in others if _name(v) == "Literal" and v.value() is not None]
                found |= {(*key, v) for v in values if v not in allowed[key]}
    return sorted(found)
