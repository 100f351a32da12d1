"""A session of inspections: a budget of calls and bytes, and handles of tables and columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

#: Calls a session, bytes a result and bytes a session (fixed values).
CALLS, RESULT_BYTES, SESSION_BYTES = 4, 8_000, 20_000


class Refused(ValueError):
    """An inspection that doesn't run; ``reason`` says why."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason


@dataclass
class Session:
    """``columns`` maps each table to its columns, ``fingerprint`` names that version of the catalog. Values of rows
    may be seen only if ``values_allowed`` (a local audience). Once the budget is spent, it stays spent."""

    columns: dict[str, tuple[str, ...]]
    fingerprint: str
    values_allowed: bool = True
    calls: int = 0
    sent: int = 0
    exhausted: bool = False
    log: list[str] = field(default_factory=list)

    def handle(self, table: str, column: str | None = None) -> str:
        return f"{self.fingerprint}/{'column' if column else 'table'}/{table}" + (f"/{column}" if column else "")

    def resolve(self, handles: list[str], kind: str, table: str | None = None) -> list[tuple[str, ...]]:
        """(table,) or (table, column) of each handle; refuses duplicates, unknown and stale ones, those of another
        kind, and columns of another table than ``table``."""
        if len(set(handles)) < len(handles):
            raise Refused("duplicate handle")
        out = []
        for h in handles:
            version, _, rest = h.partition("/")
            found, _, path = rest.partition("/")
            names = tuple(path.split("/"))
            if version != self.fingerprint and found in ("table", "column"):
                raise Refused("stale handle", h)
            if names[0] not in self.columns or (found == "column" and (len(names) != 2 or names[1] not in self.columns[names[0]])):
                raise Refused("unknown handle", h)
            if found != kind:
                raise Refused("wrong kind", h)
            if table is not None and names[0] != table:
                raise Refused("column of another table", h)
            out.append(names)
        return out

    def show(self, df: DataFrame, rows: int, shows_values: bool = False) -> list[dict]:
        """At most ``rows`` rows; fewer, by halves, until the result fits its bytes. Counts against the budget."""
        if shows_values and not self.values_allowed:
            raise Refused("values not allowed")
        if self.exhausted or self.calls >= CALLS:
            self.exhausted = True
            raise Refused("budget exhausted")
        self.calls += 1
        found = [r.asDict(recursive=True) for r in df.limit(rows).collect()]
        while len(text := json.dumps(found, default=str, ensure_ascii=False).encode()) > RESULT_BYTES and found:
            found = found[: len(found) // 2]
        if self.sent + len(text) > SESSION_BYTES:
            self.exhausted = True
            raise Refused("budget exhausted")
        self.sent += len(text)
        return found
