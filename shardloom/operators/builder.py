"""Query text from the state of a form, and the time ranges it zooms through."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..functions.time import auto_bucket, preset_bucket, range_start
from ..types import TIME_COLUMN

_PLAIN = {"=", "!=", "<", "<=", ">", ">="}


@dataclass(frozen=True)
class TimeRange:
    preset: str = "all"
    start: int | None = None
    end: int | None = None

    def bucket(self) -> str:
        if self.start is not None and self.end is not None:
            return auto_bucket(self.end - self.start)
        return preset_bucket(self.preset)

    def bounds(self, now_ms: int) -> tuple[int | None, int | None]:
        if self.start is not None or self.end is not None:
            return self.start, self.end
        return range_start(self.preset, now_ms), None


@dataclass(frozen=True)
class QueryState:
    table: str
    metrics: tuple[tuple[str, str], ...] = ()  # (function, column or *)
    group_by: tuple[str, ...] = ()
    filters: tuple[tuple[str, str, object], ...] = ()  # (column, operator, value); operators also: contains
    time_range: TimeRange = field(default_factory=TimeRange)


def identifier(name: str) -> str:
    """A column or table as query text; quoted only where it must be."""
    parts = name.split(".")
    if all(p.isidentifier() or p.isdigit() and i for i, p in enumerate(parts)):
        return name
    return '"' + name.replace('"', '""') + '"'


def text_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def conditions(state: QueryState, now_ms: int) -> list[str]:
    out = []
    start, end = state.time_range.bounds(now_ms)
    if start is not None:
        out.append(f"{TIME_COLUMN} >= {start}")
    if end is not None:
        out.append(f"{TIME_COLUMN} <= {end}")
    for column, operator, value in state.filters:
        if operator == "contains":
            out.append(f"{identifier(column)} LIKE {text_literal(f'%{value}%')}")
        elif operator in _PLAIN:
            out.append(f"{identifier(column)} {operator} {text_literal(value)}")
        else:
            raise ValueError(f"unknown operator {operator!r}")
    return out


def build_query(state: QueryState, chart: str = "bar", now_ms: int = 0) -> str:
    """Metrics by groups; line and area charts with groups also by the time bucket that suits the range."""
    series = chart in ("line", "area") and bool(state.group_by)
    keys = [identifier(g) for g in state.group_by]
    if series:
        keys.insert(0, f"TIME_BUCKET('{state.time_range.bucket()}', {TIME_COLUMN})")
    metrics = [f"{f}({c if c == '*' else identifier(c)})" for f, c in state.metrics]
    text = f"SELECT {', '.join([*keys, *metrics] or ['COUNT(*)'])} FROM {identifier(state.table)}"
    where = conditions(state, now_ms)
    text += f" WHERE {' AND '.join(where)}" if where else ""
    text += f" GROUP BY {', '.join(keys)}" if keys else ""
    return text + (f" ORDER BY {keys[0]}" if keys and not series else "")


def sample_query(state: QueryState, now_ms: int = 0) -> str:
    """The newest 100 rows."""
    where = conditions(state, now_ms)
    text = f"SELECT * FROM {identifier(state.table)}" + (f" WHERE {' AND '.join(where)}" if where else "")
    return text + f" ORDER BY {TIME_COLUMN} DESC LIMIT 100"


class Zoom:
    """A stack of time ranges over a state."""

    def __init__(self, state: QueryState):
        self.states = [state]

    @property
    def state(self) -> QueryState:
        return self.states[-1]

    def into(self, times: list[int]) -> QueryState:
        """Zoom to the selected times; fewer than two change nothing."""
        if len(times) > 1:
            self.states.append(replace(self.state, time_range=TimeRange("custom", min(times), max(times))))
        return self.state

    def out(self) -> QueryState:
        if len(self.states) > 1:
            self.states.pop()
        return self.state
