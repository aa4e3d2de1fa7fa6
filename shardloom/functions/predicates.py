"""Predicates over a schema, with SQL's null logic or the two-valued one."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatch, UnknownColumn
from ..plans.spec import Ago, And, Comparison, Or, Predicate
from ..types import Tag, tag_of

_OPERATORS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}
#: Where null is the smallest of all values, these hold for a null cell.
_TRUE_FOR_NULL = {"<", "<=", "!="}


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_of(name: str, schema: T.StructType) -> Column:
    if name not in schema.names:
        raise UnknownColumn(f"no column {name!r}; there are {', '.join(schema.names)}")
    return F.col(quote(name))


def predicate(spec: Predicate, schema: T.StructType, now_ms: int, two_valued: bool = False) -> Column:
    """``spec`` as a column. ``now_ms`` stands for NOW()."""
    if isinstance(spec, And):
        return reduce(lambda a, b: a & b, (predicate(p, schema, now_ms, two_valued) for p in spec.parts))
    if isinstance(spec, Or):
        return reduce(lambda a, b: a | b, (predicate(p, schema, now_ms, two_valued) for p in spec.parts))
    return _comparison(spec, schema, now_ms, two_valued)


def _comparison(c: Comparison, schema: T.StructType, now_ms: int, two_valued: bool) -> Column:
    column = column_of(c.column, schema)
    kind = schema[c.column].dataType
    tag = tag_of(kind)
    if c.operator in ("like", "not like"):
        if tag is not Tag.STRING:
            raise TypeMismatch(f"LIKE on {c.column} of {tag.value}")
        # a backslash is a character like any other
        found = column.like(c.value.replace("\\", "\\\\"))
        out = found if c.operator == "like" else ~found
        return F.coalesce(out, F.lit(c.operator == "not like")) if two_valued else out
    if c.value is None:
        if two_valued:
            # null is the smallest value and equal to itself
            always = {"=": column.isNull(), "!=": column.isNotNull(), "<": F.lit(False), "<=": column.isNull(), ">": column.isNotNull(), ">=": F.lit(True)}
            return always[c.operator]
        return _OPERATORS[c.operator](column, F.lit(None).cast(kind))
    out = _OPERATORS[c.operator](column, literal(c.value, kind, c.column, now_ms))
    return F.coalesce(out, F.lit(c.operator in _TRUE_FOR_NULL)) if two_valued else out


def literal(value: object, kind: T.DataType, name: str, now_ms: int) -> Column:
    """A literal as a value of the column's type, or a TypeMismatch."""
    tag = tag_of(kind)
    if isinstance(value, Ago):
        value = now_ms - value.interval_ms
    if tag is Tag.TIMESTAMP:
        return _time(value, kind, name)
    if tag is Tag.BOOL and isinstance(value, bool) or tag is Tag.STRING and isinstance(value, str):
        return F.lit(value)
    if tag in (Tag.INT64, Tag.FLOAT64) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.lit(value)
    raise TypeMismatch(f"{name} is {tag.value}; {value!r} isn't")


def _time(value: object, kind: T.DataType, name: str) -> Column:
    """Epoch milliseconds, or an ISO date or time, as a constant that a scan can be pruned by."""
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise TypeMismatch(f"{name} is a time; {value!r} isn't")
    if isinstance(value, str):
        try:
            when = dt.datetime.fromisoformat(value.strip())
        except ValueError:
            raise TypeMismatch(f"{name} is a time; {value!r} isn't") from None
        when = when.astimezone(dt.UTC) if when.tzinfo else when.replace(tzinfo=dt.UTC)
    else:
        when = dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(milliseconds=value)
    if isinstance(kind, T.TimestampType):
        return F.lit(when)
    plain = F.lit(when.replace(tzinfo=None).isoformat(sep=" ", timespec="microseconds"))
    return plain.cast("timestamp_ntz")


def time_bounds(spec: Predicate | None, column: str, now_ms: int) -> tuple[int | None, int | None]:
    """[first, end) in epoch milliseconds outside of which ``spec`` never holds; None for no bound."""
    if spec is None or isinstance(spec, Or):
        parts = [time_bounds(p, column, now_ms) for p in spec.parts] if spec else [(None, None)]
        lows, highs = [p[0] for p in parts], [p[1] for p in parts]
        return (None if None in lows else min(lows)), (None if None in highs else max(highs))
    if isinstance(spec, And):
        parts = [time_bounds(p, column, now_ms) for p in spec.parts]
        lows, highs = [p[0] for p in parts if p[0] is not None], [p[1] for p in parts if p[1] is not None]
        return max(lows, default=None), min(highs, default=None)
    value = spec.value
    if isinstance(value, Ago):
        value = now_ms - value.interval_ms
    if isinstance(value, str) and spec.column == column:
        try:
            when = dt.datetime.fromisoformat(value.strip())
        except ValueError:
            return None, None
        when = when if when.tzinfo else when.replace(tzinfo=dt.UTC)
        micros = (when - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
        value = micros / 1000
    if spec.column != column or isinstance(value, bool) or not isinstance(value, (int, float)):
        return None, None
    floor, ceil = int(value // 1), -int(-value // 1)
    bounds = {"=": (floor, floor + 1), ">=": (floor, None), ">": (floor, None), "<": (None, ceil), "<=": (None, floor + 1)}
    return bounds.get(spec.operator, (None, None))
