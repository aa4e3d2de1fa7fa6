"""The six type tags, their merging, and how they map to Spark's types."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from enum import Enum
from functools import reduce

from pyspark.sql import types as T

TIME_COLUMN = "timestamp"


class Tag(Enum):
    NULL = "NULL"
    BOOL = "BOOL"
    INT64 = "INT64"
    FLOAT64 = "FLOAT64"
    STRING = "STRING"
    TIMESTAMP = "TIMESTAMP"


_TO_SPARK = {
    Tag.NULL: T.NullType(),
    Tag.BOOL: T.BooleanType(),
    Tag.INT64: T.LongType(),
    Tag.FLOAT64: T.DoubleType(),
    Tag.STRING: T.StringType(),
    Tag.TIMESTAMP: T.TimestampType(),
}
_WIDER = {
    frozenset((Tag.INT64, Tag.FLOAT64)): Tag.FLOAT64,
    frozenset((Tag.INT64, Tag.TIMESTAMP)): Tag.INT64,
}


def merge_tags(a: Tag, b: Tag) -> Tag:
    """The tag that holds values of both: null yields, numbers widen, anything else becomes a string."""
    if a is b or b is Tag.NULL:
        return a
    if a is Tag.NULL:
        return b
    return _WIDER.get(frozenset((a, b)), Tag.STRING)


def merge_all(tags: Iterable[Tag]) -> Tag:
    return reduce(merge_tags, tags, Tag.NULL)


def infer_tag(value: object, key: str) -> Tag:
    """The tag of a JSON value; an integer under the key ``timestamp`` is a time in epoch milliseconds."""
    if value is None:
        return Tag.NULL
    if isinstance(value, bool):
        return Tag.BOOL
    if isinstance(value, int):
        if not -(2**63) <= value < 2**63:
            return Tag.FLOAT64
        return Tag.TIMESTAMP if key == TIME_COLUMN else Tag.INT64
    if isinstance(value, float):
        return Tag.FLOAT64
    if isinstance(value, (dt.datetime, dt.date)):
        return Tag.TIMESTAMP
    return Tag.STRING


def spark_type(tag: Tag) -> T.DataType:
    return _TO_SPARK[tag]


def tag_of(kind: T.DataType) -> Tag:
    if isinstance(kind, T.NullType):
        return Tag.NULL
    if isinstance(kind, T.BooleanType):
        return Tag.BOOL
    if isinstance(kind, T.IntegralType):
        return Tag.INT64
    if isinstance(kind, T.NumericType):
        return Tag.FLOAT64
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Tag.TIMESTAMP
    return Tag.STRING


def schema_tags(schema: T.StructType) -> dict[str, Tag]:
    return {f.name: tag_of(f.dataType) for f in schema}


def epoch_ms(value: object) -> object:
    """A cell as the API answers with it: times are epoch milliseconds."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is None:
            value = value.replace(tzinfo=dt.UTC)
        return (value - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1)
    if isinstance(value, dt.date):
        return (value - dt.date(1970, 1, 1)).days * 86_400_000
    return value


def row_bytes(tags: Iterable[Tag]) -> int:
    """A rough size of a row, for statistics."""
    size = {Tag.NULL: 1, Tag.BOOL: 2, Tag.INT64: 9, Tag.FLOAT64: 9, Tag.STRING: 24, Tag.TIMESTAMP: 9}
    return max(16, sum(size[t] for t in tags))
