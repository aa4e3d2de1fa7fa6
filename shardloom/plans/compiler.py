"""A parsed query as a DataFrame plan; Catalyst does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotGrouped, TypeMismatch, UnknownColumn
from ..functions.aggregates import aggregate, is_small, nearest_rank, percentiles
from ..functions.predicates import column_of, predicate, quote
from ..functions.time import time_bucket
from ..types import Tag, tag_of
from .spec import Aggregate, Bucket, ColumnRef, Expression, QuerySpec, Star


def compile_query(spec: QuerySpec, df: DataFrame, now_ms: int, two_valued: bool = False) -> DataFrame:
    """The result of ``spec`` over ``df``."""
    if spec.where is not None:
        df = df.filter(predicate(spec.where, df.schema, now_ms, two_valued))
    if spec.group_by or any(isinstance(i.expression, Aggregate) for i in spec.items):
        return _grouped(spec, df)
    return _plain(spec, df)


def output_names(spec: QuerySpec, columns: list[str]) -> list[str]:
    """The result's column names, with ``*`` expanded."""
    out = []
    for i, item in enumerate(spec.items):
        e = item.expression
        if isinstance(e, Star):
            out += columns
        elif item.alias:
            out.append(item.alias)
        elif isinstance(e, Bucket):
            out.append(f"time_bucket_{i}")
        else:
            out.append(e.label if isinstance(e, Aggregate) else e.name)
    return out


def _value(e: Expression, df: DataFrame) -> Column:
    if isinstance(e, Bucket):
        column = column_of(e.column, df.schema)
        tag = tag_of(df.schema[e.column].dataType)
        if tag is Tag.INT64:
            return time_bucket(e.interval_ms, F.timestamp_millis(column))
        if tag is not Tag.TIMESTAMP:
            raise TypeMismatch(f"TIME_BUCKET of {e.column}, which is {tag.value}")
        return time_bucket(e.interval_ms, column)
    assert isinstance(e, ColumnRef)
    return column_of(e.name, df.schema)


def _plain(spec: QuerySpec, df: DataFrame) -> DataFrame:
    columns: list[Column] = []
    for item in spec.items:
        if isinstance(item.expression, Star):
            columns += [F.col(quote(c)) for c in df.columns]
        else:
            columns.append(_value(item.expression, df))
    names = output_names(spec, df.columns)
    aliases = {i.alias: i.expression for i in spec.items if i.alias}
    if spec.order_by:
        keys = []
        for key in spec.order_by:
            e = key.expression
            if isinstance(e, ColumnRef) and e.name in aliases:
                e = aliases[e.name]
            elif isinstance(e, ColumnRef) and e.name in names and e.name not in df.columns:
                keys.append(_direction(columns[names.index(e.name)], key.descending))
                continue
            if isinstance(e, Aggregate):
                raise NotGrouped(f"ORDER BY {e.label} without aggregates")
            keys.append(_direction(_value(e, df), key.descending))
        df = df.orderBy(*keys)  # before the projection, so that any column can order
    if spec.limit is not None:
        df = df.limit(spec.limit)
    return df.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)))


def _direction(column: Column, descending: bool) -> Column:
    return column.desc_nulls_last() if descending else column.asc_nulls_first()


def _grouped(spec: QuerySpec, df: DataFrame) -> DataFrame:
    aliases = {i.alias: i.expression for i in spec.items if i.alias}
    names = output_names(spec, df.columns)
    positional = {n: i.expression for n, i in zip(names, spec.items, strict=True)} if len(names) == len(spec.items) else {}

    def resolve(e: Expression) -> Expression:
        """A bare name is a column of the table, else an alias or a default name."""
        if isinstance(e, ColumnRef) and e.name not in df.columns:
            return aliases.get(e.name) or positional.get(e.name) or e
        return e

    keys: list[Expression] = []
    for e in map(resolve, spec.group_by):
        if isinstance(e, (Aggregate, Star)):
            raise NotGrouped("GROUP BY an aggregate")
        if e not in keys:
            keys.append(e)
    for item in spec.items:
        if isinstance(item.expression, Star):
            raise NotGrouped("* with GROUP BY or aggregates")
        if not isinstance(item.expression, Aggregate) and item.expression not in keys:
            raise NotGrouped(f"{names[spec.items.index(item)]} is neither grouped nor aggregated")
    wanted = [i.expression for i in spec.items if isinstance(i.expression, Aggregate)]
    orders: list[tuple[Expression, bool]] = []
    for key in spec.order_by:
        e = key.expression
        if isinstance(e, ColumnRef):
            e = aliases.get(e.name) or (e if e in keys else positional.get(e.name) or e)
        if isinstance(e, Aggregate):
            wanted.append(e)
        elif e not in keys:
            raise UnknownColumn(f"ORDER BY {getattr(e, 'name', e)}, which is neither grouped nor aggregated")
        orders.append((e, key.descending))
    slots = {e: f"__a{i}" for i, e in enumerate(dict.fromkeys(wanted))}
    by = {e: f"__g{i}" for i, e in enumerate(keys)}
    out = _aggregated(df, by, slots)
    if orders:
        out = out.orderBy(*(_direction(F.col(slots.get(e) or by[e]), d) for e, d in orders))
    if spec.limit is not None:
        out = out.limit(spec.limit)
    return out.select(*(F.col(slots.get(i.expression) or by[i.expression]).alias(n) for i, n in zip(spec.items, names, strict=True)))


def _aggregated(df: DataFrame, by: dict[Expression, str], slots: dict[Aggregate, str]) -> DataFrame:
    """One row per group with the slots of its keys and aggregates."""
    plain = {e: s for e, s in slots.items() if e.function != "percentile"}
    ranked: dict[str, list[tuple[str, float]]] = {}
    for e, s in slots.items():
        if e.function == "percentile":
            _number(df, e)
            ranked.setdefault(e.column, []).append((s, e.p))
    gathered = []
    if ranked and is_small(df):  # one pass with the other aggregates; beyond that size by ranks over many tasks
        gathered = [nearest_rank(F.col(quote(c)), p).alias(s) for c, picks in ranked.items() for s, p in picks]
        ranked = {}
    keys = [(s, _value(e, df)) for e, s in by.items()]
    columns = [aggregate(e.function, None if e.column is None else _argument(df, e)).alias(s) for e, s in plain.items()]
    columns = [*columns, *gathered] or [F.count(F.lit(1)).alias("__rows")]
    out = df.groupBy(*(c.alias(s) for s, c in keys)).agg(*columns) if keys else df.agg(*columns)
    for column, picks in ranked.items():
        found = percentiles(df, keys, F.col(quote(column)), picks)
        left, right = out.alias("l"), found.alias("r")
        same = [F.col(f"l.{s}").eqNullSafe(F.col(f"r.{s}")) for s, _ in keys] or [F.lit(True)]  # without keys both are one row
        out = left.join(right, same, "left").select("l.*", *(f"r.{s}" for s, _ in picks))
    return out


def _number(df: DataFrame, e: Aggregate) -> None:
    column_of(e.column, df.schema)
    tag = tag_of(df.schema[e.column].dataType)
    if tag not in (Tag.INT64, Tag.FLOAT64, Tag.TIMESTAMP, Tag.NULL):
        raise TypeMismatch(f"{e.function.upper()} of {e.column}, which is {tag.value}")


def _argument(df: DataFrame, e: Aggregate) -> Column:
    column = column_of(e.column, df.schema)
    if e.function in ("sum", "avg"):
        _number(df, e)
        if tag_of(df.schema[e.column].dataType) is Tag.TIMESTAMP:
            return F.unix_millis(column.cast("timestamp")).cast("double")
    return column
