"""Column statistics per time bucket, and distinct summaries of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import quote
from ..functions.time import time_bucket
from ..types import TIME_COLUMN, Tag, schema_tags


def numeric_columns(df: DataFrame, time_column: str = TIME_COLUMN) -> list[str]:
    return [n for n, t in schema_tags(df.schema).items() if t in (Tag.INT64, Tag.FLOAT64) and n != time_column]


def rollup(df: DataFrame, every: str | int, columns: Sequence[str] | None = None, time_column: str = TIME_COLUMN) -> DataFrame:
    """A row per bucket: ``bucket``, and <column>_count, _sum, _avg, _min and _max of numeric columns.

    A column that is null throughout a bucket has count 0 and nulls.
    """
    columns = list(columns) if columns is not None else numeric_columns(df, time_column)
    aggregates = []
    for c in columns:
        value = F.col(quote(c)).cast("double")
        for name, f in (("count", F.count), ("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max)):
            aggregates.append(f(value).alias(f"{c}_{name}"))
    bucket = time_bucket(every, F.col(quote(time_column))).alias("bucket")
    return df.groupBy(bucket).agg(*(aggregates or [F.count(F.lit(1)).alias("rows")]))


def pivot_series(df: DataFrame, x: str, series: str, metric: str, values: Sequence | None = None) -> DataFrame:
    """A row per ``x``, a column per value of ``series``. Of several metrics in one cell the largest shows."""
    pivoted = df.groupBy(F.col(quote(x)))
    pivoted = pivoted.pivot(series, list(values)) if values is not None else pivoted.pivot(series)
    return pivoted.agg(F.max(F.col(quote(metric))))


def classify_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """(dimensions, metrics): numbers are metrics unless their name says they are times."""
    dimensions, metrics = [], []
    for name, tag in schema_tags(df.schema).items():
        timelike = any(w in name.lower() for w in ("time", "date", "bucket"))
        (metrics if tag in (Tag.INT64, Tag.FLOAT64) and not timelike else dimensions).append(name)
    return dimensions, metrics
