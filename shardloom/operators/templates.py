"""Ready-made analyses. Each takes the events' DataFrame and names of its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate, percentiles
from ..functions.predicates import quote
from ..functions.time import time_bucket
from ..types import TIME_COLUMN


def since(df: DataFrame, start_ms: int | None, time_column: str = TIME_COLUMN) -> DataFrame:
    """Rows from ``start_ms`` on; all for None."""
    if start_ms is None:
        return df
    return df.filter(F.col(quote(time_column)).cast("timestamp") >= F.timestamp_millis(F.lit(start_ms)))


def _col(name: str) -> Column:
    return F.col(quote(name))


def error_rate(df: DataFrame, column: str, value: object, bucket: str = "5 minutes", start_ms: int | None = None, time_column: str = TIME_COLUMN) -> DataFrame:
    """Per bucket: total and errors (rows whose ``column`` is ``value``)."""
    rows = since(df, start_ms, time_column)
    errors = F.sum(F.when(_col(column) == value, 1).otherwise(0)).cast("long")
    key = time_bucket(bucket, _col(time_column)).alias("bucket")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), errors.alias("errors")).orderBy("bucket")


def top_n(df: DataFrame, column: str, limit: int = 10, start_ms: int | None = None, time_column: str = TIME_COLUMN) -> DataFrame:
    """The most frequent values; ties go to the smaller value."""
    rows = since(df, start_ms, time_column)
    return rows.groupBy(_col(column)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), _col(column)).limit(limit)


def latency_percentiles(df: DataFrame, column: str, by: str | None = None, start_ms: int | None = None, time_column: str = TIME_COLUMN) -> DataFrame:
    """p50, p95, p99, avg and count of a column, per value of ``by``."""
    rows = since(df, start_ms, time_column)
    keys = [(by, _col(by))] if by else []
    wanted = [("p50", 0.50), ("p95", 0.95), ("p99", 0.99)]
    plain = [F.avg(_col(column).cast("double")).alias("avg"), F.count(F.lit(1)).alias("count")]
    base = rows.groupBy(_col(by)).agg(*plain) if by else rows.agg(*plain)
    found = percentiles(rows, keys, _col(column), wanted)
    left, right = base.alias("l"), found.alias("r")
    same = F.col(f"l.{quote(by)}").eqNullSafe(F.col(f"r.{quote(by)}")) if by else F.lit(True)  # one row each
    names = [F.col(f"l.{quote(by)}")] if by else []
    return left.join(right, same, "left").select(*names, "r.p50", "r.p95", "r.p99", "l.avg", "l.count")


def time_series(df: DataFrame, column: str, function: str = "AVG", bucket: str = "5 minutes", start_ms: int | None = None, time_column: str = TIME_COLUMN) -> DataFrame:
    rows = since(df, start_ms, time_column)
    key = time_bucket(bucket, _col(time_column)).alias("bucket")
    return rows.groupBy(key).agg(aggregate(function.lower(), _col(column)).alias("value")).orderBy("bucket")


def compare_groups(df: DataFrame, by: str, column: str, function: str = "AVG", start_ms: int | None = None, time_column: str = TIME_COLUMN) -> DataFrame:
    rows = since(df, start_ms, time_column)
    out = rows.groupBy(_col(by)).agg(aggregate(function.lower(), _col(column)).alias("value"), F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("value"), _col(by))


def anomalies(df: DataFrame, column: str, threshold: float = 2, limit: int = 100, start_ms: int | None = None, time_column: str = TIME_COLUMN) -> DataFrame:
    """The largest values above avg + threshold * (max - min) / 4, which is one row that is broadcast."""
    rows = since(df, start_ms, time_column)
    value = _col(column).cast("double")
    bound = rows.agg((F.avg(value) + F.lit(float(threshold)) * (F.max(value) - F.min(value)) / 4).alias("__bound"))
    met = rows.join(F.broadcast(bound), value > F.col("__bound"))
    return met.select(_col(time_column), _col(column)).orderBy(_col(column).desc(), _col(time_column)).limit(limit)


TEMPLATES = {
    "error-rate": error_rate,
    "top-n": top_n,
    "latency-percentiles": latency_percentiles,
    "time-series": time_series,
    "compare-groups": compare_groups,
    "anomaly-detection": anomalies,
}
