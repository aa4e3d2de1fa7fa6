"""Views of spans: search, summaries, trees and waterfalls."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from ..sources.files import scratch

TABLE = "otel_traces"


def search_traces(
    spans: DataFrame,
    service: str = "",
    operation: str = "",
    min_duration: int = 0,
    max_duration: int | None = None,
    status: str = "",
    limit: int = 100,
    start_ms: int | None = None,
    end_ms: int | None = None,
) -> DataFrame:
    """Root spans that match, newest first."""
    out = spans.filter(F.col("parent_span_id") == "")
    if service:
        out = out.filter(F.col("service_name") == service)
    if operation:
        out = out.filter(F.col("span_name").contains(operation))
    if min_duration > 0:
        out = out.filter(F.col("duration_ms") >= min_duration)
    if max_duration:
        out = out.filter(F.col("duration_ms") <= max_duration)
    if status == "error":
        out = out.filter(F.col("status_code") == "ERROR")
    if start_ms is not None:
        out = out.filter(F.col("timestamp") >= F.timestamp_millis(F.lit(start_ms)))
    if end_ms is not None:
        out = out.filter(F.col("timestamp") < F.timestamp_millis(F.lit(end_ms)))
    out = out.orderBy(F.col("start_time").desc(), "trace_id", "span_id").limit(limit)
    return out.select("trace_id", "service_name", "span_name", "duration_ms", "start_time", "status_code")


def load_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.filter(F.col("trace_id") == trace_id).orderBy("start_time", "span_id")


def with_roots(spans: DataFrame) -> DataFrame:
    """``spans`` with ``is_root``: no parent, or a parent that isn't in the trace."""
    parents = spans.select(F.col("trace_id").alias("p_trace"), F.col("span_id").alias("p_span")).distinct()
    same = (F.col("trace_id") == F.col("p_trace")) & (F.col("parent_span_id") == F.col("p_span"))
    met = spans.join(parents, same, "left")
    return met.withColumn("is_root", F.col("p_span").isNull()).drop("p_trace", "p_span")


def summaries(spans: DataFrame) -> DataFrame:
    """A row per trace: root service and span, count, start, duration from first start to last end, has_error."""
    root = F.when(F.col("is_root"), F.struct("start_time", "span_id", "service_name", "span_name"))
    out = with_roots(spans).groupBy("trace_id").agg(
        F.min(root).alias("root"),
        F.count(F.lit(1)).alias("span_count"),
        (F.unix_millis(F.max("end_time")) - F.unix_millis(F.min("start_time"))).alias("duration_ms"),
        F.min("start_time").alias("start_time"),
        F.max((F.col("status_code") == "ERROR").cast("int")).cast("boolean").alias("has_error"),
    )
    return out.select(
        "trace_id",
        F.col("root.service_name").alias("root_service"),
        F.col("root.span_name").alias("root_span"),
        "span_count",
        "duration_ms",
        "start_time",
        "has_error",
    )


def tree(spans: DataFrame) -> DataFrame:
    """``spans`` with ``depth`` and ``path`` (span ids from the root), by a join on the parent per level.

    Each level is a written table, so plans stay short however deep the trees are; the last is the one
    that is empty. No path meets a span twice, and spans that no root leads to get nulls.
    """
    spark, folder = spans.sparkSession, scratch(spans.sparkSession, "tree")
    rooted = with_roots(spans)
    links = rooted.select("trace_id", "span_id", "parent_span_id", "is_root")
    links.write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    level = links.filter("is_root").select("trace_id", "span_id", F.array("span_id").alias("path")).distinct()
    level.write.parquet(f"{folder}/depth=0")
    below = links.filter("not is_root").select("trace_id", "parent_span_id", "span_id").distinct()
    for depth in count(1):
        level = spark.read.parquet(f"{folder}/depth={depth - 1}")
        parents = level.select("trace_id", F.col("span_id").alias("parent_span_id"), "path")
        found = below.join(parents, ["trace_id", "parent_span_id"]).filter(~F.array_contains("path", F.col("span_id")))
        found.select("trace_id", "span_id", F.concat("path", F.array("span_id")).alias("path")).write.parquet(f"{folder}/depth={depth}")
        if spark.read.parquet(f"{folder}/depth={depth}").isEmpty():
            break
    levels = [spark.read.parquet(f"{folder}/depth={d}").withColumn("depth", F.lit(d)) for d in range(depth + 1)]
    placed = reduce(DataFrame.union, levels).select(F.col("trace_id").alias("t"), F.col("span_id").alias("i"), "depth", "path")
    same = (F.col("trace_id") == F.col("t")) & (F.col("span_id") == F.col("i"))
    return rooted.join(placed, same, "left").drop("t", "i")


def waterfall(spans: DataFrame) -> DataFrame:
    """``spans`` with left_pct and width_pct (0.5 at least) of the time its trace spans."""
    whole = Win.partitionBy("trace_id")
    start, end = F.unix_millis("start_time"), F.unix_millis("end_time")
    first, last = F.min(start).over(whole), F.max(end).over(whole)
    span = F.greatest(last - first, F.lit(1))
    return spans.withColumn("left_pct", (start - first) * 100.0 / span).withColumn(
        "width_pct", F.greatest((end - start) * 100.0 / span, F.lit(0.5))
    )
