"""Rows into tables: batches of JSON objects, and DataFrames with a JSON column."""

from __future__ import annotations

import datetime as dt
import json
import random
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.flatten import coerce, flatten, flatten_row
from ..operators.sampling import bernoulli
from ..types import TIME_COLUMN, Tag, infer_tag, merge_all, spark_type
from .catalog import IngestResult, Table


def time_of(value: object) -> dt.datetime | None:
    """The time of a row, from epoch milliseconds (fractions cut) or a datetime; None if it has none."""
    if isinstance(value, dt.datetime):
        return value if value.tzinfo else value.replace(tzinfo=dt.UTC)
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value:
        return None
    try:
        return dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(milliseconds=int(value))
    except OverflowError:
        return None


def batch_frame(spark: SparkSession, rows: Iterable[Mapping[str, object]]) -> tuple[DataFrame, dict[str, Tag], int]:
    """Typed rows of a batch, the tags of their columns, and the number of rows without a time.

    A batch is what one request carries, so its types are found here on the driver.
    """
    flat = [flatten_row(r) for r in rows]
    good = [(time_of(r.get(TIME_COLUMN)), r) for r in flat]
    errors = sum(t is None for t, _ in good)
    good = [(t, r) for t, r in good if t is not None]
    names = list(dict.fromkeys(n for _, r in good for n in r if n != TIME_COLUMN))
    tags = {n: merge_all(infer_tag(r[n], n) for _, r in good if n in r) for n in names}
    stored = [n for n in names if tags[n] is not Tag.NULL]
    schema = T.StructType([T.StructField(TIME_COLUMN, T.TimestampType()), *(T.StructField(n, spark_type(tags[n])) for n in stored)])
    data = [(t, *(coerce(r.get(n), tags[n]) for n in stored)) for t, r in good]
    frame = spark.createDataFrame(data, schema)
    for n in names:
        if n not in stored:
            from pyspark.sql import functions as F

            frame = frame.withColumn(n, F.lit(None).cast("string"))
    return frame, {TIME_COLUMN: Tag.TIMESTAMP} | tags, errors


def sample_rows(rows: list, rate: float, seed: int | None) -> list:
    """Each row with probability ``rate``."""
    if rate >= 1:
        return rows
    if rate <= 0:
        return []
    rng = random.Random(seed)
    return [r for r in rows if rng.random() < rate]


def ingest_rows(table: Table, rows: Iterable[Mapping[str, object]], sample_rate: float | None = None, seed: int | None = None) -> IngestResult:
    """Flatten, sample and append a batch; rows without a time count as errors."""
    rows = list(rows)
    kept = sample_rows(rows, table.config.sample_rate if sample_rate is None else sample_rate, seed)
    frame, tags, errors = batch_frame(table.spark, kept)
    result = table.append(frame, tags) if len(kept) > errors else IngestResult(0, 0)
    return IngestResult(result.inserted, result.errors + errors, len(rows) - len(kept))


def ingest_json(table: Table, df: DataFrame, column: str, sample_rate: float | None = None, seed: int = 0, paths: dict[str, Tag] | None = None) -> IngestResult:
    """Append the JSON objects of a string column, flattened and typed on the executors."""
    rate = table.config.sample_rate if sample_rate is None else sample_rate
    return table.append(flatten(bernoulli(df.select(column), rate, seed, column), column, paths))


def parse_message(text: str | bytes, topic: str) -> tuple[str, list[dict]]:
    """(table, rows) of a message: a batch names its table, a single row goes to the topic's."""
    value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a message must be a JSON object")
    if isinstance(value.get("table"), str) and isinstance(value.get("rows"), list):
        rows = value["rows"]
        if not all(isinstance(r, dict) for r in rows):
            raise ValueError("rows must be JSON objects")
        return value["table"], rows
    return topic, [value]
