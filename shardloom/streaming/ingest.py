"""Streams into tables, and windows over streams."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..errors import ShardloomError
from ..functions.predicates import quote
from ..functions.time import parse_interval
from ..types import TIME_COLUMN


@dataclass(frozen=True)
class KafkaConfig:
    brokers: str = "localhost:9092"
    topics: tuple[str, ...] = ()
    group_id: str = "shardloom"
    offset_reset: str = "earliest"
    session_timeout_ms: int = 30_000
    max_poll_interval_ms: int = 300_000

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> KafkaConfig | None:
        """From KAFKA_TOPICS, KAFKA_BROKERS, KAFKA_GROUP_ID and KAFKA_AUTO_OFFSET_RESET; None without topics."""
        topics = tuple(t.strip() for t in env.get("KAFKA_TOPICS", "").split(",") if t.strip())
        if not topics:
            return None
        plain = cls()
        return cls(
            env.get("KAFKA_BROKERS", plain.brokers),
            topics,
            env.get("KAFKA_GROUP_ID", plain.group_id),
            env.get("KAFKA_AUTO_OFFSET_RESET", plain.offset_reset),
        )

    def options(self) -> dict[str, str]:
        """Options of Spark's Kafka source. Offsets are kept in the checkpoint, so nothing is committed unprocessed."""
        return {
            "kafka.bootstrap.servers": self.brokers,
            "subscribe": ",".join(self.topics),
            "startingOffsets": self.offset_reset,
            "kafka.group.id": self.group_id,
            "kafka.session.timeout.ms": str(self.session_timeout_ms),
            "kafka.max.poll.interval.ms": str(self.max_poll_interval_ms),
        }


def kafka_source(spark: SparkSession, config: KafkaConfig) -> DataFrame:
    """Messages (topic, partition, offset, value). Needs Spark's Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").options(**config.options()).load()
    return raw.select("topic", "partition", "offset", F.col("value").cast("string").alias("value"))


@dataclass
class StreamStats:
    received: int = 0
    processed: int = 0
    rows: int = 0
    errors: int = 0
    last_offset: dict[str, int] = field(default_factory=dict)


@dataclass
class StreamIngest:
    """Messages into tables. A batch that fails is run again from the checkpoint, without the tables that have it already.

    A message {"table", "rows"} is a batch for that table; any other object is a row of its topic's table. Messages that
    are no such objects, or whose table cannot be, count as errors and are passed over. Each table keeps the number of
    the last batch it got from a stream of this ``name``; only a driver that dies between a table's write and this note
    repeats the table's part of one batch.
    """

    engine: Engine
    stats: StreamStats = field(default_factory=StreamStats)
    name: str = "stream"

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """``batch``: value, and topic, partition and offset where the source has them."""
        topic = F.col("topic") if "topic" in batch.columns else F.lit("stream")
        value = F.try_parse_json(F.col("value"))
        kind = F.schema_of_variant(value)
        table, rows = F.try_variant_get(value, "$.table", "string"), F.try_variant_get(value, "$.rows", "array<variant>")
        is_batch = table.isNotNull() & rows.isNotNull()
        parsed = batch.select(
            F.when(is_batch, table).otherwise(topic).alias("table"),
            F.coalesce(kind.startswith("OBJECT"), F.lit(False)).alias("good"),
            F.when(is_batch, rows).otherwise(F.array(value)).alias("rows"),
        ).persist()
        try:
            counts = parsed.agg(F.count(F.lit(1)), F.count_if("good")).first()
            each = parsed.filter("good").select("table", F.explode("rows").alias("row")).select("table", F.to_json("row").alias("row"))
            sizes = each.groupBy("table").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per table of the batch
            for r in sorted(sizes, key=lambda r: str(r.table)):
                if self._last(r.table) >= batch_id:
                    continue
                try:
                    result = self.engine.ingest_json(r.table, each.filter(F.col("table") == r.table), "row")
                except ShardloomError:  # no table of that name can be
                    self.stats.errors += r.n
                    continue
                self._note(r.table, batch_id)
                self.stats.rows += result.inserted
                self.stats.errors += result.errors
            self.stats.received += counts[0]
            self.stats.processed += counts[1]
            self.stats.errors += counts[0] - counts[1]
            if {"topic", "partition", "offset"} <= set(batch.columns):
                for r in batch.groupBy("topic", "partition").agg(F.max("offset").alias("last")).collect():
                    self.stats.last_offset[f"{r.topic}:{r.partition}"] = r["last"]
        finally:
            parsed.unpersist()

    def _notes(self, table: str) -> dict[str, int]:
        store, path = self.engine.catalog.store, f"{table}/_streams.json"
        return json.loads(store.read_text(path)) if table in self.engine.catalog.tables and store.exists(path) else {}

    def _last(self, table: str) -> int:
        return self._notes(table).get(self.name, -1)

    def _note(self, table: str, batch_id: int) -> None:
        self.engine.catalog.store.write_text(f"{table}/_streams.json", json.dumps(self._notes(table) | {self.name: batch_id}))

    def start(self, source: DataFrame, checkpoint: str, available_now: bool = False, every: str = "10 seconds") -> StreamingQuery:
        if self.name == "stream":
            self.name = checkpoint  # batches are numbered by checkpoint
        writer = source.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def windowed(
    source: DataFrame,
    every: str,
    aggregates: Mapping[str, Column],
    by: tuple[str, ...] = (),
    slide: str | None = None,
    lateness: str = "6 hours",
    time_column: str = TIME_COLUMN,
) -> DataFrame:
    """Aggregates per window of time, for batches and streams alike.

    ``bucket`` is the window's start. On a stream, rows later than ``lateness`` behind the newest are dropped,
    also where no earlier row of their window ever came.
    """
    for interval in filter(None, (every, slide)):
        parse_interval(interval)
    rows = source.withWatermark(time_column, lateness) if source.isStreaming else source
    window = F.window(F.col(quote(time_column)), every, slide) if slide else F.window(F.col(quote(time_column)), every)
    grouped = rows.groupBy(window.alias("w"), *(F.col(quote(c)) for c in by))
    out = grouped.agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("bucket"), *(quote(c) for c in by), *aggregates)


def sessions(source: DataFrame, gap: str, aggregates: Mapping[str, Column], by: tuple[str, ...], lateness: str = "6 hours", time_column: str = TIME_COLUMN) -> DataFrame:
    """Aggregates per session: rows of a key without a pause of ``gap``."""
    rows = source.withWatermark(time_column, lateness) if source.isStreaming else source
    grouped = rows.groupBy(F.session_window(F.col(quote(time_column)), gap).alias("w"), *(F.col(quote(c)) for c in by))
    out = grouped.agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *(quote(c) for c in by), *aggregates)

