"""Tables: schema-merging, time-sharded Parquet datasets.

A table's folder holds a folder per schema version (``v0``, ``v1``...), each partitioned by
``shard_start``, the first millisecond of the shard. A new type for a column opens a new
version; scans cast every version to the merged schema, so nothing is rewritten or lost.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StorageError, TableExists, TableNotFound
from ..functions.predicates import quote
from ..functions.time import bucket_ms, to_ms
from ..types import TIME_COLUMN, Tag, merge_tags, row_bytes, schema_tags, spark_type
from .files import Store

HOUR_MS = 3_600_000
SHARD = "shard_start"


@dataclass(frozen=True)
class TableConfig:
    name: str
    shard_ms: int = HOUR_MS
    ttl_ms: int = 24 * HOUR_MS
    subsample_after_ms: int = 6 * HOUR_MS
    subsample_ratio: float = 0.01
    sample_rate: float = 1.0
    bloom_bytes: int = 64 << 10  # of each column's filter in a row group; 0: none. 64 KB tell 50,000 values apart


@dataclass
class Version:
    folder: str
    tags: dict[str, Tag]


@dataclass(frozen=True)
class IngestResult:
    inserted: int
    errors: int
    sampled_out: int = 0


@dataclass(frozen=True)
class TableStats:
    rows: int
    shards: int
    bytes: int
    oldest_ms: int | None  # start of the first shard
    newest_ms: int | None  # end of the last shard
    row_bytes: int


def to_tag(column: Column, old: Tag, new: Tag) -> Column:
    """A stored column as a wider type."""
    if old is new:
        return column
    if old is Tag.TIMESTAMP:
        return F.unix_millis(column) if new is Tag.INT64 else F.unix_millis(column).cast("string")
    return column.cast(spark_type(new))


def _blooms(held: Mapping[str, Tag], size: int) -> dict[str, str]:
    """Writer options for bloom filters of ``size`` bytes a row group, for the columns that equality filters look up.

    The size is fixed, as filters that find their own cost a third of the speed of writing.
    """
    columns = [n for n, t in held.items() if t in (Tag.STRING, Tag.INT64) and n != TIME_COLUMN and "." not in n] if size else []
    return {"parquet.bloom.filter.max.bytes": str(size)} | {f"parquet.bloom.filter.enabled#{n}": "true" for n in columns} if columns else {}


@dataclass
class Table:
    spark: SparkSession
    store: Store
    config: TableConfig
    tags: dict[str, Tag] = field(default_factory=dict)
    versions: list[Version] = field(default_factory=list)
    sealed: set[int] = field(default_factory=set)  # starts of the shards that take no more rows

    @property
    def schema(self) -> T.StructType:
        """The merged schema; a column that has only held nulls is a string."""
        return T.StructType([T.StructField(n, spark_type(Tag.STRING if t is Tag.NULL else t)) for n, t in self.tags.items()])

    def append(self, df: DataFrame, tags: dict[str, Tag] | None = None) -> IngestResult:
        """Add the rows of ``df`` that have a timestamp in a shard that isn't sealed; the others are counted as errors.

        ``tags``: what the columns hold, where that is narrower than their Spark types say.
        """
        tags = dict(tags or schema_tags(df.schema))
        if TIME_COLUMN not in df.columns:
            return IngestResult(0, df.count())
        tags[TIME_COLUMN] = Tag.TIMESTAMP
        kind = df.schema[TIME_COLUMN].dataType
        at = F.col(TIME_COLUMN)
        if isinstance(kind, T.NumericType):
            at = F.timestamp_millis(F.expr(f"try_cast({TIME_COLUMN} as bigint)"))
        elif not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            at = F.lit(None)
        # narrow columns take the Spark type of their tag; a column of nulls is not stored
        held = {n: t for n, t in tags.items() if t is not Tag.NULL}
        cells = [F.col(quote(n)).cast(spark_type(t)).alias(n) for n, t in held.items() if n != TIME_COLUMN]
        rows = df.withColumn(TIME_COLUMN, at.cast("timestamp")).select(TIME_COLUMN, *cells)
        rows = rows.withColumn(SHARD, bucket_ms(to_ms(F.col(TIME_COLUMN)), self.config.shard_ms))
        fits = F.col(SHARD).isNotNull()
        if self.sealed:
            fits = fits & ~F.col(SHARD).isin(sorted(self.sealed))
        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("all"), F.count_if(fits).alias("good"))
        version = self._version(tags, held)
        # a version is known before its first file, so a write that breaks off never leaves an unknown folder
        self._save()
        # rows of a small shard meet in one file, in order of time; a large one is split by the planner
        good = rows.filter(fits).hint("rebalance", SHARD).sortWithinPartitions(SHARD, TIME_COLUMN)
        good.write.options(**_blooms(held, self.config.bloom_bytes)).mode("append").partitionBy(SHARD).parquet(self.store.path(version.folder))
        try:
            got = seen.get
        except Py4JJavaError:  # a write without rows is planned away, and its counts with it
            return IngestResult(0, df.count())
        return IngestResult(got["good"], got["all"] - got["good"])

    def seal(self, shards: Iterable[int]) -> None:
        """Take no more rows into these shards."""
        new = set(shards) - self.sealed
        if new:
            self.sealed |= new
            self._save()

    def _version(self, tags: dict[str, Tag], held: dict[str, Tag]) -> Version:
        """The version whose columns agree with ``held``, opened if there is none."""
        for n, t in tags.items():
            self.tags[n] = merge_tags(self.tags.get(n, Tag.NULL), t)
        for v in self.versions:
            if all(v.tags.get(n, t) is t for n, t in held.items()):
                v.tags |= held
                return v
        self.versions.append(Version(f"{self.config.name}/v{len(self.versions)}-{uuid.uuid4().hex[:12]}", dict(held)))
        return self.versions[-1]

    def scan(self, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
        """All rows whose shard meets [start, end); only those shards' files are read."""
        parts = []
        for v in self.versions:
            if not self.store.exists(v.folder):
                continue
            stored = T.StructType([*(T.StructField(n, spark_type(t)) for n, t in v.tags.items()), T.StructField(SHARD, T.LongType())])
            df = self.spark.read.schema(stored).parquet(self.store.path(v.folder))
            if start_ms is not None:
                df = df.filter(F.col(SHARD) > start_ms - self.config.shard_ms)
            if end_ms is not None:
                df = df.filter(F.col(SHARD) < end_ms)
            cells = []
            for f in self.schema:
                old = v.tags.get(f.name)
                cell = F.lit(None).cast(f.dataType) if old is None else to_tag(F.col(quote(f.name)), old, self.tags[f.name])
                cells.append(cell.alias(f.name))
            parts.append(df.select(*cells, SHARD))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField(SHARD, T.LongType())])).drop(SHARD)
        return reduce(DataFrame.unionByName, parts).drop(SHARD)

    def shards(self) -> list[int]:
        """Starts of the shards, from the names of the folders."""
        found = {int(n.split("=")[1]) for v in self.versions for n in self.store.list(v.folder) if n.startswith(f"{SHARD}=")}
        return sorted(found)

    def shards_between(self, start_ms: int | None, end_ms: int | None) -> list[int]:
        """Starts of the shards that a scan of [start, end) reads."""
        width = self.config.shard_ms
        return [s for s in self.shards() if (start_ms is None or s > start_ms - width) and (end_ms is None or s < end_ms)]

    def stats(self) -> TableStats:
        shards = self.shards()
        end = shards[-1] + self.config.shard_ms if shards else None
        return TableStats(
            self.scan().count(), len(shards), sum(self.store.size(v.folder) for v in self.versions), shards[0] if shards else None, end, row_bytes(self.tags.values())
        )

    def expire(self, now_ms: int) -> int:
        """Drop shards that ended at least a TTL ago; the number of them."""
        gone = [s for s in self.shards() if s + self.config.shard_ms <= now_ms - self.config.ttl_ms]
        for s in gone:
            for v in self.versions:
                self.store.delete(f"{v.folder}/{SHARD}={s}")
        if self.sealed & set(gone):
            self.sealed -= set(gone)
            self._save()
        return len(gone)

    def _save(self) -> None:
        state = {
            "config": asdict(self.config),
            "tags": {n: t.value for n, t in self.tags.items()},
            "sealed": sorted(self.sealed),
            "versions": [{"folder": v.folder, "tags": {n: t.value for n, t in v.tags.items()}} for v in self.versions],
        }
        self.store.write_text(f"{self.config.name}/_table.json", json.dumps(state))

    @classmethod
    def load(cls, spark: SparkSession, store: Store, name: str) -> Table:
        state = json.loads(store.read_text(f"{name}/_table.json"))

        def tags(d: dict[str, str]) -> dict[str, Tag]:
            return {n: Tag(t) for n, t in d.items()}

        versions = [Version(v["folder"], tags(v["tags"])) for v in state["versions"]]
        return cls(spark, store, TableConfig(**state["config"]), tags(state["tags"]), versions, set(state.get("sealed", [])))


class Catalog:
    """The tables of a folder, each also a temporary view."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.tables: dict[str, Table] = {}
        for name in self.store.list(""):
            if self.store.exists(f"{name}/_table.json"):
                self.tables[name] = Table.load(spark, self.store, name)

    def create(self, config: TableConfig) -> Table:
        if not config.name or "/" in config.name or config.name.startswith((".", "_")):
            raise StorageError(f"bad table name {config.name!r}")
        if config.shard_ms <= 0:
            raise StorageError("the width of a shard must be positive")
        if config.name in self.tables:
            raise TableExists(config.name)
        table = self.tables[config.name] = Table(self.spark, self.store, config)
        table._save()
        return table

    def get(self, name: str) -> Table:
        if name not in self.tables:
            raise TableNotFound(name)
        return self.tables[name]

    def get_or_create(self, name: str) -> Table:
        return self.tables[name] if name in self.tables else self.create(TableConfig(name))

    def drop(self, name: str) -> None:
        self.get(name)
        del self.tables[name]
        self.store.delete(name)
        self.spark.catalog.dropTempView(name)

    def names(self) -> list[str]:
        return sorted(self.tables)


def utc_ms(when: dt.datetime) -> int:
    when = when if when.tzinfo else when.replace(tzinfo=dt.UTC)
    return (when - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1)
