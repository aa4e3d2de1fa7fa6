"""The engine: tables in, queries out."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .cache import ResultCache
from .errors import TableNotFound
from .functions.predicates import time_bounds
from .plans import extended
from .plans.compiler import compile_query
from .plans.parser import parse
from .plans.spec import QuerySpec
from .session import apply_semantics
from .sources.catalog import Catalog, IngestResult, Table, TableConfig
from .sources.ingest import ingest_json, ingest_rows
from .sources.otlp import otlp_to_spans
from .types import TIME_COLUMN, Tag, epoch_ms, schema_tags

TRACES = "otel_traces"


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[list]
    elapsed_ms: float
    cached: bool = False
    availability: float = 100.0
    rows_scanned: int | None = None  # rows and number of the shards that the query's times allow; of sharded tables only
    shards_scanned: int | None = None

    def response(self) -> dict:
        """The answer as JSON values; times are epoch milliseconds."""
        rows = [[epoch_ms(v) for v in r] for r in self.rows]
        return {"columns": self.columns, "rows": rows, "row_count": len(rows), "execution_time_ms": self.elapsed_ms, "cached": self.cached, "availability": self.availability, "rows_scanned": self.rows_scanned, "shards_scanned": self.shards_scanned}


@dataclass
class Engine:
    """``root``: the folder of the tables, in any store that Spark reaches."""

    spark: SparkSession
    root: str
    clock: Callable[[], float] = time.time
    two_valued: bool = False
    cache: ResultCache = field(default_factory=ResultCache)

    def __post_init__(self):
        apply_semantics(self.spark)
        self.catalog = Catalog(self.spark, self.root)
        self.frames: dict[str, DataFrame] = {}

    def now_ms(self) -> int:
        return int(self.clock() * 1000)

    # tables

    def create_table(self, config: TableConfig | str) -> Table:
        return self.catalog.create(TableConfig(config) if isinstance(config, str) else config)

    def drop_table(self, name: str) -> None:
        self.frames.pop(name, None) is not None or self.catalog.drop(name)
        self.cache.invalidate(name)

    def tables(self) -> list[str]:
        return sorted({*self.catalog.names(), *self.frames})

    def register(self, name: str, df: DataFrame) -> None:
        """Make any DataFrame a table to query; conditions on any of its columns are pushed down to its source."""
        self.frames[name] = df
        self.cache.invalidate(name)

    def schema(self, name: str) -> dict[str, Tag]:
        return schema_tags(self.frames[name].schema) if name in self.frames else dict(self.catalog.get(name).tags)

    def stats(self) -> dict:
        tables = {n: asdict(self.catalog.get(n).stats()) for n in self.catalog.names()}
        return {"tables": tables, "rows": sum(t["rows"] for t in tables.values()), "bytes": sum(t["bytes"] for t in tables.values())}

    # rows in

    def ingest(self, table: str, rows: Iterable[Mapping[str, object]], sample_rate: float | None = None, seed: int | None = None) -> IngestResult:
        return self._written(table, ingest_rows(self.catalog.get_or_create(table), rows, sample_rate, seed))

    def ingest_json(self, table: str, df: DataFrame, column: str = "value", **options) -> IngestResult:
        return self._written(table, ingest_json(self.catalog.get_or_create(table), df, column, **options))

    def append(self, table: str, df: DataFrame) -> IngestResult:
        return self._written(table, self.catalog.get_or_create(table).append(df))

    def ingest_otlp(self, requests: DataFrame, column: str = "value", keys: list[str] | None = None) -> dict:
        """Spans of OTLP/JSON export requests into the table of traces; answers as the protocol does."""
        result = self.append(TRACES, otlp_to_spans(requests, column, keys))
        return {"partialSuccess": {"rejectedSpans": result.errors, "errorMessage": "no timestamp"} if result.errors else None}

    def _written(self, table: str, result: IngestResult) -> IngestResult:
        self.cache.invalidate(table)
        return result

    # queries

    def frame(self, spec: QuerySpec) -> DataFrame:
        """The rows a query reads: of a sharded table only the shards that its times allow."""
        if spec.table in self.frames:
            return self.frames[spec.table]
        if spec.table not in self.catalog.tables:
            raise TableNotFound(spec.table)
        return self.catalog.get(spec.table).scan(*time_bounds(spec.where, TIME_COLUMN, self.now_ms()))

    def sql(self, text: str) -> DataFrame:
        """A query of the strict dialect, as a lazy DataFrame."""
        spec = parse(text)
        return compile_query(spec, self.frame(spec), self.now_ms(), self.two_valued)

    def sql_extended(self, text: str) -> DataFrame:
        """Any Spark SQL over the tables, with TIME_BUCKET and the percentile functions."""
        for name in self.catalog.names():
            self.catalog.get(name).scan().createOrReplaceTempView(name)
        for name, df in self.frames.items():
            df.createOrReplaceTempView(name)
        return extended.run(self.spark, text)

    def query(self, text: str) -> QueryResult:
        """A query's rows, from the cache if it was answered a short while ago."""
        began = time.perf_counter()
        spec = parse(text)
        found = self.cache.get((spec, self.two_valued))
        if found is not None:
            columns, rows, scanned = found
            return QueryResult(columns, rows, (time.perf_counter() - began) * 1000, True, 100.0, *scanned)
        df = compile_query(spec, self.frame(spec), self.now_ms(), self.two_valued)
        rows = [list(r) for r in df.collect()]
        scanned = self.scanned(spec)
        self.cache.put((spec, self.two_valued), spec.table, (df.columns, rows, scanned))
        return QueryResult(df.columns, rows, (time.perf_counter() - began) * 1000, False, 100.0, *scanned)

    def scanned(self, spec: QuerySpec) -> tuple[int | None, int | None]:
        """(rows, shards) that a query reads of a sharded table. Rows are counted from the files' footers."""
        if spec.table in self.frames:
            return None, None
        table, bounds = self.catalog.get(spec.table), time_bounds(spec.where, TIME_COLUMN, self.now_ms())
        return table.scan(*bounds).count(), len(table.shards_between(*bounds))

    # upkeep

    def expire(self, now_ms: int | None = None) -> int:
        """Drop what is older than each table's TTL; the number of shards."""
        gone = 0
        for name in self.catalog.names():
            n = self.catalog.get(name).expire(self.now_ms() if now_ms is None else now_ms)
            if n:
                self.cache.invalidate(name)
            gone += n
        return gone

