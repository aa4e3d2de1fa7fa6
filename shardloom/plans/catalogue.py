"""Registered queries of the engine's operators, each with the same query in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..alerts import Condition, evaluate
from ..engine import Engine
from ..functions.aggregates import aggregate, approximate, histogram, percentiles
from ..functions.time import time_bucket
from ..operators import templates as TP
from ..operators import traces as TR
from ..operators.builder import QueryState, build_query, sample_query
from ..operators.flatten import flatten
from ..operators.rollup import classify_columns, pivot_series, rollup
from ..operators.sampling import bernoulli, sample_k, subsample
from ..session import apply_semantics
from ..snapshots import restore, snapshot
from ..sources.catalog import TableConfig
from ..sources.files import scratch
from ..sources.otlp import otlp_to_spans
from ..streaming.ingest import StreamIngest, sessions, windowed
from ..types import Tag
from .compiler import compile_query
from .parser import parse

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, query: Query, oracle: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(apply_semantics(spark), sf_dir)

    QUERIES[name] = run
    if oracle:
        ORACLE_SQL[name] = oracle


def _plain_times(df: DataFrame) -> DataFrame:
    """Times without zone, as the tables and DuckDB have them."""
    return df.select(*(F.col(f"`{n}`").cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(f"`{n}`") for n, t in df.dtypes))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums and means rounded, for their order of addition isn't fixed."""
    return df.select(*(F.round(F.col(f"`{n}`"), digits).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def _sql(name: str, text: str, oracle: str, digits: int | None = None, two_valued: bool = False) -> None:
    """A query of the strict dialect over one of the tables."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = parse(text)
        out = _plain_times(compile_query(spec, _read(spark, sf_dir, spec.table), 0, two_valued))
        return out if digits is None else _rounded(out, digits)

    _register(name, query, oracle)


def _bucket(ms: int, column: str = "ts") -> str:
    return f"make_timestamp(((epoch_us({column}) // 1000) // {ms}) * {ms} * 1000)"


_sql("q01_scan_columns", "SELECT event_id, event_type, value FROM events", "SELECT event_id, event_type, value FROM events")
_sql("q02_wildcard", "SELECT * FROM nation", "SELECT * FROM nation")
_sql("q03_filter_eq", "SELECT event_id FROM events WHERE event_type = 'click'", "SELECT event_id FROM events WHERE event_type = 'click'")
_sql("q04_filter_ne", "SELECT event_id FROM events WHERE event_type != 'click'", "SELECT event_id FROM events WHERE event_type <> 'click'")
_sql("q05_filter_range", "SELECT event_id, value FROM events WHERE value >= 50 AND value < 100", "SELECT event_id, value FROM events WHERE value >= 50 AND value < 100")
_sql("q06_filter_and", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id <= 50", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id <= 50")
_sql("q07_filter_or", "SELECT event_id FROM events WHERE event_type = 'view' OR (user_id > 140 AND value > 10.5)", "SELECT event_id FROM events WHERE event_type = 'view' OR (user_id > 140 AND value > 10.5)")
_sql("q08_like", "SELECT event_id, event_type FROM events WHERE event_type LIKE '%i%'", "SELECT event_id, event_type FROM events WHERE event_type LIKE '%i%'")
_sql("q09_not_like", "SELECT event_id, event_type FROM events WHERE event_type NOT LIKE 'c%'", "SELECT event_id, event_type FROM events WHERE event_type NOT LIKE 'c%'")
_sql("q10_time_range", "SELECT event_id, ts FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-06'", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
_sql("q10b_time_ms", "SELECT event_id FROM events WHERE ts > 1704844800000", "SELECT event_id FROM events WHERE ts > make_timestamp(1704844800000000)")
_sql("q11_count_star", "SELECT COUNT(*) AS n FROM events", "SELECT count(*) AS n FROM events")
_sql("q12_count_col", "SELECT COUNT(value) AS n FROM events", "SELECT count(value) AS n FROM events")
_sql("q13_sum", "SELECT SUM(user_id) AS s FROM events", "SELECT sum(user_id)::DOUBLE AS s FROM events")
_sql("q14_avg", "SELECT AVG(value) AS a FROM events", "SELECT round(avg(value), 6) AS a FROM events", 6)
_sql("q15_min_max", "SELECT MIN(value) AS lo, MAX(value) AS hi, MIN(event_type) AS first, MAX(event_type) AS last, MAX(ts) AS newest FROM events", "SELECT min(value) AS lo, max(value) AS hi, min(event_type) AS first, max(event_type) AS last, max(ts) AS newest FROM events")
_sql("q16_multi_agg", "SELECT COUNT(*) AS n, SUM(value) AS s, AVG(value) AS a, MIN(value) AS lo, MAX(value) AS hi FROM events", "SELECT count(*) AS n, round(sum(value), 6) AS s, round(avg(value), 6) AS a, min(value) AS lo, max(value) AS hi FROM events", 6)
_sql("q17_group_one", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
_sql("q18_group_two", "SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY event_type, user_id", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
_sql("q19_group_keys_only", "SELECT event_type FROM events GROUP BY event_type", "SELECT DISTINCT event_type FROM events")
_sql("q19b_group_alias", "SELECT event_type AS kind, COUNT(*) FROM events GROUP BY kind", 'SELECT event_type AS kind, count(*) AS "count_*" FROM events GROUP BY 1')
_sql("q20_group_filter", "SELECT event_type, SUM(value) AS s FROM events WHERE user_id < 30 GROUP BY event_type", "SELECT event_type, round(sum(value), 6) AS s FROM events WHERE user_id < 30 GROUP BY 1", 6)
for _name, _text, _ms in (("q21_bucket_5m", "5 minutes", 300_000), ("q22_bucket_1h", "1 hour", 3_600_000), ("q23_bucket_1d", "1 day", 86_400_000), ("q23b_bucket_7d", "7 d", 604_800_000)):
    _sql(_name, f"SELECT TIME_BUCKET('{_text}', ts) AS bucket, COUNT(*) AS n FROM events GROUP BY bucket", f"SELECT {_bucket(_ms)} AS bucket, count(*) AS n FROM events GROUP BY 1")
_sql("q24_bucket_by_type", "SELECT event_type, TIME_BUCKET('6 hours', ts) AS bucket, COUNT(*) AS n FROM events GROUP BY TIME_BUCKET('6 hours', ts), event_type", f"SELECT event_type, {_bucket(21_600_000)} AS bucket, count(*) AS n FROM events GROUP BY ALL")


def _rank(p: float) -> str:
    return f"list_sort(list(value))[cast(round({p}::DOUBLE * (count(value) - 1)) AS INT) + 1]"


for _name, _f, _p in (("q25_p50", "P50", 0.5), ("q26_p90", "P90", 0.9), ("q27_p95", "P95", 0.95), ("q28_p99", "P99", 0.99)):
    _sql(_name, f"SELECT event_type, {_f}(value) AS p FROM events GROUP BY event_type", f"SELECT event_type, {_rank(_p)} AS p FROM events GROUP BY 1")
_sql("q28b_percentile_global", "SELECT PERCENTILE(value, 0.25) AS q, PERCENTILE(value, 0.75) AS r, P95(user_id) AS u, COUNT(*) AS n FROM events", f"SELECT {_rank(0.25)} AS q, {_rank(0.75)} AS r, {_rank(0.95).replace('value', 'user_id')}::DOUBLE AS u, count(*) AS n FROM events")
_register(
    "q29_histogram",
    lambda s, d: histogram(_read(s, d, "events"), "value", 50, ["event_type"]),
    """SELECT event_type, '[' || string_agg('[' || b || ',' || n || ']', ',' ORDER BY b) || ']' AS histogram
       FROM (SELECT event_type, floor(value / 50)::BIGINT AS b, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""",
)
_sql("q30_top_n", "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
_sql("q31_order_multi", "SELECT event_type, value, event_id FROM events ORDER BY event_type DESC, value ASC, event_id LIMIT 200", "SELECT event_type, value, event_id FROM events ORDER BY event_type DESC, value NULLS FIRST, event_id LIMIT 200")
_sql("q31b_order_hidden", "SELECT event_type FROM events ORDER BY value DESC, event_id LIMIT 50", "SELECT event_type FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 50")
_sql("q32_latest_sample", "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100", "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
_register(
    "q33_flatten_group",
    lambda s, d: flatten(_read(s, d, "events"), "props", {"k": Tag.INT64}, "props.").groupBy("event_type").agg(F.sum("`props.k`").cast("double").alias("s")),
    "SELECT event_type, sum((props->>'$.k')::BIGINT)::DOUBLE AS s FROM events GROUP BY 1",
)
_register(
    "q33b_flatten_discovered",
    lambda s, d: flatten(_read(s, d, "events").select("event_id", "props"), "props"),
    "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
)
_register(
    "q34_error_rate",
    lambda s, d: _plain_times(TP.error_rate(_read(s, d, "events"), "event_type", "error", "1 day", time_column="ts")),
    f"SELECT {_bucket(86_400_000)} AS bucket, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1",
)
_register(
    "q34b_top_values",
    lambda s, d: TP.top_n(_read(s, d, "events"), "event_type", 3, start_ms=1_704_844_800_000, time_column="ts"),
    "SELECT event_type, count(*) AS count FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
_register(
    "q34c_latency_percentiles",
    lambda s, d: _rounded(TP.latency_percentiles(_read(s, d, "events"), "value", "event_type", time_column="ts")),
    f"SELECT event_type, {_rank(0.5)} AS p50, {_rank(0.95)} AS p95, {_rank(0.99)} AS p99, round(avg(value), 6) AS avg, count(*) AS count FROM events GROUP BY 1",
)
_register(
    "q34d_time_series",
    lambda s, d: _plain_times(TP.time_series(_read(s, d, "events"), "value", "MAX", "6 hours", time_column="ts")),
    f"SELECT {_bucket(21_600_000)} AS bucket, max(value) AS value FROM events GROUP BY 1",
)
_register(
    "q35_compare_groups",
    lambda s, d: _rounded(TP.compare_groups(_read(s, d, "events"), "event_type", "value", "AVG", time_column="ts")),
    "SELECT event_type, round(avg(value), 6) AS value, count(*) AS count FROM events GROUP BY 1",
)
_register(
    "q36_anomaly",
    lambda s, d: TP.anomalies(_read(s, d, "events"), "value", 2, 100, time_column="ts"),
    "SELECT ts, value FROM events WHERE value > (SELECT avg(value) + 2 * (max(value) - min(value)) / 4 FROM events) ORDER BY value DESC, ts LIMIT 100",
)
_register(
    "q37_rollup_hourly",
    lambda s, d: _rounded(_plain_times(rollup(_read(s, d, "events"), "1 hour", ["value"], "ts"))),
    f"SELECT {_bucket(3_600_000)} AS bucket, count(value) AS value_count, round(sum(value), 6) AS value_sum, round(avg(value), 6) AS value_avg, min(value) AS value_min, max(value) AS value_max FROM events GROUP BY 1",
)
_register(
    "q38_pivot_series",
    lambda s, d: _plain_times(
        pivot_series(
            _read(s, d, "events").groupBy(time_bucket("1 day", F.col("ts")).alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n")),
            "day", "event_type", "n", ["click", "error", "purchase", "signup", "view"],
        )
    ),
    "SELECT day, " + ", ".join(f"max(n) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view"))
    + f" FROM (SELECT {_bucket(86_400_000)} AS day, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1",
)


def _ttl_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    newest = events.agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).alias("__limit"))  # one row
    return events.join(F.broadcast(newest), F.col("ts") > F.col("__limit")).select("event_id", "ts")


_register("q39_ttl_view", _ttl_view, "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) - INTERVAL 24 HOURS FROM events)")
_sql("q40_lineitem_agg", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty, AVG(l_discount) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_discount), 4) AS disc FROM lineitem GROUP BY ALL", 4)
_sql("q41_two_valued", "SELECT event_id FROM events WHERE value != 10 AND value < 200", "SELECT event_id FROM events WHERE coalesce(value <> 10, true) AND coalesce(value < 200, true)", two_valued=True)
_register(
    "q42_extended_sql",
    lambda s, d: _extended(s, d, "SELECT event_type, P95(value) AS p, TIME_BUCKET('1 day', max(ts)) AS day FROM events GROUP BY event_type HAVING count(*) > 10"),
    f"SELECT event_type, {_rank(0.95)} AS p, {_bucket(86_400_000, 'max(ts)')} AS day FROM events GROUP BY 1 HAVING count(*) > 10",
)


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, scratch(spark, "engine"))


def _extended(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    engine = _engine(spark)
    engine.register("events", _read(spark, sf_dir, "events"))
    return _plain_times(engine.sql_extended(text))


def _sharded(spark: SparkSession, sf_dir: str) -> Engine:
    """Events in a sharded table: ts as timestamp."""
    engine = _engine(spark)
    engine.create_table(TableConfig("events", shard_ms=86_400_000, ttl_ms=7 * 86_400_000))
    engine.append("events", _read(spark, sf_dir, "events").withColumnRenamed("ts", "timestamp"))
    return engine


_register(
    "q43_sharded_scan",
    lambda s, d: _plain_times(_sharded(s, d).sql("SELECT event_id, timestamp, value FROM events WHERE timestamp >= '2024-01-07 12:00:00' AND timestamp < '2024-01-09'")),
    "SELECT event_id, ts AS timestamp, value FROM events WHERE ts >= TIMESTAMP '2024-01-07 12:00:00' AND ts < TIMESTAMP '2024-01-09'",
)


def _expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _sharded(spark, sf_dir)
    engine.expire(1_706_400_000_000)  # 2024-01-28
    return engine.sql("SELECT event_id FROM events")


_register("q44_ttl_expiry", _expired, "SELECT event_id FROM events WHERE (epoch_us(ts) // 1000) // 86400000 * 86400000 + 86400000 > 1706400000000 - 7 * 86400000")


def _json_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark)
    engine.create_table(TableConfig("events", shard_ms=86_400_000))
    rows = _read(spark, sf_dir, "events").select(
        F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "event_id", F.struct("user_id", "value").alias("who"))).alias("value")
    )
    engine.ingest_json("events", rows)
    return _plain_times(engine.sql("SELECT timestamp, event_id, who.user_id, who.value FROM events"))


_register("q45_json_ingest", _json_ingest, 'SELECT make_timestamp((epoch_us(ts) // 1000) * 1000) AS timestamp, event_id, user_id AS "who.user_id", value AS "who.value" FROM events')


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, folder = _sharded(spark, sf_dir), scratch(spark, "snapshots")
    snapshot(engine, folder)
    engine.drop_table("events")
    restore(engine, folder)
    return _rounded(engine.sql("SELECT event_type, COUNT(*) AS n, SUM(value) AS s FROM events GROUP BY event_type"))


_register("q46_snapshot_restore", _snapshots, "SELECT event_type, count(*) AS n, round(sum(value), 6) AS s FROM events GROUP BY 1")
_register(
    "q47_sliding_windows",
    lambda s, d: _plain_times(windowed(_read(s, d, "events"), "2 days", {"n": F.count(F.lit(1))}, slide="1 day", time_column="ts")),
    f"SELECT bucket, count(*) AS n FROM (SELECT unnest([{_bucket(86_400_000)}, {_bucket(86_400_000)} - INTERVAL 1 DAY]) AS bucket FROM events) GROUP BY 1",
)
_register(
    "q48_session_windows",
    lambda s, d: _plain_times(sessions(_read(s, d, "events"), "12 hours", {"n": F.count(F.lit(1))}, ("user_id",), time_column="ts")),
    """WITH e AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events),
       s AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > INTERVAL 12 HOURS) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
       SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
)


def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the events' files, run to its end."""
    schema = _read(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")
    out = windowed(source.withColumn("ts", F.col("ts").cast("timestamp")), "1 day", {"n": F.count(F.lit(1))}, ("event_type",), time_column="ts")
    path = scratch(spark, "stream")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out")

    writer = out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return _plain_times(spark.read.parquet(f"{path}/out"))


_register("q49_stream_windows", _stream_windows, f"SELECT {_bucket(86_400_000)} AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")


def _stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from a stream into tables by topic."""
    path = scratch(spark, "messages")
    events = _read(spark, sf_dir, "events")
    row = F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "event_id", "value"))
    events.select(F.col("event_type").alias("topic"), row.alias("value")).write.parquet(f"{path}/in")
    engine = _engine(spark)
    for topic in ("click", "error", "purchase", "signup", "view"):
        engine.create_table(TableConfig(topic, shard_ms=86_400_000))
    source = spark.readStream.schema("topic string, value string").parquet(f"{path}/in")
    StreamIngest(engine).start(source, f"{path}/checkpoint", available_now=True).awaitTermination()
    return engine.sql("SELECT event_id, value FROM click")


_register("q50_stream_ingest", _stream_ingest, "SELECT event_id, value FROM events WHERE event_type = 'click'")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: five in a row are a trace whose first is the root."""
    first = F.col("event_id") - F.pmod("event_id", F.lit(5))
    start = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    return _read(spark, sf_dir, "events").select(
        start.alias("timestamp"),
        first.cast("string").alias("trace_id"),
        F.col("event_id").cast("string").alias("span_id"),
        F.when(F.col("event_id") == first, "").when(F.pmod("event_id", F.lit(5)) < 3, first.cast("string")).otherwise((F.col("event_id") - 2).cast("string")).alias("parent_span_id"),
        F.col("event_type").alias("service_name"),
        F.concat(F.lit("op"), F.pmod("user_id", F.lit(7)).cast("string")).alias("span_name"),
        start.alias("start_time"),
        F.timestamp_millis(F.unix_millis(start) + F.floor("value")).alias("end_time"),
        F.floor("value").alias("duration_ms"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("OK").alias("status_code"),
    )


_SPANS_SQL = """s AS (SELECT make_timestamp((epoch_us(ts) // 1000) * 1000) AS start_time, (event_id - event_id % 5)::VARCHAR AS trace_id, event_id::VARCHAR AS span_id,
  CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 < 3 THEN (event_id - event_id % 5)::VARCHAR ELSE (event_id - 2)::VARCHAR END AS parent_span_id,
  event_type AS service_name, 'op' || (user_id % 7) AS span_name, make_timestamp(((epoch_us(ts) // 1000) + floor(value)::BIGINT) * 1000) AS end_time,
  floor(value)::BIGINT AS duration_ms, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status_code FROM events)"""
_register(
    "q51_trace_search",
    lambda s, d: _plain_times(TR.search_traces(_spans(s, d), service="click", operation="p3", min_duration=5, limit=50)),
    f"WITH {_SPANS_SQL} SELECT trace_id, service_name, span_name, duration_ms, start_time, status_code FROM s WHERE parent_span_id = '' AND service_name = 'click' AND span_name LIKE '%p3%' AND duration_ms >= 5 ORDER BY start_time DESC, trace_id, span_id LIMIT 50",
)
_register(
    "q52_trace_summaries",
    lambda s, d: _plain_times(TR.summaries(_spans(s, d))),
    f"""WITH {_SPANS_SQL}, r AS (SELECT s.*, p.span_id IS NULL AS is_root FROM s LEFT JOIN s p ON s.trace_id = p.trace_id AND s.parent_span_id = p.span_id)
       SELECT trace_id, (min((start_time, span_id, service_name, span_name)) FILTER (is_root))[3] AS root_service, (min((start_time, span_id, service_name, span_name)) FILTER (is_root))[4] AS root_span,
         count(*) AS span_count, (epoch_us(max(end_time)) // 1000) - (epoch_us(min(start_time)) // 1000) AS duration_ms, min(start_time) AS start_time, bool_or(status_code = 'ERROR') AS has_error FROM r GROUP BY trace_id""",
)
_register(
    "q53_trace_tree",
    lambda s, d: TR.tree(_spans(s, d)).select("trace_id", "span_id", "depth"),
    "SELECT (event_id - event_id % 5)::VARCHAR AS trace_id, event_id::VARCHAR AS span_id, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 < 3 THEN 1 ELSE 2 END AS depth FROM events",
)
_register(
    "q54_trace_waterfall",
    lambda s, d: _rounded(TR.waterfall(_spans(s, d)).select("span_id", "left_pct", "width_pct")),
    f"""WITH {_SPANS_SQL}, w AS (SELECT *, min((epoch_us(start_time) // 1000)) OVER (PARTITION BY trace_id) AS a, max((epoch_us(end_time) // 1000)) OVER (PARTITION BY trace_id) AS b FROM s)
       SELECT span_id, round(((epoch_us(start_time) // 1000) - a) * 100.0::DOUBLE / greatest(b - a, 1), 6) AS left_pct, round(greatest(((epoch_us(end_time) // 1000) - (epoch_us(start_time) // 1000)) * 100.0::DOUBLE / greatest(b - a, 1), 0.5), 6) AS width_pct FROM w""",
)


def _otlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as OTLP/JSON requests, one per event, and back as spans."""
    attribute = lambda k, kind, v: F.struct(F.lit(k).alias("key"), F.struct(v.alias(kind)).alias("value"))
    nanos = F.unix_millis(F.col("ts").cast("timestamp")) * 1_000_000
    span = F.struct(
        F.col("user_id").cast("string").alias("traceId"),
        F.col("event_id").cast("string").alias("spanId"),
        F.col("event_type").alias("name"),
        F.pmod("event_id", F.lit(7)).cast("int").alias("kind"),
        nanos.cast("string").alias("startTimeUnixNano"),
        (nanos + 5_000_000).cast("string").alias("endTimeUnixNano"),
        F.array(attribute("user", "intValue", F.col("user_id").cast("string"))).alias("attributes"),
        F.struct(F.pmod("event_id", F.lit(4)).cast("int").alias("code")).alias("status"),
    )
    scope = F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), F.array(span).alias("spans"))
    resource = F.struct(F.array(attribute("service.name", "stringValue", F.concat(F.lit("svc-"), "event_type"))).alias("attributes"))
    request = F.struct(F.array(F.struct(resource.alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))
    spans = otlp_to_spans(_read(spark, sf_dir, "events").select(F.to_json(request).alias("value")))
    return _plain_times(spans.select("timestamp", "trace_id", "span_id", "parent_span_id", "service_name", "span_name", "span_kind", "duration_ms", "status_code", F.col("`attr.user`").alias("user"), F.col("`attr.otel.scope.name`").alias("scope")))


_register(
    "q55_otlp",
    _otlp,
    """SELECT make_timestamp((epoch_us(ts) // 1000) * 1000) AS timestamp, user_id::VARCHAR AS trace_id, event_id::VARCHAR AS span_id, '' AS parent_span_id, 'svc-' || event_type AS service_name, event_type AS span_name,
       ['UNSPECIFIED', 'INTERNAL', 'SERVER', 'CLIENT', 'PRODUCER', 'CONSUMER', 'UNSPECIFIED'][event_id % 7 + 1] AS span_kind, 5::BIGINT AS duration_ms,
       ['UNSET', 'OK', 'ERROR', 'UNSET'][event_id % 4 + 1] AS status_code, user_id AS user, 'lib' AS scope FROM events""",
)


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = QueryState("events", (("COUNT", "*"), ("MAX", "value")), ("event_type",), (("event_type", "contains", "i"), ("value", ">=", 5)))
    return compile_query(parse(build_query(state)), _read(spark, sf_dir, "events"), 0)


_register("q56_query_builder", _built, "SELECT event_type, count(*) AS \"count_*\", max(value) AS max_value FROM events WHERE event_type LIKE '%i%' AND value >= 5 GROUP BY 1")


def _built_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").withColumnRenamed("ts", "timestamp")
    return _plain_times(compile_query(parse(sample_query(QueryState("events", filters=(("event_type", "=", "error"),)))), events, 0)).select("timestamp")


_register("q57_sample_query", _built_sample, "SELECT ts AS timestamp FROM events WHERE event_type = 'error' ORDER BY ts DESC LIMIT 100")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _read(spark, sf_dir, "events").groupBy().agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("hi"))
    conditions = {"gt": Condition("greater_than", "n", 10), "le": Condition("less_or_equal", "hi", 0), "ne": Condition("not_equals", "n", -1.0), "rows": Condition("row_count_greater_than", value=0), "none": Condition("no_results")}
    return spark.createDataFrame([(k, evaluate(c, counts)[0]) for k, c in conditions.items()], "condition string, fires boolean")


_register("q58_alert_conditions", _alerts, "SELECT * FROM (VALUES ('gt', (SELECT count(*) > 10 FROM events)), ('le', (SELECT max(value) <= 0 FROM events)), ('ne', true), ('rows', true), ('none', false)) t(condition, fires)")
_HASH = "('0x' || substr(md5(event_id || '|3'), 1, 15))::BIGINT"
_register("q59_bernoulli", lambda s, d: bernoulli(_read(s, d, "events"), 0.1, seed=3, key="event_id"), f"SELECT * FROM events WHERE {_HASH} % 1000000 < 100000")
_register("q60_sample_k", lambda s, d: sample_k(_read(s, d, "events"), 100, seed=3, key="event_id"), f"SELECT * FROM events ORDER BY {_HASH}, event_id LIMIT 100")
_register(
    "q61_subsample",
    lambda s, d: subsample(_read(s, d, "events"), 0.01, seed=3, key="event_id")[0],
    f"SELECT * FROM events QUALIFY row_number() OVER (ORDER BY {_HASH}, event_id) <= (SELECT ceil(count(*) * 0.01) FROM events)",
)
_register(
    "q62_approx_percentile",
    lambda s, d: _read(s, d, "events").groupBy("event_type").agg(approximate(F.col("value"), 0.95).alias("p")),
    None,
)


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimensions, metrics = classify_columns(_read(spark, sf_dir, "events"))
    return spark.createDataFrame([(c, "dimension") for c in dimensions] + [(c, "metric") for c in metrics], "name string, role string")


_register("q63_column_roles", _roles, "SELECT column_name AS name, CASE WHEN column_type IN ('BIGINT', 'DOUBLE', 'INTEGER') THEN 'metric' ELSE 'dimension' END AS role FROM (DESCRIBE events)")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _sharded(spark, sf_dir).catalog.get("events").stats()
    return spark.createDataFrame([(stats.rows, stats.shards, stats.oldest_ms, stats.newest_ms)], "rows long, shards long, oldest long, newest long")


_register("q64_table_stats", _stats, "SELECT count(*) AS rows, count(DISTINCT (epoch_us(ts) // 1000) // 86400000) AS shards, min((epoch_us(ts) // 1000)) // 86400000 * 86400000 AS oldest, max((epoch_us(ts) // 1000)) // 86400000 * 86400000 + 86400000 AS newest FROM events")
_register(
    "q65_plain_aggregates",
    lambda s, d: _rounded(_read(s, d, "orders").groupBy("o_orderstatus").agg(*(aggregate(f, F.col("o_totalprice")).alias(f) for f in ("count", "sum", "avg", "min", "max"))), 3),
    "SELECT o_orderstatus, count(o_totalprice) AS count, round(sum(o_totalprice), 3) AS sum, round(avg(o_totalprice), 3) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1",
)


def _stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good messages among bad ones, run twice as after a failure: each row is there once, errors are counted."""
    events = _read(spark, sf_dir, "events").filter("event_type = 'click'")
    row = F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), "event_id"))
    good = events.select(F.lit("clicks").alias("topic"), row.alias("value"))
    bad = [("clicks", '{"table": "a/b", "rows": [{"timestamp": 1}]}'), ("clicks", "nonsense"), ("clicks", None), ("_x", '{"timestamp": 1}'), ("clicks", '{"no": "time"}')]
    batch = good.union(spark.createDataFrame(bad, "topic string, value string"))
    engine = _engine(spark)
    engine.create_table(TableConfig("clicks", shard_ms=30 * 86_400_000))
    for _ in range(2):
        stream = StreamIngest(engine)
        stream.process(batch, 0)
    StreamIngest(engine).process(batch.limit(0), 1)
    return engine.sql("SELECT event_id FROM clicks")


_register("q66_stream_replay", _stream_replay, "SELECT event_id FROM events WHERE event_type = 'click'")


def _sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come for sealed shards are refused and counted."""
    engine = _sharded(spark, sf_dir)
    engine.catalog.get("events").seal(s for s in engine.catalog.get("events").shards() if s < 1_705_000_000_000)
    late = engine.append("events", _read(spark, sf_dir, "events").withColumnRenamed("ts", "timestamp"))
    return engine.sql("SELECT COUNT(*) AS n FROM events").withColumn("refused", F.lit(late.errors).cast("long"))


_EARLY = "(epoch_us(ts) // 1000) // 86400000 * 86400000 < 1705000000000"
_register("q67_sealed_shards", _sealed, f"SELECT count(*) + count(*) FILTER (NOT {_EARLY}) AS n, count(*) FILTER ({_EARLY}) AS refused FROM events")


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query reads, as its answer says."""
    answer = _sharded(spark, sf_dir).query("SELECT COUNT(*) AS n FROM events WHERE timestamp >= '2024-01-07 12:00:00' AND timestamp < '2024-01-09'").response()
    return spark.createDataFrame([(answer["rows"][0][0], answer["rows_scanned"], answer["shards_scanned"])], "n long, rows_scanned long, shards_scanned long")


_register(
    "q68_rows_scanned",
    _scanned,
    """SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-07 12:00:00') AS n, count(*) AS rows_scanned, count(DISTINCT ts::DATE) AS shards_scanned
       FROM events WHERE ts >= TIMESTAMP '2024-01-07' AND ts < TIMESTAMP '2024-01-09'""",
)


def _narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of a column whose values lie close together, by ranks over slices of it."""
    events = _read(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return percentiles(events, [("event_type", F.col("event_type"))], F.col("ms"), [("p50", 0.5), ("p95", 0.95)])


_MS = "list_sort(list(epoch_us(ts) // 1000))[cast(round({p}::DOUBLE * (count(*) - 1)) AS INT) + 1]::DOUBLE"
_register("q69_percentiles_by_slices", _narrow, f"SELECT event_type, {_MS.format(p=0.5)} AS p50, {_MS.format(p=0.95)} AS p95 FROM events GROUP BY 1")


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys are a group of their own, and null times have a null bucket."""
    events = _read(spark, sf_dir, "events")
    some = events.withColumn("kind", F.when(F.col("event_type") != "click", F.col("event_type"))).withColumn("at", F.when(F.col("value") >= 50, F.col("ts")))
    return _plain_times(compile_query(parse("SELECT kind, TIME_BUCKET('1 day', at) AS day, COUNT(*) AS n, COUNT(at) AS timed FROM t GROUP BY kind, day"), some, 0))


_register("q70_null_groups", _with_nulls, f"SELECT nullif(event_type, 'click') AS kind, CASE WHEN value >= 50 THEN {_bucket(86_400_000)} END AS day, count(*) AS n, count(*) FILTER (value >= 50) AS timed FROM events GROUP BY ALL")
_register(
    "q71_extended_join",
    lambda s, d: _extended(s, d, "SELECT a.event_type, a.event_id, CAST(row_number() OVER (PARTITION BY a.event_type ORDER BY a.event_id) AS BIGINT) AS r FROM events a JOIN events b ON a.event_id = b.event_id + 1 WHERE b.event_type = 'view' AND a.value > (SELECT avg(value) FROM events)"),
    "SELECT a.event_type, a.event_id, row_number() OVER (PARTITION BY a.event_type ORDER BY a.event_id) AS r FROM events a JOIN events b ON a.event_id = b.event_id + 1 WHERE b.event_type = 'view' AND a.value > (SELECT avg(value) FROM events)",
)
_register(
    "q72_trace_load",
    lambda s, d: _plain_times(TR.load_trace(_spans(s, d), "10").select("span_id", "parent_span_id", "start_time")),
    f"WITH {_SPANS_SQL} SELECT span_id, parent_span_id, start_time FROM s WHERE trace_id = '10' ORDER BY start_time, span_id",
)


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOW() is the engine's clock."""
    engine = Engine(spark, scratch(spark, "engine"), clock=lambda: 1_705_000_000.0)
    engine.register("events", _read(spark, sf_dir, "events"))
    return engine.sql("SELECT event_id FROM events WHERE ts >= NOW() - INTERVAL '2 days'")


_register("q73_now_minus_interval", _recent, "SELECT event_id FROM events WHERE ts >= make_timestamp(1705000000000000) - INTERVAL 2 DAY")


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made by their first batch, their schemas, and rows without a time counted."""
    engine = _engine(spark)
    first = engine.ingest("a", [{"timestamp": 1, "x": 1, "y": {"z": "s"}}, {"x": 2}, {"timestamp": "no", "x": 3}])
    second = engine.ingest("b", [{"timestamp": 2, "x": 0.5}, {"timestamp": 3, "x": 1}])
    found = [(t, c, tag.value, n.inserted, n.errors) for t, n in (("a", first), ("b", second)) for c, tag in engine.schema(t).items()]
    return spark.createDataFrame(found, "name string, field string, tag string, inserted long, errors long")


_register(
    "q74_batches_and_schemas",
    _batches,
    """SELECT * FROM (VALUES ('a', 'timestamp', 'TIMESTAMP', 1::BIGINT, 2::BIGINT), ('a', 'x', 'INT64', 1, 2), ('a', 'y.z', 'STRING', 1, 2),
       ('b', 'timestamp', 'TIMESTAMP', 2, 0), ('b', 'x', 'FLOAT64', 2, 0)) t(name, field, tag, inserted, errors)""",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of events by type, through parser and compiler."""
    return QUERIES["q17_group_one"](spark, sf_dir)
