"""Tables, shards, TTL, snapshots, cache, alerts, traces, templates, builder, streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shardloom import Engine, TableConfig
from shardloom import errors as E
from shardloom.alerts import Alert, AlertChecker, AlertState, Condition, evaluate
from shardloom.cache import ResultCache
from shardloom.operators import templates, traces
from shardloom.operators.builder import QueryState, TimeRange, Zoom, build_query, sample_query
from shardloom.operators.rollup import classify_columns, pivot_series, rollup
from shardloom.operators.sampling import bernoulli, sample_k, subsample
from shardloom.plans.parser import parse
from shardloom.snapshots import cleanup, list_snapshots, restore, snapshot
from shardloom.sources.ingest import parse_message
from shardloom.sources.otlp import otlp_to_spans
from shardloom.streaming.ingest import KafkaConfig, StreamIngest, sessions, windowed
from shardloom.types import Tag


@pytest.fixture
def engine(spark, tmp_path):
    clock = [1000.0]
    engine = Engine(spark, f"file://{tmp_path}/tables", clock=lambda: clock[0])
    engine.ticks = clock
    return engine


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_tables(engine):
    engine.create_table("a")
    with pytest.raises(E.TableExists):
        engine.create_table("a")
    engine.ingest("b", [{"timestamp": 1, "x": 1}])
    assert engine.tables() == ["a", "b"] and engine.schema("b") == {"timestamp": Tag.TIMESTAMP, "x": Tag.INT64}
    engine.drop_table("a")
    for call in (lambda: engine.drop_table("a"), lambda: engine.schema("a"), lambda: engine.sql("SELECT x FROM a")):
        with pytest.raises(E.TableNotFound):
            call()
    for name in ("", "a/b", "_x"):
        with pytest.raises(E.StorageError):
            engine.create_table(name)


def test_a_new_engine_finds_the_tables(engine, spark):
    engine.ingest("t", [{"timestamp": 1, "x": 1}])
    engine.ingest("t", [{"timestamp": 2, "x": 0.5, "y": "z"}])
    again = Engine(spark, engine.root)
    assert rows(again.sql("SELECT x, y FROM t ORDER BY timestamp")) == [(1.0, None), (0.5, "z")]


def test_shards(engine):
    engine.create_table(TableConfig("t", shard_ms=1000, ttl_ms=500))
    engine.ingest("t", [{"timestamp": t} for t in (100, 1100, 2100, -1)])
    table = engine.catalog.get("t")
    assert table.shards() == [-1000, 0, 1000, 2000]
    stats = table.stats()
    assert (stats.rows, stats.shards, stats.oldest_ms, stats.newest_ms) == (4, 4, -1000, 3000)
    assert table.scan(500, 1500).count() == 2
    assert engine.expire(2500) == 3 and table.shards() == [2000]
    assert rows(engine.sql("SELECT COUNT(*) FROM t")) == [(1,)]


def test_times_prune_shards(engine):
    engine.create_table(TableConfig("t", shard_ms=1000))
    engine.ingest("t", [{"timestamp": t, "v": t} for t in range(0, 10_000, 500)])
    df = engine.sql("SELECT v FROM t WHERE timestamp >= 2500 AND timestamp < 4000 AND v > 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_start" in plan and "PushedFilters: [" in plan
    assert sorted(r[0] for r in df.collect()) == [2500, 3000, 3500]
    assert len(df.inputFiles()) <= 3 or "shard_start#" in plan
    either = engine.sql("SELECT v FROM t WHERE timestamp < 500 OR timestamp >= 9500")
    assert sorted(r[0] for r in either.collect()) == [0, 9500]


def test_snapshots(engine, tmp_path):
    folder = f"file://{tmp_path}/snapshots"
    with pytest.raises(E.SnapshotNotFound):
        restore(engine, folder)
    engine.create_table(TableConfig("t", shard_ms=500, ttl_ms=7))
    engine.ingest("t", [{"timestamp": 1, "event": None, "value": 5}, {"timestamp": 2, "value": 6, "n": None}])
    first = snapshot(engine, folder)
    engine.ingest("t", [{"timestamp": 3, "value": 0.5}])
    second = snapshot(engine, folder)
    assert (first.rows, second.rows) == (2, 3)
    assert [m.id for m in list_snapshots(engine, folder)] == [second.id, first.id]
    restore(engine, folder, first.id)
    assert rows(engine.sql("SELECT timestamp, value FROM t ORDER BY timestamp")) == [(dt.datetime(1970, 1, 1, 0, 0, 0, 1000), 5), (dt.datetime(1970, 1, 1, 0, 0, 0, 2000), 6)]
    assert engine.catalog.get("t").config.ttl_ms == 7
    restore(engine, folder)
    assert engine.sql("SELECT value FROM t").count() == 3
    assert cleanup(engine, folder, 1) == 1 and [m.id for m in list_snapshots(engine, folder)] == [second.id]


def test_cache(engine):
    engine.ingest("t", [{"timestamp": 1, "s": "A"}, {"timestamp": 2, "s": "a"}])
    assert not engine.query("SELECT s FROM t WHERE s = 'A'").cached
    assert engine.query("select  s\nfrom t where s = 'A' ;").cached
    other = engine.query("SELECT s FROM t WHERE s = 'a'")
    assert not other.cached and other.rows == [["a"]]
    engine.ingest("t", [{"timestamp": 3, "s": "A"}])
    assert engine.query("SELECT s FROM t WHERE s = 'A'").rows == [["A"], ["A"]]


def test_cache_bounds():
    now = [0.0]
    cache = ResultCache(2, 60, lambda: now[0])
    for k in "abc":
        cache.put(k, "t" if k == "c" else "u", k)
    assert cache.get("a") is None and cache.get("b") == "b"
    now[0] = 60
    assert cache.get("b") is None and cache.stats().expired == 1
    cache.put("d", "t", "d")
    assert cache.invalidate("t") == 2 and cache.invalidate() == 0
    assert cache.stats().hits == 1 and cache.stats().misses == 2


@pytest.mark.parametrize(
    ("condition", "fires"),
    [
        (Condition("greater_than", "n", 4), True), (Condition("greater_than", "n", 5), False), (Condition("less_than", "n", 5.5), True),
        (Condition("greater_or_equal", "n", 5), True), (Condition("less_or_equal", "n", 4), False), (Condition("equals", "n", 5.0), True),
        (Condition("not_equals", "s", "x"), False), (Condition("equals", "z", None), True), (Condition("row_count_greater_than", value=1), True),
        (Condition("no_results"), False), (Condition("has_results"), True), (Condition("equals", "n", True), False),
    ],
)
def test_conditions(spark, condition, fires):
    df = spark.createDataFrame([(5, "x", None), (9, "y", None)], "n long, s string, z long").coalesce(1)
    assert evaluate(condition, df)[0] is fires


def test_conditions_that_cannot_be_evaluated(spark):
    df = spark.createDataFrame([("x",)], "s string")
    for condition, frame in ((Condition("less_than", "s", 1), df), (Condition("equals", "nope", 1), df), (Condition("equals", "s", 1), df.limit(0)), (Condition("odd", "s", 1), df)):
        with pytest.raises(E.CheckError):
            evaluate(condition, frame)
    assert evaluate(Condition("no_results"), df.limit(0))[0]


def test_alerts(engine):
    engine.ingest("t", [{"timestamp": 1, "v": 5}])
    sent = []
    def broken(alert, message):
        raise OSError

    checker = AlertChecker(engine, [broken, lambda a, m: sent.append(a.id)])
    checker.add(Alert("hi", "SELECT MAX(v) AS m FROM t", Condition("greater_than", "m", 4), interval_ms=100))
    checker.add(Alert("bad", "SELECT nope FROM t", Condition("has_results")))
    for alert in (Alert("hi", "x", Condition("has_results")), Alert("", "x", Condition("has_results")), Alert("y", " ", Condition("has_results"))):
        with pytest.raises(E.AlertError):
            checker.add(alert)
    assert checker.run_once(1000) == ["hi"] and checker.run_once(1050) == [] and checker.run_once(1100) == ["hi"]
    assert checker.get("hi")[1] == AlertState(True, 1100, 1100, 2, None) and sent == ["hi", "hi"]
    assert "nope" in checker.get("bad")[1].last_error and not checker.get("bad")[1].firing
    checker.update(Alert("hi", "SELECT nope FROM t", Condition("has_results"), interval_ms=100))
    assert checker.check("hi", 1300).firing and checker.get("hi")[1].last_error
    checker.enable("hi", False)
    assert not checker.is_due("hi", 9999)
    checker.remove("hi")
    with pytest.raises(E.AlertNotFound):
        checker.get("hi")
    assert [a.id for a, _ in checker.list()] == ["bad"]


REQUEST = {
    "resourceSpans": [
        {
            "resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}, {"key": "env", "value": {"stringValue": "res"}}]},
            "scopeSpans": [
                {
                    "scope": {"name": "lib", "version": ""},
                    "spans": [
                        {"traceId": "t1", "spanId": "a", "name": "GET /", "kind": 2, "startTimeUnixNano": "1700000000123456789", "endTimeUnixNano": "1700000000223456789",
                         "attributes": [{"key": "env", "value": {"stringValue": "span"}}, {"key": "code", "value": {"intValue": "200"}}, {"key": "list", "value": {"arrayValue": {"values": []}}}],
                         "status": {"code": 2, "message": "no"}, "events": [{"name": "e"}]},
                        {"traceId": "t1", "spanId": "b", "parentSpanId": "a", "name": "db", "kind": 99, "startTimeUnixNano": "1700000000150000000", "endTimeUnixNano": "1700000000160000000",
                         "attributes": [{"key": "code", "value": {"doubleValue": 1.5}}, {"key": "ok", "value": {"boolValue": True}}]},
                    ],
                }
            ],
        },
        {"scopeSpans": [{"spans": [{"traceId": "t2", "spanId": "c", "parentSpanId": "gone", "name": "x", "startTimeUnixNano": "1700000001000000000", "endTimeUnixNano": "1700000001000000000"}]}]},
    ]
}


@pytest.fixture
def spans(spark, engine):
    return otlp_to_spans(spark.createDataFrame([(json.dumps(REQUEST),), ("{}",), ("nonsense",), (None,)], "value string"))


def test_otlp(spans):
    got = {r.span_id: r.asDict() for r in spans.collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = (got[k] for k in "abc")
    assert (a["service_name"], a["span_kind"], a["status_code"], a["status_message"], a["duration_ms"], a["events_count"], a["links_count"]) == ("api", "SERVER", "ERROR", "no", 100, 1, 0)
    assert a["timestamp"] == a["start_time"] == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert (a["attr.env"], b["attr.env"], c["attr.env"]) == ("span", "res", None)
    assert (a["attr.code"], b["attr.code"]) == (200.0, 1.5) and b["attr.ok"] is True and a["attr.otel.scope.name"] == "lib"
    assert "attr.list" not in a and "attr.otel.scope.version" not in a
    assert (b["span_kind"], b["status_code"], b["parent_span_id"], a["parent_span_id"]) == ("UNSPECIFIED", "UNSET", "a", "")
    assert (c["service_name"], c["duration_ms"]) == ("unknown", 0)


def test_otlp_into_the_engine(spark, engine):
    requests = spark.createDataFrame([(json.dumps(REQUEST),)], "value string")
    assert engine.ingest_otlp(requests) == {"partialSuccess": None}
    assert rows(engine.sql("SELECT span_name, attr.code FROM otel_traces WHERE service_name = 'api' ORDER BY start_time")) == [("GET /", 200.0), ("db", 1.5)]


def test_traces(spans):
    assert [r.trace_id for r in traces.search_traces(spans, status="error", operation="GET").collect()] == ["t1"]
    assert traces.search_traces(spans, service="other").count() == traces.search_traces(spans, max_duration=5).count() == 0
    got = {r.trace_id: r for r in traces.summaries(spans).collect()}
    assert (got["t1"].root_service, got["t1"].root_span, got["t1"].span_count, got["t1"].duration_ms, got["t1"].has_error) == ("api", "GET /", 2, 100, True)
    assert (got["t2"].root_span, got["t2"].has_error) == ("x", False)
    assert {(r.span_id, r.depth, tuple(r.path)) for r in traces.tree(spans).collect()} == {("a", 0, ("a",)), ("b", 1, ("a", "b")), ("c", 0, ("c",))}
    bars = {r.span_id: (r.left_pct, r.width_pct) for r in traces.waterfall(spans).collect()}
    assert bars == {"a": (0, 100), "b": (27, 10), "c": (0, 0.5)}
    assert [r.span_id for r in traces.load_trace(spans, "t1").collect()] == ["a", "b"]


def test_sampling(spark):
    df = spark.range(5000)
    assert bernoulli(df, 1).count() == 5000 and bernoulli(df, 0).count() == 0
    kept = {r[0] for r in bernoulli(df, 0.1, 1, "id").collect()}
    assert kept == {r[0] for r in bernoulli(df.repartition(13), 0.1, 1, "id").collect()} and 400 < len(kept) < 600
    assert sample_k(df, 10, 1, "id").distinct().count() == 10 and sample_k(df.limit(3), 10).count() == 3
    sample, stats = subsample(df, 0.0011, 1, "id")
    assert (stats.rows, stats.target, sample.count()) == (5000, 6, 6)


def test_rollup_and_pivot(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", m, None) for m in range(120 // 2)], "timestamp timestamp, k string, v long, z double")
    assert rows(rollup(df, "1 hour")) == [(dt.datetime(2024, 1, 1), 60, 1770.0, 29.5, 0.0, 59.0, 0, None, None, None, None)]
    counts = df.groupBy("k", F.lit("x").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    assert rows(pivot_series(counts, "x", "k", "n")) == [("x", 30, 30)]
    assert classify_columns(df) == (["timestamp", "k"], ["v", "z"])


def test_templates(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "error" if m % 3 == 0 else "ok", float(m)) for m in range(10)], "timestamp timestamp, s string, v double")
    assert rows(templates.error_rate(df, "s", "error")) == [(dt.datetime(2024, 1, 1), 5, 2), (dt.datetime(2024, 1, 1, 0, 5), 5, 2)]
    assert rows(templates.top_n(df, "s", 1)) == [("ok", 6)]
    assert rows(templates.latency_percentiles(df, "v")) == [(5.0, 9.0, 9.0, 4.5, 10)]
    assert rows(templates.latency_percentiles(df, "v", "s"))[0][0] in ("ok", "error")
    assert [r.value for r in templates.time_series(df, "v", "SUM").collect()] == [10.0, 35.0]
    assert rows(templates.compare_groups(df, "s", "v", "MAX")) == [("error", 9.0, 4), ("ok", 8.0, 6)]
    assert [r.v for r in templates.anomalies(df, "v", 1).collect()] == [9.0, 8.0, 7.0]
    assert templates.since(df, 1_704_067_500_000).count() == 5


def test_builder():
    state = QueryState("events", (("COUNT", "*"), ("AVG", "a.b")), ("event", "odd name"), (("event", "contains", "o'k"), ("v", "!=", None)), TimeRange("1h"))
    text = build_query(state, "bar", 3_600_005)
    assert text == """SELECT event, "odd name", COUNT(*), AVG(a.b) FROM events WHERE timestamp >= 5 AND event LIKE '%o''k%' AND v != NULL GROUP BY event, "odd name" ORDER BY event"""
    parse(text)
    line = build_query(state, "line")
    assert line.startswith("SELECT TIME_BUCKET('1 minute', timestamp), event") and "ORDER BY" not in line
    parse(line)
    assert build_query(QueryState("t")) == "SELECT COUNT(*) FROM t"
    assert sample_query(QueryState("t", time_range=TimeRange("custom", 5, 9))) == "SELECT * FROM t WHERE timestamp >= 5 AND timestamp <= 9 ORDER BY timestamp DESC LIMIT 100"
    zoom = Zoom(state)
    assert zoom.into([7]) == state and zoom.into([7, 3, 5]).time_range == TimeRange("custom", 3, 7)
    assert zoom.out() == zoom.out() == state


def test_messages():
    assert parse_message('{"table": "t", "rows": [{"a": 1}, {"a": 2}]}', "x") == ("t", [{"a": 1}, {"a": 2}])
    assert parse_message(b'{"a": 1}', "x") == ("x", [{"a": 1}])
    for text in ("[]", "5", '{"table": "t", "rows": [1]}'):
        with pytest.raises(ValueError):
            parse_message(text, "x")


def test_kafka_config():
    assert KafkaConfig.from_env({}) is None
    config = KafkaConfig.from_env({"KAFKA_TOPICS": "a, b", "KAFKA_BROKERS": "h:1"})
    assert config.topics == ("a", "b") and config.options()["subscribe"] == "a,b" and config.options()["startingOffsets"] == "earliest"


def test_stream_ingest(spark, engine, tmp_path):
    messages = [
        ("x", 0, 0, '{"timestamp": 1, "v": 1}'), ("x", 0, 1, '{"table": "y", "rows": [{"timestamp": 2, "w": "a"}, {"w": "late"}]}'),
        ("x", 1, 7, "nonsense"), ("x", 1, 8, None), ("x", 1, 9, "[1]"),
    ]
    spark.createDataFrame(messages, "topic string, partition int, offset long, value string").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("topic string, partition int, offset long, value string").parquet(f"{tmp_path}/in")
    ingest = StreamIngest(engine)
    ingest.start(source, f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    assert rows(engine.sql("SELECT v FROM x")) == [(1,)] and rows(engine.sql("SELECT w FROM y")) == [("a",)]
    s = ingest.stats
    assert (s.received, s.processed, s.rows, s.errors) == (5, 2, 2, 4)
    assert s.last_offset == {"x:0": 1, "x:1": 9}


def test_late_rows_are_dropped(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    for k, times in enumerate(([0, 1], [600], [601], [2, 1300])):  # minutes; 2 comes after the watermark has passed it
        spark.createDataFrame([(at + dt.timedelta(minutes=m),) for m in times], "timestamp timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("timestamp timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    out = []
    query = windowed(source, "1 hour", {"n": F.count(F.lit(1))}).writeStream.outputMode("append")
    query = query.foreachBatch(lambda b, _: out.extend(rows(b))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert out[0] == (at, 2) and dict(out) == {at: 2, at + dt.timedelta(hours=10): 2}


def test_windows_on_batches(spark):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(at + dt.timedelta(minutes=m), "k") for m in (0, 5, 50)], "timestamp timestamp, k string")
    count = {"n": F.count(F.lit(1))}
    assert sorted(rows(windowed(df, "20 minutes", count, ("k",), slide="10 minutes")))[0] == (at - dt.timedelta(minutes=10), "k", 2)
    assert [r.n for r in sessions(df, "10 minutes", count, ("k",)).orderBy("session_start").collect()] == [2, 1]
