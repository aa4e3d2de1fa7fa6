"""Types, nulls, names, percentiles and the decisions where engines differ."""

import datetime as dt
import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from shardloom import Engine, TableConfig
from shardloom import errors as E
from shardloom.functions.aggregates import histogram, nearest_rank, percentiles
from shardloom.functions.time import auto_bucket, bucket_ms, preset_bucket, range_start
from shardloom.operators.flatten import discover, flatten, flatten_row
from shardloom.types import Tag, infer_tag, merge_tags


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/tables", clock=lambda: 1000.0)


@pytest.fixture
def events(engine):
    """100 rows: click and view in turns."""
    engine.ingest("events", [{"timestamp": i * 1000, "event": "view" if i % 2 else "click", "value": i, "latency": 1.5 * i} for i in range(100)])
    return engine


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_merge_of_tags():
    """Commutative, null yields, two widenings, else strings."""
    for a, b in itertools.product(Tag, Tag):
        expected = a if a is b else b if a is Tag.NULL else a if b is Tag.NULL else {frozenset((Tag.INT64, Tag.FLOAT64)): Tag.FLOAT64, frozenset((Tag.INT64, Tag.TIMESTAMP)): Tag.INT64}.get(frozenset((a, b)), Tag.STRING)
        assert merge_tags(a, b) is merge_tags(b, a) is expected


def test_inferred_tags():
    assert [infer_tag(v, "x") for v in (42, 3.14, "hello", True, None, "2024-01-01")] == [Tag.INT64, Tag.FLOAT64, Tag.STRING, Tag.BOOL, Tag.NULL, Tag.STRING]
    assert infer_tag(42, "timestamp") is Tag.TIMESTAMP and infer_tag(42, "a.timestamp") is Tag.INT64


def test_end_to_end(events):
    assert rows(events.sql("SELECT COUNT(*) FROM events")) == [(100,)]
    assert rows(events.sql("SELECT COUNT(*) FROM events WHERE event = 'click'")) == [(50,)]
    assert rows(events.sql("SELECT AVG(value) FROM events")) == [(49.5,)]
    assert rows(events.sql("SELECT value FROM events ORDER BY value DESC LIMIT 3")) == [(99,), (98,), (97,)]
    assert rows(events.sql("SELECT COUNT(*) FROM events WHERE timestamp >= 10000 AND timestamp < 20000")) == [(10,)]
    assert events.sql("SELECT * FROM events").columns == ["timestamp", "event", "value", "latency"]


def test_wildcard_order_and_response(events):
    result = events.query("SELECT * FROM events ORDER BY timestamp LIMIT 1")
    assert result.response()["rows"] == [[0, "click", 0, 0.0]] and result.availability == 100


def test_first_null_then_values(engine):
    engine.ingest("t", [{"timestamp": 1, "a": None}, {"timestamp": 2, "a": 5}])
    engine.ingest("t", [{"timestamp": 3, "b": None}])
    engine.ingest("t", [{"timestamp": 4, "b": "x"}])
    assert rows(engine.sql("SELECT a, b FROM t ORDER BY timestamp")) == [(None, None), (5, None), (None, None), (None, "x")]


def test_types_widen_over_batches(engine):
    engine.ingest("t", [{"timestamp": 1, "v": 1}])
    engine.ingest("t", [{"timestamp": 2, "v": 2.5}])
    assert engine.schema("t")["v"] is Tag.FLOAT64
    assert rows(engine.sql("SELECT v FROM t ORDER BY timestamp")) == [(1.0,), (2.5,)]
    engine.ingest("t", [{"timestamp": 3, "v": "x"}, {"timestamp": 4, "v": True}])
    assert engine.schema("t")["v"] is Tag.STRING
    assert rows(engine.sql("SELECT v FROM t ORDER BY timestamp")) == [("1",), ("2.5",), ("x",), ("true",)]


def test_rows_without_a_time_are_errors(engine):
    result = engine.ingest("t", [{"a": 1}, {"timestamp": "x"}, {"timestamp": None}, {"timestamp": True}, {"timestamp": 5.9, "a": 2}])
    assert (result.inserted, result.errors) == (1, 4)
    assert rows(engine.sql("SELECT timestamp, a FROM t")) == [(dt.datetime(1970, 1, 1, 0, 0, 0, 5000), 2)]


def test_ingest_sampling(engine):
    assert engine.ingest("a", [{"timestamp": i} for i in range(200)], sample_rate=0).sampled_out == 200
    assert engine.ingest("b", [{"timestamp": i} for i in range(200)], sample_rate=1).inserted == 200
    first, again = (engine.ingest(t, [{"timestamp": i} for i in range(500)], sample_rate=0.3, seed=4).inserted for t in "cd")
    assert first == again and 100 < first < 200


def test_flatten_row():
    assert flatten_row({"a": {"b": 1}, "t": ["x", {"y": None}], "e": {}, "f": []}) == {"a.b": 1, "t.0": "x", "t.1.y": None}


def test_discovered_paths(spark):
    docs = [{"a": {"b": 1}, "t": ["x", {"y": None}], "e": {}}, {"a": {"b": 2.5, "it's": True}, "t": [3]}]
    df = spark.createDataFrame([(json.dumps(d),) for d in docs] + [("nonsense",), (None,)], "j string")
    assert {n: t for n, (_, t) in discover(df, "j").items()} == {"a.b": Tag.FLOAT64, "a.it's": Tag.BOOL, "t.0": Tag.STRING, "t.1.y": Tag.NULL}
    flat = flatten(df, "j", {"a.b": Tag.FLOAT64, "t.0": Tag.STRING})
    assert sorted(rows(flat), key=repr) == sorted([(1.0, "x"), (2.5, "3"), (None, None), (None, None)], key=repr)


def test_null_logic(spark, engine):
    engine.ingest("t", [{"timestamp": i, "v": v} for i, v in enumerate((None, 1, 5))])
    def ask(where):
        return [r[0] for r in rows(engine.sql(f"SELECT v FROM t WHERE {where} ORDER BY timestamp"))]

    assert ask("v < 3") == [1] and ask("v != 1") == [5] and ask("v = NULL") == []
    engine.two_valued = True
    assert ask("v < 3") == [None, 1] and ask("v != 1") == [None, 5] and ask("v = NULL") == [None] and ask("v > 3") == [5] and ask("v > NULL") == [1, 5]


def test_mismatched_literals(events):
    for where in ("event = 5", "value = 'x'", "value LIKE 'x'", "timestamp = 'soon'", "timestamp = TRUE"):
        with pytest.raises(E.TypeMismatch):
            events.sql(f"SELECT value FROM events WHERE {where}")
    assert rows(events.sql("SELECT value FROM events WHERE value = 1.5")) == []
    assert rows(events.sql("SELECT value FROM events WHERE timestamp = '1970-01-01 00:00:03'")) == [(3,)]


def test_unknown_names(events):
    for text in ("SELECT nope FROM events", "SELECT value FROM events WHERE nope = 1", "SELECT value FROM events ORDER BY nope", "SELECT event, COUNT(*) FROM events GROUP BY event ORDER BY nope"):
        with pytest.raises(E.UnknownColumn):
            events.sql(text)
    with pytest.raises(E.TableNotFound):
        events.sql("SELECT a FROM nope")
    for text in ("SELECT event, COUNT(*) FROM events", "SELECT * FROM events GROUP BY event", "SELECT value FROM events GROUP BY event", "SELECT COUNT(*), * FROM events"):
        with pytest.raises(E.NotGrouped):
            events.sql(text)


def test_groups_by_name_alias_and_bucket(events):
    assert rows(events.sql("SELECT COUNT(*) AS n, event AS kind FROM events GROUP BY kind ORDER BY kind")) == [(50, "click"), (50, "view")]
    df = events.sql("SELECT value, event, COUNT(*) FROM events GROUP BY event, value ORDER BY value LIMIT 1")
    assert rows(df) == [(0, "click", 1)] and df.columns == ["value", "event", "count_*"]
    df = events.sql("SELECT event, TIME_BUCKET('1 m', timestamp) FROM events GROUP BY TIME_BUCKET('1 m', timestamp), event ORDER BY time_bucket_1, event")
    assert df.columns == ["event", "time_bucket_1"] and rows(df)[:2] == [("click", dt.datetime(1970, 1, 1)), ("view", dt.datetime(1970, 1, 1))]
    assert rows(events.sql("SELECT event FROM events GROUP BY event ORDER BY event")) == [("click",), ("view",)]
    assert rows(events.sql("SELECT event FROM events GROUP BY event ORDER BY MAX(value) DESC")) == [("view",), ("click",)]


@pytest.mark.parametrize("limit", [0, 1 << 60])
def test_null_group_key(engine, limit, monkeypatch):
    monkeypatch.setattr("shardloom.functions.aggregates.SMALL_BYTES", limit)
    engine.ingest("t", [{"timestamp": 1, "k": None, "v": 1}, {"timestamp": 2, "k": "a", "v": 2}, {"timestamp": 3, "v": 4}])
    assert rows(engine.sql("SELECT k, COUNT(*) AS n, P50(v) AS p FROM t GROUP BY k ORDER BY k")) == [(None, 2, 4.0), ("a", 1, 2.0)]


@pytest.mark.parametrize("limit", [0, 1 << 60])
def test_nothing_to_aggregate(events, limit, monkeypatch):
    monkeypatch.setattr("shardloom.functions.aggregates.SMALL_BYTES", limit)
    text = "SELECT COUNT(*) AS n, COUNT(value) AS m, SUM(value) AS s, AVG(value) AS a, MIN(event) AS lo, P95(value) AS p FROM events WHERE value < 0"
    assert rows(events.sql(text)) == [(0, 0, None, None, None, None)]
    assert rows(events.sql("SELECT P95(value) FROM events WHERE value < 0")) == [(None,)]
    assert rows(events.sql("SELECT event, COUNT(*) FROM events WHERE value < 0 GROUP BY event")) == []


def test_min_and_max_keep_types(events):
    assert rows(events.sql("SELECT MIN(event) AS a, MAX(event) AS b, MIN(value) AS c, MAX(latency) AS d, COUNT(event) AS e FROM events")) == [("click", "view", 0, 148.5, 100)]
    with pytest.raises(E.TypeMismatch):
        events.sql("SELECT SUM(event) FROM events")


def test_like_takes_metacharacters_literally(engine):
    engine.ingest("t", [{"timestamp": i, "s": s} for i, s in enumerate(("a.b", "axb", "a(b", "a\nb", "a\\b", "AB"))])
    def ask(pattern, word="LIKE"):
        return {r[0] for r in rows(engine.sql(f"SELECT s FROM t WHERE s {word} '{pattern}'"))}

    assert ask("a.b") == {"a.b"} and ask("a(b") == {"a(b"} and ask("a_b") == {"a.b", "axb", "a(b", "a\nb", "a\\b"}
    assert ask("a%", "NOT LIKE") == {"AB"} and ask("a\\b") == {"a\\b"}


def test_dotted_columns(engine):
    engine.ingest("orders", [{"timestamp": 1, "customer": {"name": "x", "tier": "gold"}, "order": {"total": 5.5, "items": [1, 2]}}])
    assert rows(engine.sql("SELECT customer.tier, SUM(order.total) AS t, MAX(order.items.1) AS m FROM orders GROUP BY customer.tier")) == [("gold", 5.5, 2)]


def nearest(values, p):
    values = sorted(values)
    return values[math.floor(p * (len(values) - 1) + 0.5)]


def test_percentiles_of_many_values(spark):
    """Exact far past any sample; also with negatives, zeros, repeats and wide ranges."""
    values = [((i * 7919) % 20_011) - 3000.5 for i in range(20_000)] + [0.0] * 500 + [1e300, -1e300, 1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    for p in (0.0, 0.01, 0.5, 0.95, 0.999, 1.0):
        assert percentiles(df, [], F.col("v"), [("p", p)]).first().p == nearest(values, p)
    assert df.limit(101).agg(nearest_rank(F.col("v"), 0.9).alias("p")).first().p == nearest([r.v for r in df.limit(101).collect()], 0.9)


@pytest.mark.parametrize("limit", [0, 1 << 60])
def test_percentile_of_a_hundred(engine, limit, monkeypatch):
    monkeypatch.setattr("shardloom.functions.aggregates.SMALL_BYTES", limit)
    engine.ingest("t", [{"timestamp": i, "v": i} for i in range(1, 101)])
    assert rows(engine.sql("SELECT P50(v) AS a, P99(v) AS b, PERCENTILE(v, 0.25) AS c FROM t")) == [(51.0, 99.0, 26.0)]


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 4.9, 5.0, 12.0, None)], "v double")
    assert json.loads(histogram(df, "v", 5).first().histogram) == [[-1, 1], [0, 2], [1, 1], [2, 1]]
    with pytest.raises(ValueError):
        histogram(df, "v", 0)


def test_buckets_floor_before_1970(spark):
    df = spark.createDataFrame([(-1,), (0,), (3_700_000,), (None,)], "t long")
    assert [r[0] for r in df.select(bucket_ms(F.col("t"), 3_600_000)).collect()] == [-3_600_000, 0, 3_600_000, None]


def test_ranges():
    hour, day = 3_600_000, 86_400_000
    assert [auto_bucket(x) for x in (hour, 6 * hour, day, 7 * day, 30 * day, None)] == ["1 minute", "5 minutes", "15 minutes", "1 hour", "6 hours", "5 minutes"]
    assert [preset_bucket(x) for x in ("1h", "6h", "24h", "7d", "30d", "all")] == ["1 minute", "5 minutes", "15 minutes", "1 hour", "6 hours", "5 minutes"]
    assert range_start("1h", 10 * hour) == 9 * hour and range_start("all", 5) is None


def test_now(engine):
    engine.ingest("t", [{"timestamp": 1_000_000 - k * 60_000, "k": k} for k in range(10)])
    assert rows(engine.sql("SELECT COUNT(*) FROM t WHERE timestamp >= NOW() - INTERVAL '5 minutes'")) == [(6,)]
    engine.create_table(TableConfig("empty"))
    assert rows(engine.sql("SELECT COUNT(*) FROM t WHERE timestamp > NOW() - INTERVAL '1 ms'")) == [(1,)]


def test_extended(events):
    text = "SELECT event, PERCENTILE(value, 0.5) AS p, P99(latency) AS q, count(DISTINCT TIME_BUCKET('1 m', timestamp)) AS n, 'P95(x)' AS s FROM events GROUP BY event HAVING count(*) > 1 ORDER BY event"
    assert rows(events.sql_extended(text)) == [("click", 50.0, 147.0, 2, "P95(x)"), ("view", 51.0, 148.5, 2, "P95(x)")]
