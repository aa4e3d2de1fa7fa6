"""What tables write, refuse and say about reads; streams that are run again; deep traces; slices of percentiles."""

import json

import pytest
from pyspark.sql import functions as F

from shardloom import Engine, TableConfig
from shardloom.functions import aggregates
from shardloom.operators import traces
from shardloom.operators.sampling import subsample
from shardloom.streaming.ingest import StreamIngest
from shardloom.upkeep import Upkeep


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/tables", clock=lambda: 1000.0)


def values(df):
    return sorted(r[0] for r in df.collect())


def test_bloom_filters(spark, engine):
    engine.ingest("t", [{"timestamp": i, "name": f"n{i}", "k": i, "v": i / 2} for i in range(200)])
    path = next(f for f in engine.catalog.get("t").scan().inputFiles())
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    chunks = reader.getFooter().getBlocks().get(0).getColumns()
    found = {c.getPath().toDotString(): c.getBloomFilterOffset() > 0 for c in (chunks.get(i) for i in range(chunks.size()))}
    reader.close()
    assert found == {"timestamp": False, "name": True, "k": True, "v": False}
    assert values(engine.sql("SELECT k FROM t WHERE name = 'n7'")) == [7]


def test_sealed_shards_refuse_rows(engine):
    engine.create_table(TableConfig("t", shard_ms=1000, subsample_after_ms=2000))
    engine.ingest("t", [{"timestamp": t, "v": t} for t in (0, 1500, 990_500)])
    Upkeep(engine).run_once(3500)
    assert engine.catalog.get("t").sealed == {0}
    late = engine.ingest("t", [{"timestamp": 10, "v": 1}, {"timestamp": 1600, "v": 2}, {"v": 3}])
    assert (late.inserted, late.errors) == (1, 2)
    again = Engine(engine.spark, engine.root)
    assert again.ingest("t", [{"timestamp": 20, "v": 9}]).errors == 1 and values(again.sql("SELECT v FROM t")) == [0, 2, 1500, 990_500]


def test_answers_say_what_was_read(engine):
    engine.create_table(TableConfig("t", shard_ms=1000))
    engine.ingest("t", [{"timestamp": t, "v": t} for t in range(0, 10_000, 500)])
    text = "SELECT v FROM t WHERE timestamp >= 2500 AND timestamp < 4000 AND v > 2600"
    for _ in range(2):
        answer = engine.query(text).response()
        assert (answer["row_count"], answer["rows_scanned"], answer["shards_scanned"]) == (2, 4, 2)
    engine.register("f", engine.sql("SELECT v FROM t"))
    assert engine.query("SELECT COUNT(*) FROM f").response()["rows_scanned"] is None


def test_a_table_is_known_before_its_first_file(engine, spark, monkeypatch):
    """A write that breaks off leaves a table that can be read and written."""
    engine.create_table("t")
    bad = spark.createDataFrame([(1, 0)], "timestamp long, x long").withColumn("x", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        engine.append("t", bad)
    again = Engine(spark, engine.root)
    assert again.sql("SELECT COUNT(*) FROM t").collect()[0][0] == 0
    again.ingest("t", [{"timestamp": 1, "x": "s"}])
    again.ingest("t", [{"timestamp": 1, "x": 5}])
    assert sorted(Engine(spark, engine.root).sql("SELECT x FROM t").collect()) == [("5",), ("s",)]


def test_streams_pass_over_bad_messages_and_replays(spark, engine):
    messages = [("x", '{"timestamp": 1, "v": 1}'), ("x", '{"table": "a/b", "rows": [{"timestamp": 1}, {"timestamp": 2}]}'), ("y", '{"timestamp": 2, "v": 5}')]
    batch = spark.createDataFrame(messages, "topic string, value string")
    first = StreamIngest(engine)
    first.process(batch, 3)
    assert (first.stats.received, first.stats.rows, first.stats.errors) == (3, 2, 2)
    replay = StreamIngest(engine)
    replay.process(batch, 3)
    assert replay.stats.rows == 0 and values(engine.sql("SELECT v FROM x")) == [1] and values(engine.sql("SELECT v FROM y")) == [5]
    replay.process(batch, 4)
    assert values(engine.sql("SELECT v FROM x")) == [1, 1]
    other = StreamIngest(engine, name="other")
    other.process(batch, 3)
    assert values(engine.sql("SELECT v FROM x")) == [1, 1, 1]
    assert json.loads(engine.catalog.store.read_text("x/_streams.json")) == {"stream": 4, "other": 3}


def test_traces_of_any_depth(spark):
    deep = [("t", f"s{i}", f"s{i - 1}" if i else "") for i in range(70)]
    loop = [("u", "a", ""), ("u", "b", "a"), ("u", "a", "b"), ("v", "x", "y"), ("v", "y", "x")]
    columns = "trace_id string, span_id string, parent_span_id string"
    got = {(r.trace_id, r.span_id): r.depth for r in traces.tree(spark.createDataFrame(deep[:12] + loop, columns).coalesce(1)).collect()}
    assert all(got["t", f"s{i}"] == i for i in range(12)) and got["u", "b"] == 1 and got["v", "x"] is None


def test_slices_of_a_narrow_column(spark):
    base = 1_700_000_000_000
    df = spark.range(5000).select(F.lit("g").alias("k"), (F.lit(base) + F.col("id") * 7).cast("double").alias("v"))
    edges = df.agg(F.percentile_approx("v", F.array(*(F.lit(k / aggregates.SLICES) for k in range(1, aggregates.SLICES))), F.lit(20 * aggregates.SLICES)).alias("e"))
    side = int(aggregates.SLICES**0.5)
    coarse = F.transform(F.sequence(F.lit(side - 1), F.lit(aggregates.SLICES - 2), F.lit(side)), lambda k: F.get("e", k))
    sizes = df.crossJoin(edges.withColumn("c", coarse)).groupBy(aggregates._slice(F.col("v"), F.col("e"), F.col("c")).alias("s")).count().collect()
    assert len(sizes) > 200 and max(r["count"] for r in sizes) < 60
    values_ = [base + 7 * i for i in range(5000)] + [float("nan"), float("-inf")]
    mixed = spark.createDataFrame([("g", float(v)) for v in values_] + [("h", 1.0), ("n", None)], "k string, v double")
    got = {r.k: (r.p, r.q) for r in aggregates.percentiles(mixed, [("k", F.col("k"))], F.col("v"), [("p", 0.0), ("q", 0.5)]).collect()}
    assert got["g"] == (float("-inf"), sorted(values_[:5000])[2500]) and got["h"] == (1.0, 1.0) and set(got) == {"g", "h"}


def test_subsample_of_any_ratio(spark):
    df = spark.range(3000)
    for ratio in (0, 0.0004, 0.3, 1, 2):
        sample, stats = subsample(df, ratio, 5, "id")
        assert sample.distinct().count() == stats.target == min(3000, -int(-3000 * ratio // 1))
    assert subsample(df.limit(0), 0.5)[0].count() == 0
