"""Times the engine's headline queries; prints one JSON line.

Cold: the first run over Parquet files. Warm: over the table in memory, median of 5. Hit: from the
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from shardloom import Engine, TableConfig, build_session  # noqa: E402
from shardloom.operators.flatten import flatten  # noqa: E402
from shardloom.types import Tag  # noqa: E402

QUERIES = {
    "count_star": "SELECT COUNT(*) AS n FROM events",
    "count_filtered": "SELECT COUNT(*) AS n FROM events WHERE event_type = 'click'",
    "group_count": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type",
    "avg": "SELECT AVG(value) AS a FROM events",
    "multi_agg": "SELECT COUNT(*) AS n, AVG(value) AS a, MIN(value) AS lo, MAX(value) AS hi FROM events",
    "top_n": "SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id ORDER BY n DESC LIMIT 10",
    "time_bucket": "SELECT TIME_BUCKET('1 hour', timestamp) AS bucket, COUNT(*) AS n FROM events GROUP BY bucket",
    "percentile": "SELECT event_type, P95(value) AS p FROM events GROUP BY event_type",
    "json_group": "SELECT event_type, SUM(props.k) AS s FROM flat GROUP BY event_type",
    "lineitem_agg": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
}


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false", spark_driver_memory="8g", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark, tempfile.mkdtemp(prefix="shardloom-bench-"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("timestamp", F.col("ts").cast("timestamp")).drop("ts")
    frames = {
        "events": events,
        "flat": flatten(events, "props", {"k": Tag.INT64}, "props."),
        "lineitem": spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
    }
    for name, df in frames.items():
        engine.register(name, df)
    engine.sql(QUERIES["count_star"]).collect()  # starts the executors; the queries' own code stays cold
    cold = {k: timed(lambda q=q: engine.sql(q).collect()) for k, q in QUERIES.items()}
    for name, df in frames.items():
        cached = df.cache()
        cached.count()
        engine.register(name, cached)
    warm, hit = {}, {}
    for k, q in QUERIES.items():
        warm[k] = statistics.median(timed(lambda: engine.sql(q).collect()) for _ in range(5))
        engine.query(q)
        hit[k] = statistics.median(timed(lambda: engine.query(q)) for _ in range(200))
    rows = frames["lineitem"].withColumnRenamed("l_shipdate", "timestamp").cache()
    n = rows.count()
    engine.create_table(TableConfig("ingested", shard_ms=365 * 86_400_000))
    engine.append("ingested", rows.limit(1000))  # a first write compiles the writer
    seconds = timed(lambda: engine.append("ingested", rows))
    # JSON, as the reference's clients send it: lines in a column, and objects from the driver
    lines = rows.limit(100_000).select(F.to_json(F.struct(*(F.unix_millis(F.col(c).cast("timestamp")).alias(c) if c == "timestamp" else F.col(c) for c in rows.columns))).alias("value")).cache()
    n_lines = lines.count()
    engine.create_table(TableConfig("ingested_json", shard_ms=365 * 86_400_000))
    json_seconds = timed(lambda: engine.ingest_json("ingested_json", lines))
    objects = [json.loads(r.value) for r in lines.limit(10_000).collect()]
    engine.create_table(TableConfig("ingested_rows", shard_ms=365 * 86_400_000))
    rows_seconds = timed(lambda: engine.ingest("ingested_rows", objects))
    print(
        json.dumps(
            {
                "metric": "cold_seconds_total",
                "value": round(sum(cold.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 4) for k, v in cold.items()},
                "warm": {k: round(v, 4) for k, v in warm.items()},
                "cache_hit_us": {k: round(v * 1e6, 1) for k, v in hit.items()},
                "ingest_rows_per_s": round(n / seconds),
                "ingest_json_rows_per_s": round(n_lines / json_seconds),
                "ingest_objects_rows_per_s": round(len(objects) / rows_seconds),
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0) if os.path.basename(sf_dir.rstrip("/")).startswith("sf") else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
