"""Session settings that the engine's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Needed for right results.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}
#: For speed on any size: partitions are sized at run time, skewed joins split.
PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "shardloom", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` use underscores for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (SEMANTICS | PLANNING | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Set what results depend on, on a session that someone else built."""
    for k, v in SEMANTICS.items():
        spark.conf.set(k, v)
    return spark
