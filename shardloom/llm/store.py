"""Intermediate tables in the folder that driver and executors share.

Cutting lineage with a written table keeps a long job recoverable: a lost
executor costs the tasks of the current step only.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new temporary one only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not top:
        top = sc.getCheckpointDir()
    if not top:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="shardloom-")
        sc.setCheckpointDir(top)
    return top.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    top = f"{shared_dir(spark)}/shardloom-{spark.sparkContext.applicationId}"
    _forget_at_exit(spark, top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


_registered: set[str] = set()


def _forget_at_exit(spark: SparkSession, top: str) -> None:
    if top not in _registered:
        _registered.add(top)
        atexit.register(_drop_quietly, spark, top)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session may be gone by now
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Delete a path through the Hadoop file system it lives in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch between the JVM and Python, which both hold outside the heap, and twice while it grows.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session small, from here on: rows here can be whole texts or sets.

    The setting is read when a plan runs, which is after the operator has returned it, so it stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m").lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(now[:-1]) * units[now[-1]] if now[-1] in units else int(now)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
