"""Files through Spark's Hadoop file systems, so that data can lie in any store."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..errors import StorageError


class Store:
    """A folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(path))
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *(p for p in parts if p)])

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0

    def write_text(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the folder that driver and executors share; a local one only where none is set, on one machine."""
    import re
    import tempfile
    import uuid

    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top and not re.match(r"local(\[|$)", sc.master):
        raise StorageError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(top or tempfile.mkdtemp(prefix='shardloom-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
