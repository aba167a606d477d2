"""Small tables that are rewritten whole: versions under one folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """The newest whole version is the table; the one before stays as well, since a table that was read from it may still be in use."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[str]:
        fs, path = self._fs()
        done = [str(s.getPath()) for s in fs.listStatus(path)] if fs.exists(path) else []
        jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(p for p in done if fs.exists(jpath(f"{p}/_SUCCESS")))

    def load(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(found[-1]) if found else self.spark.createDataFrame([], self.schema)

    def replace(self, rows: DataFrame) -> DataFrame:
        """Write the next version; ``rows`` may read the one before."""
        before = self.versions()
        number = int(before[-1].rsplit("/v", 1)[1][:12]) + 1 if before else 0
        rows.write.parquet(f"{self.path}/v{number:012d}-{uuid.uuid4().hex[:8]}")
        fs, _ = self._fs()
        for old in before[:-1]:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(old), True)
        return self.load()

    def clear(self) -> bool:
        fs, path = self._fs()
        return bool(fs.delete(path, True))
