"""Incremental parsing: files whose time or size changed are parsed again, and only the parts of the cache that hold them are written again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.functions.extract import parsed_files
from ripplet.operators.components import discard, materialize
from ripplet.plans.schemas import PARSED
from ripplet.sources.discover import stat_files, with_content

KEY = ["path_id", "mtime_ns", "size"]
#: Parts of a cache, by a hash of the path.
PARTS = 64
CACHED = f"{PARSED}, gone boolean, part int"


def hits(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached rows of unchanged files, in today's order."""
    return files.select("file_ord", *KEY).join(cached.drop("file_ord"), KEY)


def misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    return files.join(cached.select(*KEY), KEY, "left_anti")


class ParseCache:
    """Parsed files under one folder, partitioned by a hash of the path. Rows of deleted files stay, marked as gone, so that no part runs empty."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _rows(self) -> DataFrame:
        fs, path = self._fs()
        return self.spark.read.schema(CACHED).parquet(self.path) if fs.exists(path) else self.spark.createDataFrame([], CACHED)

    def load(self) -> DataFrame:
        """All that is known, of deleted files as well."""
        return self._rows().drop("gone", "part")

    def live(self) -> DataFrame:
        """What is known of files that were there at the last update."""
        return self._rows().where("not gone").drop("gone", "part")

    def save(self, parsed: DataFrame, gone: DataFrame | None = None) -> None:
        """Rows of the same path are replaced, those of ``gone(path_id)`` marked, others kept; parts without any such path are not touched.

        ``parsed`` and ``gone`` are read twice, so they should be tables. A part is replaced as a whole, by Spark's dynamic overwrite: after a run that broke off, the next one parses again what is not in it.
        """
        part = F.pmod(F.xxhash64("path_id"), F.lit(PARTS)).cast("int")
        marks = self.spark.createDataFrame([], "path_id string") if gone is None else gone.select("path_id")
        changed = parsed.select("path_id").union(marks)
        touched = F.broadcast(changed.select(part.alias("part")).distinct())  # as many rows as there are parts
        older = self._rows().join(touched, "part", "left_semi")
        kept = older.join(changed.distinct(), "path_id", "left_anti")
        marked = older.join(marks.distinct(), "path_id", "left_semi").join(parsed.select("path_id"), "path_id", "left_anti").withColumn("gone", F.lit(True))
        fresh = parsed.withColumns({"gone": F.lit(False), "part": part})
        whole = fresh.unionByName(kept.select(*fresh.columns)).unionByName(marked.select(*fresh.columns))
        whole.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def clear(self) -> bool:
        fs, path = self._fs()
        return bool(fs.delete(path, True))


def clear_all(spark: SparkSession, root: str) -> int:
    """Delete every cache below ``root``; how many there were."""
    fs, path = ParseCache(spark, root)._fs()
    found = [str(s.getPath()) for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
    return sum(ParseCache(spark, p).clear() for p in found)


def update(files: DataFrame, cache: ParseCache) -> tuple[DataFrame, dict[str, int]]:
    """The parsed rows of ``files`` (``STAT``), each new or changed one parsed once, and how many were parsed and how many had gone.

    What the cache knows beside ``files`` is marked as gone.
    """
    cached = cache.live()
    parsed = materialize(parsed_files(with_content(misses(files, cached))), "parsed")
    gone = materialize(cached.select("path_id").join(files.select("path_id"), "path_id", "left_anti"), "gone")
    counts = {"parsed": parsed.count(), "gone": gone.count()}
    if any(counts.values()):
        cache.save(parsed, gone)
    for x in (parsed, gone):
        discard(x)
    return files.select("file_ord", "path_id").join(cache.live().drop("file_ord"), "path_id"), counts


def parse_directory(spark: SparkSession, directory: str, cache: ParseCache | None = None) -> DataFrame:
    """Parsed files of a tree; with a cache, only new and changed ones are read and parsed."""
    files = stat_files(spark, directory)
    if cache is None:
        return parsed_files(with_content(files))
    return update(materialize(files, "files"), cache)[0]


def cache_counts(files: DataFrame, cached: DataFrame) -> DataFrame:
    known = cached.select(*KEY).withColumn("hit", F.lit(1))
    return files.join(known, KEY, "left").agg(F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"))
