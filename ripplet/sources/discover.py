"""Finding the Python files of a tree in parallel.

Directories are listed in tasks, in rounds that go some levels deeper each, and only whether any are left comes back to the driver. The order of the scan (the files of a
directory by name, then its subdirectories by name) is a sort key of the path, so numbers come from one range-partitioned sort
and prefix sums over the sizes of its partitions. Executors must see the tree under the same path, as on a shared mount.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplet.operators.components import discard, materialize
from ripplet.sources.pytree import EXCLUDED

FOUND = "folder string, path string, mtime_ns bigint, size bigint"
STAT = "file_ord int, filepath string, path_id string, mtime_ns bigint, size bigint"
_ARROW = pa.schema([("folder", pa.string()), ("path", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64())])


#: Directories that a task lists for each that it is given; what lies deeper waits for the next round.
EXPANDED = 256


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with a path for each Python file, and one with a folder for each directory that is left to the next round; links to directories are not followed."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            waiting, listed = deque([folder]), 0
            while waiting and listed < EXPANDED:
                rows = []
                with os.scandir(waiting.popleft()) as entries:
                    for e in entries:
                        if e.name.endswith(".py") and e.is_file():
                            stat = e.stat()
                            rows.append((None, e.path, stat.st_mtime_ns, stat.st_size))
                        elif e.is_dir(follow_symlinks=False) and e.name not in EXCLUDED and not e.name.startswith("."):
                            waiting.append(e.path)
                listed += 1
                if rows:
                    yield _rows(rows)
            if waiting:
                yield _rows([(x, None, None, None) for x in waiting])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _numbered(files: DataFrame, root: str) -> DataFrame:
    """The files with their place in the scan, from 0 on."""
    parts = F.split(F.substr("path", F.lit(len(root) + 1)), "/")
    key = F.transform(parts, lambda name, at: F.struct((at < F.size(parts) - 1).alias("deeper"), name.alias("name")))
    at = F.monotonically_increasing_id()
    placed = materialize(files.orderBy(key).select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("row")), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    first = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    return placed.join(F.broadcast(first), "part").select((F.col("first") + F.col("row")).cast("int").alias("file_ord"), F.col("path").alias("filepath"), F.col("path").alias("path_id"), "mtime_ns", "size")


def stat_files(spark: SparkSession, directory: str) -> DataFrame:
    """``STAT`` of every Python file below a directory, in the order of the scan; contents are not read."""
    root = os.path.join(os.path.abspath(directory), "")
    level = spark.createDataFrame([(root.rstrip("/") or "/",)], "folder string")
    levels: list[DataFrame] = []
    while True:
        found = materialize(level.repartition("folder").mapInArrow(_list, FOUND), "listed")
        levels.append(found)
        level = found.where("folder is not null").select("folder")
        if level.isEmpty():
            break
    files = spark.read.schema(FOUND).parquet(*(x._written_to for x in levels)).where("path is not null")
    numbered = _numbered(files, root)
    for x in levels:
        discard(x)
    return numbered


def with_content(files: DataFrame) -> DataFrame:
    """The same rows with the bytes of each file; one that has gone meanwhile is left out."""
    schema = pa.schema([*((n, t) for n, t in (("file_ord", pa.int32()), ("filepath", pa.string()), ("path_id", pa.string()), ("mtime_ns", pa.int64()), ("size", pa.int64()))), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # one file at a time, as they may be long
                try:
                    with open(row["filepath"], "rb") as f:
                        content = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_pylist([row | {"content": content}], schema=schema)

    return files.select(*(c.split()[0] for c in STAT.split(", "))).mapInArrow(run, STAT + ", content binary")
