"""A watched source tree as a stream.

``pytree_watch`` is a streaming data source with one row a batch: its offset is a digest over the path, time and size of every Python file of the tree, and as
long as it stays the same there is no batch. A batch lists the tree as it is when the batch runs, in tasks; which files are new, changed or gone then follows from the parse
cache. So a batch that is run again, after a failure or a restart from the checkpoint, brings graph and cache to the same state as a full parse of the tree.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from ripplet.functions.extract import calls_of, functions_of, imports_of
from ripplet.operators import build
from ripplet.operators.cache import ParseCache, update
from ripplet.operators.components import discard, materialize
from ripplet.operators.load import load_graph
from ripplet.plans.shipping import ship
from ripplet.sources.discover import stat_files
from ripplet.sources.pytree import walk

STATE = "digest string, files bigint"


class _State(InputPartition):
    def __init__(self, digest: str, files: int) -> None:
        self.digest, self.files = digest, files


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str) -> None:
        self.root = os.path.abspath(root)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"digest": "", "files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The state of the tree; no list of its files is kept."""
        digest, files = hashlib.sha256(), 0
        for path in walk(self.root):
            try:
                stat = os.stat(path)
            except FileNotFoundError:
                continue
            digest.update(f"{path}\0{stat.st_mtime_ns}\0{stat.st_size}\0".encode())
            files += 1
        return {"digest": digest.hexdigest(), "files": files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_State(end["digest"], end["files"])]

    def read(self, partition: _State) -> Iterator[tuple]:
        yield partition.digest, partition.files

    def commit(self, end: dict) -> None:
        pass


class WatchedTree(DataSource):
    """``spark.readStream.format("pytree_watch").load(directory)``"""

    @classmethod
    def name(cls) -> str:
        return "pytree_watch"

    def schema(self) -> str:
        return STATE

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Reader(self.options["path"])


def states(spark: SparkSession, directory: str) -> DataFrame:
    """One row whenever the tree has changed."""
    spark.dataSource.register(WatchedTree)
    return spark.readStream.format("pytree_watch").load(directory)


def apply_listing(files: DataFrame, cache: ParseCache, graph_path: str, mode: str = "reference") -> dict[str, int]:
    """Bring cache and graph to the state of one listing: each new or changed file is parsed once; a graph is replaced only if anything changed."""
    files = materialize(files, "listing")
    rows, counts = update(files, cache)
    if any(counts.values()):
        parsed = materialize(rows, "parsed")
        known, functions = parsed.select("file_ord", "filepath", "path_id"), functions_of(parsed)
        load_graph(files.sparkSession, build.vertices(known, functions), build.edges(known, functions, calls_of(parsed), imports_of(parsed), mode), graph_path, "replace")
        discard(parsed)
    discard(files)
    return counts


def watch(spark: SparkSession, directory: str, cache_path: str, graph_path: str, checkpoint: str, mode: str = "reference", once: bool = True, interval: str = "30 seconds", seen: list | None = None) -> StreamingQuery:
    """Keep the graph of a tree up to date: what has changed since the checkpoint, then end (``once``), or every ``interval``.

    ``seen`` takes the counts of each batch: how many files were parsed, and how many had gone.
    """
    ship(spark)

    def apply(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        counts = apply_listing(stat_files(session, directory), ParseCache(session, cache_path), graph_path, mode)
        if seen is not None:
            seen.append(counts)

    stream = states(spark, directory).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime=interval)).start()
