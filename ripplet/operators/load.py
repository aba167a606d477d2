"""Loading vertices and edges into keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.operators.components import discard, materialize
from ripplet.plans.schemas import EDGE_ENDS, VERTEX_TYPES, VERTICES

_LOADED_VERTICES = VERTICES + ", load_seq bigint, load_row bigint"
_LOADED_EDGES = "source string, target string, source_type string, target_type string, type string"
VERSIONS = "version int, parts array<int>"
#: Parts that a graph is read from at most.
MOST_PARTS = 8


def map_vertex_types(vertices: DataFrame) -> DataFrame:
    """Short vertex types to graph types; unknown ones pass unchanged."""
    known = F.create_map(*(F.lit(x) for pair in VERTEX_TYPES.items() for x in pair))
    return vertices.withColumn("type", F.coalesce(known[F.col("type")], "type"))


def attributes(vertices: DataFrame) -> DataFrame:
    """All but id and type."""
    return vertices.drop("id", "type")


def allowed_edges(edges: DataFrame) -> DataFrame:
    """Edges of unknown types are skipped."""
    return edges.where(F.col("type").isin(*EDGE_ENDS))


def typed_edges(edges: DataFrame) -> DataFrame:
    """Allowed edges with the vertex types of their ends."""
    end = lambda side: F.coalesce(*(F.when(F.col("type") == k, v[side]) for k, v in EDGE_ENDS.items()))
    others = [c for c in edges.columns if c != "type"]
    return allowed_edges(edges).select("type", *others, end(0).alias("source_type"), end(1).alias("target_type"))


def upsert(rows: DataFrame, key: str, order: str | F.Column) -> DataFrame:
    """The latest row of each key, as a map-side aggregate rather than a window."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in others))


def load_graph(spark: SparkSession, vertices: DataFrame, edges: DataFrame, path: str, mode: str = "append") -> tuple[int, int]:
    """Add to the graph at ``path`` (or replace it); returns how many rows were loaded.

    A load is written as one part of its own, vertices under their id and edges as a set, and only then named in a new version, so a
    failed load leaves the last one. Of rows with one id the latest load wins, within a load the later row (``row_ord``, or the
    order of the table). Where there are more than ``MOST_PARTS`` parts the newest and the smallest are written together as one, so that half as many are left, so a small load rewrites small parts only.
    Parts that neither this version nor the one before names are deleted. One load at a time: a second one that writes the same part fails.
    """
    now = current(spark, path)
    version = _next_part(spark, path, -1 if now is None else now[0])
    place = F.col("row_ord").cast("bigint") if "row_ord" in vertices.columns else F.monotonically_increasing_id()
    own = map_vertex_types(vertices).select("id", "type", "name", "filepath", F.lit(version).cast("bigint").alias("load_seq"), place.alias("load_row"))
    links = allowed_edges(edges)
    own, links = materialize(own, "vertices"), materialize(typed_edges(links).select("source", "target", "source_type", "target_type", "type"), "edges")
    loaded = (own.count(), links.count())
    _write(latest(own), links.distinct(), path, version)
    parts = [*(now[1] if now and mode == "append" else []), version]
    if len(parts) > MOST_PARTS:
        small = [version, *sorted(parts[:-1], key=lambda k: _size(spark, f"{path}/p{k}"))[: len(parts) - MOST_PARTS // 2]]
        version += 1
        _write(*_read(spark, path, small), path, version)
        parts = [*(k for k in parts if k not in small), version]
    spark.createDataFrame([(version, parts)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    discard(own)
    discard(links)
    _drop(spark, path, {*parts, *(now[1] if now else [])})
    return loaded


def latest(own: DataFrame) -> DataFrame:
    """One row of each id: of the latest load, and of that the last."""
    return upsert(own, "id", F.struct("load_seq", "load_row")).select("id", "type", "name", "filepath", "load_seq", "load_row")


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _size(spark: SparkSession, path: str) -> int:
    fs, place = _place(spark, path)
    return fs.getContentSummary(place).getLength()


def _next_part(spark: SparkSession, path: str, version: int) -> int:
    """A number above the newest version and above what a load that broke off has left."""
    fs, place = _place(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return max([version, *(int(n[1:]) for n in names if n[0] == "p" and n[1:].isdigit())]) + 1


def _write(own: DataFrame, links: DataFrame, path: str, part: int) -> None:
    own.write.parquet(f"{path}/p{part}/vertices")
    links.write.partitionBy("type").parquet(f"{path}/p{part}/edges")


def _read(spark: SparkSession, path: str, parts: list[int]) -> tuple[DataFrame, DataFrame]:
    own = spark.read.schema(_LOADED_VERTICES).parquet(*(f"{path}/p{k}/vertices" for k in parts))
    links = reduce(DataFrame.unionByName, (spark.read.schema(_LOADED_EDGES).parquet(f"{path}/p{k}/edges") for k in parts))
    return (own, links) if len(parts) == 1 else (latest(own), links.distinct())


def _drop(spark: SparkSession, path: str, keep: set[int]) -> None:
    fs, place = _place(spark, path)
    for found in fs.listStatus(place):
        name = found.getPath().getName()
        if name[0] == "p" and name[1:].isdigit() and int(name[1:]) not in keep:
            fs.delete(found.getPath(), True)


def current(spark: SparkSession, path: str) -> tuple[int, list[int]] | None:
    """The number of the newest version, and its parts."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    row = spark.read.schema(VERSIONS).parquet(f"{path}/versions").agg(F.max("version").alias("v"), F.max_by("parts", "version").alias("p")).first()
    return None if row.v is None else (row.v, row.p)


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the current version."""
    now = current(spark, path)
    if now is None:
        raise FileNotFoundError(f"no graph at {path}")
    own, links = _read(spark, path, now[1])
    return own.drop("load_seq", "load_row"), links
