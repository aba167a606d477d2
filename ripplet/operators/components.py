"""Connected components by alternating large-star and small-star contraction.

Every round is two aggregate-and-join steps over the edges; nothing but two
numbers per round reaches the driver, and lineage is cut by a reliable
checkpoint, so that a lost executor costs one round at most.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (as in tests on one machine) a temporary folder is made and set. On a cluster, where executors would not share it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.conf.get("spark.ripplet.scratch", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ripplet-")
        spark.conf.set("spark.ripplet.scratch", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to the shared folder, partitioned if need be, and read it back: a cut in the lineage that survives lost executors.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.partitionBy(*by).parquet(path)
    fs, place = _place(spark, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    fs, place = _place(df.sparkSession, df._written_to)
    fs.delete(place, True)


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component is the smallest node reachable.

    Self-loops keep their node; rows with a null end are ignored; an empty
    input gives an empty result. Raises if ``max_rounds`` do not suffice.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null")
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    pairs = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    pairs = materialize(pairs, "edges")
    before = None
    for _ in range(max_rounds):
        older, pairs = pairs, materialize(_star(_star(pairs, large=True), large=False), "stars")
        discard(older)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return found.union(alone.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def _anew(name: str, rows: DataFrame) -> F.Column:
    """The same values, as a column that no longer counts as partitioned.

    A join on it shuffles both of its sides itself, and only then does AQE split the edges of a hub.
    """
    if rows.schema[name].dataType.typeName() == "string":
        return F.reverse(F.reverse(name))
    return F.col(name).cast("decimal(20,0)").cast(rows.schema[name].dataType)


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One contraction of distinct pairs u > v.

    The large star hangs every larger neighbour on the node's smallest one; the
    small star does so with the smaller neighbours and the node itself.
    """
    key = _anew("u", pairs).alias("k")
    if large:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(key, F.least("u", "m").alias("m"))
        moved = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        moved = pairs.join(least.select(key, "m"), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()
