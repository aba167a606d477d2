"""Edges laid out for traversal: written once, then joined hop by hop without being shuffled again.

Each direction is a Parquet table at a path of its own, bucketed and sorted by the node that a hop starts from, so that a hop deals only its frontier. The edges
of a hub would all lie in one bucket; a node with more than ``HUB`` of them is spread over slots by a hash of the other end, and a frontier is
repeated for the slots of the hubs in it.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.operators.components import discard, materialize
from ripplet.operators.traverse import DIRECTIONS, check_depth

#: Edges of a node that lie together at most, about.
HUB = 1_000_000
SIDES = {"out": ("source", "target"), "in": ("target", "source")}


class EdgeLayout:
    """The edges at ``path``, in both directions. ``write`` lays them out, ``EdgeLayout`` opens what was written; both name tables of this session, ``close`` forgets them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.parquet(f"{self.path}/layout").first()
        self.buckets, self.node = row.buckets, row.node
        self.names = {side: f"edges_{side}_{uuid.uuid4().hex}" for side in SIDES}
        for side, name in self.names.items():
            spark.sql(f"create table {name} (src {self.node}, slot int, dst {self.node}, type string) using parquet location '{self.path}/{side}' clustered by (src, slot) sorted by (src) into {self.buckets} buckets")

    @classmethod
    def write(cls, edges: DataFrame, path: str, buckets: int, hub: int = HUB) -> EdgeLayout:
        """Lay out the distinct ``edges(source, target, type)``; rows with a null end are left out."""
        spark, path = edges.sparkSession, path.rstrip("/")
        links = materialize(edges.select("source", "target", "type").where("source is not null and target is not null").distinct(), "links")
        node = links.schema["source"].dataType.simpleString()
        for side, (near, far) in SIDES.items():
            slots = links.groupBy(F.col(near).alias("src")).agg(F.count("*").alias("n")).where(F.col("n") > hub).select("src", F.ceil(F.col("n") / hub).cast("int").alias("slots"))
            slots.write.mode("overwrite").parquet(f"{path}/hubs_{side}")
            hubs = spark.read.schema(f"src {node}, slots int").parquet(f"{path}/hubs_{side}")
            own = links.select(F.col(near).alias("src"), F.col(far).alias("dst"), "type").join(hubs, "src", "left")
            own = own.select("src", F.pmod(F.xxhash64("dst"), F.coalesce("slots", F.lit(1))).cast("int").alias("slot"), "dst", "type")
            name = f"laid_{uuid.uuid4().hex}"
            # dealt as the buckets are, so that each task writes one file
            own.repartition(buckets, "src", "slot").write.mode("overwrite").option("path", f"{path}/{side}").bucketBy(buckets, "src", "slot").sortBy("src").saveAsTable(name)
            spark.sql(f"drop table {name}")  # its files stay
        spark.createDataFrame([(buckets, node)], "buckets int, node string").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")
        discard(links)
        return cls(spark, path)

    def close(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"drop table if exists {name}")

    def hop(self, frontier: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
        """(id) of what ``frontier(id)`` reaches in one step, with repeats."""
        if direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
        found = []
        for side in SIDES if direction == "both" else (direction,):
            edges = self.spark.table(self.names[side])
            if types:
                edges = edges.where(F.col("type").isin(*types))
            hubs = self.spark.read.schema(f"src {self.node}, slots int").parquet(f"{self.path}/hubs_{side}").select(F.col("src").alias("id"), "slots")
            asked = frontier.select("id").join(hubs, "id", "left").select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("slot"))
            found.append(asked.join(edges, ["src", "slot"]).select(F.col("dst").alias("id")))
        return reduce(DataFrame.union, found)

    def reach(self, start: DataFrame, depth: int, direction: str = "out", types: list[str] | None = None) -> DataFrame:
        """(id, distance) of all nodes within ``depth`` steps of ``start(id)``; the start has distance 0."""
        check_depth(depth)
        frontier = materialize(start.select(F.col("id").cast(self.node).alias("id")).where("id is not null").distinct().withColumn("distance", F.lit(0)), "frontier")
        visited, hops = frontier, [frontier]
        for step in range(1, depth + 1):
            found = self.hop(frontier, direction, types).distinct()
            frontier = materialize(found.join(visited, "id", "left_anti").withColumn("distance", F.lit(step)), "frontier")
            hops.append(frontier)
            if frontier.isEmpty():
                break
            visited = visited.union(frontier)
        reached = materialize(visited, "reached")
        for table in hops:
            discard(table)
        return reached
