"""Targets by equality: a table of all that a question may call a vertex, with the one vertex that it means.

A function is called by its id or name, a file by its id, name or path, or by any ending of its path. Of those that answer to a call an exact match comes before an ending
and an earlier row before a later one. That choice is made once, when the table is written, by an aggregate that combines on the map
side, so ``.py``, the ending of every path, is one row like any other; a lookup joins unique keys and reads the partitions of its own calls only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of an index, by a hash of what is called.
PARTS = 256


def part_of(target: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(target), F.lit(PARTS)).cast("int")


def calls(vertices: DataFrame) -> DataFrame:
    """(target, type, id) of ``vertices(id, type, name, filepath, row_ord)``: one row for each thing that a target may say."""
    functions, files = vertices.where("type = 'Function'"), vertices.where("type = 'File'")

    def by(rows: DataFrame, kind: str, target: F.Column, level: int) -> DataFrame:
        return rows.select(target.alias("target"), F.lit(kind).alias("type"), "id", F.struct(F.lit(level).alias("level"), "row_ord").alias("o"))

    lengths = F.sequence(F.lit(1), F.length("filepath"))
    endings = files.where("filepath <> ''").withColumn("ending", F.explode(F.transform(lengths, lambda n: F.right("filepath", n))))
    named = [by(functions, "function", F.col("id"), 0), by(functions, "function", F.col("name"), 1), *(by(files, "file", F.col(c), 0) for c in ("id", "name", "filepath")), by(endings, "file", F.col("ending"), 1)]
    return reduce(DataFrame.unionByName, named).where("target <> ''").groupBy("target", "type").agg(F.min_by("id", "o").alias("id"))


def write_index(vertices: DataFrame, path: str) -> None:
    rows = calls(vertices).withColumn("part", part_of(F.col("target")))
    rows.repartition("part").sortWithinPartitions("part", "target").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(path)


def match_targets(spark: SparkSession, path: str, targets: DataFrame) -> DataFrame:
    """(target, type, id): the vertex that each of ``targets(target, type)`` names."""
    asked = targets.select("target", "type").where("type <> 'unknown' and target <> ''").distinct().withColumn("part", part_of(F.col("target")))
    return spark.read.schema("target string, type string, id string, part int").parquet(path).join(asked, ["target", "type", "part"]).select("target", "type", "id")


def resolve_target(spark: SparkSession, path: str, target: str, kind: str) -> str | None:
    """The vertex of one target; reads one partition."""
    asked = F.lit(target.strip())
    rows = spark.read.schema("target string, type string, id string, part int").parquet(path)
    row = rows.where((F.col("part") == part_of(asked)) & (F.col("target") == asked) & (F.col("type") == kind)).select("id").first()
    return row.id if row else None
