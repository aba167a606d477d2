"""Substring search over names by an inverted table of letter groups.

Each name is listed under its distinct groups of one, two and three letters, in lower case. A term reads the partitions of its own groups only, of three letters where it
has as many; names that have all of them are then compared with the term itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partitions of an index, by a hash of the group.
PARTS = 256


def _groups(name: F.Column, size: int) -> F.Column:
    low = F.lower(name)
    return F.when(F.length(low) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda k: F.substr(low, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def part_of(group: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(group), F.lit(PARTS)).cast("int")


def write_index(vertices: DataFrame, path: str) -> None:
    """An index of ``vertices(id, name)``; common groups are dealt to several files by the id."""
    every = F.flatten(F.array(*(_groups(F.col("name"), n) for n in (1, 2, 3))))
    rows = vertices.select("id", "name").where("name is not null").select(F.explode(every).alias("letters"), "id", "name").withColumn("part", part_of(F.col("letters")))
    dealt = rows.repartition("part", F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.sortWithinPartitions("part", "letters").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("part").parquet(path)


def search(spark: SparkSession, path: str, term: str) -> DataFrame:
    """(id, name) of the vertices whose name holds ``term``, whatever the case; an empty term is held by every name."""
    low = term.lower()
    rows = spark.read.parquet(path)
    key = rows.schema["id"].dataType
    wanted = sorted({low[k : k + 3] for k in range(max(len(low) - 2, 1))})
    if not low:
        found = rows.where(F.length("letters") == 1)
    else:
        parts = spark.createDataFrame([(w,) for w in wanted], "w string").select(part_of(F.col("w")).alias("p"))  # as many rows as the term has letters
        found = rows.where(F.col("part").isin([r.p for r in parts.distinct().collect()]) & F.col("letters").isin(wanted))
    have = found.groupBy("id", "name").agg(F.count_distinct("letters").alias("n"))
    return have.where((F.col("n") >= (len(wanted) if low else 1)) & F.contains(F.lower("name"), F.lit(low))).select(F.col("id").cast(key).alias("id"), "name")
