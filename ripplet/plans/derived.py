"""A program graph derived from the star-schema test tables, whole tables throughout.

Suppliers are files, the parts they deliver are functions, consecutive lines of an order are calls, and
regions, nations and paths are imported modules. Of parts, consecutive lines make a typed graph: returned lines
call, accepted ones import, others contain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), "s_name", F.lit(".py"))
    return _places(spark, sf_dir).select(F.col("s_suppkey").alias("file_ord"), path.alias("filepath"), path.alias("path_id"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    named = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    return named.join(files(spark, sf_dir).select("file_ord", "path_id"), F.col("l_suppkey") == F.col("file_ord")).select("file_ord", F.col("l_partkey").alias("func_ord"), "path_id", F.col("p_name").alias("name"))


def _consecutive(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), *columns)
    b = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("next_partkey"))
    return a.join(b, ["l_orderkey", "l_linenumber"])


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _consecutive(spark, sf_dir, "l_suppkey", "l_partkey").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("next_partkey") == F.col("p_partkey"))
    return pairs.select(F.col("l_suppkey").alias("file_ord"), F.col("l_partkey").alias("func_ord"), F.col("p_name").alias("callee"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file its nation, region and nation, full dotted path, and a module that does not exist."""
    dot = F.lit(".")
    modules = F.array("n_name", F.concat("r_name", dot, "n_name"), F.concat("r_name", dot, "n_name", dot, "s_name"), F.col("s_name"), F.concat(F.lit("missing."), "s_name"))
    return _places(spark, sf_dir).select(F.col("s_suppkey").alias("file_ord"), F.explode(modules).alias("module"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges between parts, as a set."""
    kind = F.when(F.col("l_returnflag") == "R", "CALLS").when(F.col("l_returnflag") == "A", "IMPORTS").otherwise("CONTAINS")
    return _consecutive(spark, sf_dir, "l_partkey", "l_returnflag").select(F.col("l_partkey").alias("source"), F.col("next_partkey").alias("target"), kind.alias("type")).distinct()


def first_caller(graph: DataFrame) -> DataFrame:
    """The first part that calls another."""
    return graph.where("type = 'CALLS'").agg(F.min("source").alias("id"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python source text for every supplier: two imports, and for every part a function that calls the parts after it in orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    follows = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next_partkey"))
    # one list for each supplier: by part, calls in order, lines that nothing follows last
    entry = F.struct("l_partkey", F.col("next_partkey").isNull().alias("none"), "l_orderkey", "l_linenumber", "next_partkey")
    listed = lines.where("l_partkey is not null").join(follows, ["l_orderkey", "l_linenumber"], "left").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(entry)).alias("e"))

    def line(x: F.Column, i: F.Column) -> F.Column:
        """With its function's head before the first line of each part; null where nothing follows but something did before."""
        body = F.concat(F.lit("    part_"), x["next_partkey"].cast("string"), F.lit("()"))
        head = F.concat(F.lit("def part_"), x["l_partkey"].cast("string"), F.lit("():\n"))
        again = F.get("e", i - 1)["l_partkey"].eqNullSafe(x["l_partkey"])
        return F.when(again, body).otherwise(F.concat(head, F.coalesce(body, F.lit("    pass"))))

    defined = listed.select("l_suppkey", F.array_join(F.transform("e", line), "\n").alias("defs"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    key = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit("import nation_"), key("s_nationkey"), F.lit("\nfrom ledger import s_"), key("s_suppkey"), F.lit(", total\n"))
    path = F.concat(F.lit("s_"), key("s_suppkey"), F.lit(".py"))
    text = F.concat(head, F.coalesce("defs", F.lit("")), F.lit("\n"))
    return suppliers.join(defined, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_suppkey").cast("int").alias("file_ord"), path.alias("filepath"), path.alias("path_id"), F.lit(0).cast("bigint").alias("mtime_ns"), F.length(text).cast("bigint").alias("size"), F.encode(text, "UTF-8").alias("content")
    )
