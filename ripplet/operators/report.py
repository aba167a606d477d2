"""What is shown of a graph and of an impact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.functions.scalars import display_name, node_type, risk


def affected_nodes(ids: DataFrame) -> DataFrame:
    return ids.select("id", display_name(F.col("id")).alias("name"), node_type(F.col("id")).alias("type"))


def affected_details(ids: DataFrame, vertices: DataFrame) -> DataFrame:
    """Attributes of affected vertices; ids without a vertex drop out."""
    return ids.select("id").join(vertices, "id")


def risk_levels(counts: DataFrame, column: str = "n_affected") -> DataFrame:
    return counts.withColumn("risk", risk(F.col(column)))


#: Fixed value: what is said of a change without impact.
NO_IMPACT = "**No downstream impact detected.**\n\nChanging `{target}` does not appear to affect any other functions or files in the analyzed codebase."


def explanation(question: str, target: str, names: list[str], writer: Callable[[str], str] | None = None, total: int | None = None) -> str:
    """Prose about an impact: a fixed text if there is none, else by a callable or a template. ``names`` may be the first of ``total``."""
    if not names:
        return NO_IMPACT.format(target=target)
    total = len(names) if total is None else total
    listed = "\n".join([*(f"  • {n}" for n in names), *([f"  … and {total - len(names)} more"] if total > len(names) else [])])
    if writer:
        return writer(f"Question: {question}\nTarget: {target}\nAffected:\n{listed}\nExplain the impact and its risk.")
    return f"Changing `{target}` affects {total} item(s):\n{listed}"


def counts_by_type(rows: DataFrame, types: list[str], name: str = "n") -> DataFrame:
    """Counts of the given types, zero where there are none."""
    every = rows.sparkSession.createDataFrame([(t,) for t in types], "type string")
    return every.join(rows.groupBy("type").agg(F.count("*").alias(name)), "type", "left").na.fill(0, [name])


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    both = vertices.select(F.lit("node").alias("what"), "type").union(edges.select(F.lit("edge"), "type"))
    nodes = F.col("what") == "node"
    return both.agg(
        F.count_if(nodes).alias("nodes"), F.count_if(nodes & (F.col("type") == "File")).alias("files"),
        F.count_if(nodes & (F.col("type") == "Function")).alias("functions"), F.count_if(~nodes).alias("edges"),
    )


def degrees(vertices: DataFrame, edges: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """In and out degree over all edges, repeats counted, edge types in and out, and distinct neighbours over the visible edges.

    Ends are grouped before the join, so that a hub is one row there.
    """
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("in_types"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("out_types"))
    near = neighbour_pairs(edges if visible is None else visible).groupBy("id").agg(F.count("*").alias("connections"))
    found = vertices.select("id").join(into, "id", "left").join(out, "id", "left").join(near, "id", "left")
    return found.na.fill(0, ["in_degree", "out_degree", "connections"]).na.fill("", ["in_types", "out_types"])


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """Distinct (id, neighbour), either direction."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("neighbour"))
    return out.union(out.select(F.col("neighbour").alias("id"), F.col("id").alias("neighbour"))).distinct()


def neighbours(edges: DataFrame, node) -> DataFrame:  # noqa: ANN001
    return neighbour_pairs(edges.where((F.col("source") == node) | (F.col("target") == node))).where(F.col("id") == node).select("neighbour")


def search(vertices: DataFrame, term: str) -> DataFrame:
    return vertices.where(F.lower("name").contains(term.lower()))


def visible_edges(edges: DataFrame, enabled: list[str]) -> DataFrame:
    return edges.where(F.col("type").isin(*enabled))


def highlighted(vertices: DataFrame, ids: DataFrame) -> DataFrame:
    mark = ids.select("id").distinct().withColumn("hit", F.lit(True))
    return vertices.join(mark, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def graph_payload(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return vertices.select("id", F.col("name").alias("label"), "type", "filepath"), edges.select("source", "target", "type")


def parse_totals(parsed: DataFrame) -> DataFrame:
    return parsed.agg(
        F.count("*").alias("files"), F.coalesce(F.sum(F.size("functions")), F.lit(0)).alias("functions"),
        F.coalesce(F.sum(F.size("imports")), F.lit(0)).alias("imports"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
