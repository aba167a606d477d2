"""Bounded-depth traversal.

``reach`` advances a frontier one hop at a time: a join with the edges, an anti join with what has been
visited, and a reliable cut of the lineage. It revisits nothing and stops when the frontier is empty. ``reach_sql``
is the same as one recursive query, for graphs whose levels stay within the row limit of recursion.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.operators.components import discard, materialize

DIRECTIONS = ("out", "in", "both")


def steps(edges: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
    """Distinct (src, dst) in the direction of travel; the type filter reaches the scan."""
    return _links(edges, direction, types).distinct()


def _links(edges: DataFrame, direction: str, types: list[str] | None = None) -> DataFrame:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}, not {direction!r}")
    if types:
        edges = edges.where(F.col("type").isin(*types))
    out = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return (out if direction == "out" else back if direction == "in" else out.union(back)).where("src is not null and dst is not null")


def check_depth(depth: int, api: bool = False) -> int:
    if depth < 0 or api and not 1 <= depth <= 20:
        raise ValueError(f"depth out of range: {depth}")
    return depth


def reach(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, distance) of all nodes within ``depth`` steps of ``start(id)``; the start has distance 0.

    ``links`` may have repeats: each hop makes its nodes distinct, so all links need not be shuffled for that first."""
    check_depth(depth)
    links = materialize(links, "links")
    frontier = materialize(start.select("id").distinct().withColumn("distance", F.lit(0)), "frontier")
    visited, hops = frontier, [frontier]
    for hop in range(1, depth + 1):
        found = frontier.join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = materialize(found.join(visited, "id", "left_anti").withColumn("distance", F.lit(hop)), "frontier")
        hops.append(frontier)
        if frontier.isEmpty():
            break
        visited = visited.union(frontier)
    reached = materialize(visited, "reached")
    for table in (links, *hops):
        discard(table)
    return reached


def reach_sql(links: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """As ``reach``, in one recursive query."""
    check_depth(depth)
    return links.sparkSession.sql(
        """with recursive r(id, distance) as (
             select id, 0 from {start} union all
             select distinct e.dst, r.distance + 1 from r join {links} e on r.id = e.src where r.distance < :depth)
           select id, min(distance) as distance from r group by id""",
        args={"depth": depth}, start=start.select("id").distinct(), links=links,
    )


def _start(edges: DataFrame, start: str | int | DataFrame) -> DataFrame:
    if isinstance(start, DataFrame):
        return start.select("id")
    return edges.sparkSession.createDataFrame([(start,)], f"id {edges.schema['source'].dataType.simpleString()}")


def _ways(edges: DataFrame, direction: str, types: list[str], method) -> DataFrame:  # noqa: ANN001
    """Links with repeats for ``reach``; other methods get each link once."""
    return (_links if method is reach else steps)(edges, direction, types)


def impact_analysis(edges: DataFrame, start, max_depth: int = 5, direction: str = "out", method=reach) -> DataFrame:  # noqa: ANN001
    """Functions that a change of ``start`` reaches over CALLS edges; the start itself is not among them."""
    return method(_ways(edges, direction, ["CALLS"], method), _start(edges, start), max_depth).where("distance >= 1")


def hop_detection(edges: DataFrame, start, num_hops: int = 2, direction: str = "out", method=reach) -> DataFrame:  # noqa: ANN001
    """All nodes within ``num_hops`` over any known edge type, the start included."""
    return method(_ways(edges, direction, ["CALLS", "IMPORTS", "CONTAINS"], method), _start(edges, start), num_hops)


def affected(edges: DataFrame, start: str, target_type: str, depth: int = 5, direction: str = "out") -> DataFrame:
    """Function targets go to ``impact_analysis``, all others to ``hop_detection``; a start outside the graph has no result."""
    if target_type == "function":
        return impact_analysis(edges, start, depth, direction)
    return hop_detection(edges, start, depth, direction)


def raw_result_ids(raw: DataFrame) -> DataFrame:
    """The columns of ``raw`` but ``raw``, and id: the nodes of each raw JSON result, repeats included.

    A result is a list of sets of nodes: ``@@affected`` where it is not empty, else ``@@reachable``. A node is a string, or an object of which the v_id, the id or
    the name counts, or else its JSON text. Bad JSON has one row with a null id; results without nodes have none.
    """
    own = F.struct(*(c for c in raw.columns if c != "raw"))
    found = raw.sparkSession.sql(
        """with parsed as (select own, try_parse_json(raw) as v from {raw}),
        sets as (select own, one from parsed, lateral variant_explode(v) as s(place, name, one) where v is not null),
        chosen as (select own, coalesce(
          case when try_variant_get(one, "$['@@affected'][0]", 'variant') is not null then try_variant_get(one, "$['@@affected']", 'variant') end, try_variant_get(one, "$['@@reachable']", 'variant')) as nodes from sets),
        each as (select own, node, schema_of_variant(node) as kind from chosen, lateral variant_explode(nodes) as n(place, name, node)),
        named as (select *, case when kind like 'OBJECT%' then coalesce(
          nullif(try_variant_get(node, '$.v_id', 'string'), ''), nullif(try_variant_get(node, '$.id', 'string'), ''), nullif(try_variant_get(node, '$.name', 'string'), '')) end as said from each)
        select own, coalesce(said, case when kind like 'OBJECT%' or kind like 'ARRAY%' then to_json(node) else try_variant_get(node, '$', 'string') end) as id from named
        union all select own, null from parsed where v is null""",
        raw=raw.select(own.alias("own"), "raw"),
    )
    return found.select("own.*", "id")


def normalised_results(spark: SparkSession, results: list[dict]) -> DataFrame:
    """Node ids of raw result sets that are at hand as Python objects."""
    return raw_result_ids(spark.createDataFrame([(0, json.dumps(results))], "answer int, raw string")).select("id")
