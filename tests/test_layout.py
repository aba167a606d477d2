"""Laid-out edges: same reach as plain joins, and no shuffle of edges."""

import random
import re

import pytest

from ripplet.operators import layout, traverse


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice(["CALLS", "IMPORTS", "CONTAINS", "OTHER"])) for _ in range(150)]
    rows += [("hub", f"n{k}", "CALLS") for k in range(60)] + [(f"n{k}", "sink", "CALLS") for k in range(60)] + [("n1", "n1", "CALLS"), (None, "n1", "CALLS"), ("n1", None, "CALLS")] * 2
    return spark.createDataFrame(rows, "source string, target string, type string")


@pytest.mark.parametrize("direction", traverse.DIRECTIONS)
@pytest.mark.parametrize("types", [None, ["CALLS"]])
def test_reach_equals_plain_joins(spark, graph, tmp_path, direction, types):
    laid = layout.EdgeLayout.write(graph, f"file://{tmp_path}/laid", 4, hub=7)
    assert {r.src for r in spark.read.parquet(f"{tmp_path}/laid/hubs_out").collect()} >= {"hub"}
    for start in ("hub", "n3", "missing"):
        ids = spark.createDataFrame([(start,)], "id string")
        want = sorted(map(tuple, traverse.reach(traverse.steps(graph, direction, types), ids, 3).collect()))
        assert sorted(map(tuple, laid.reach(ids, 3, direction, types).collect())) == want
    laid.close()
    again = layout.EdgeLayout(spark, f"file://{tmp_path}/laid")  # as another session would
    assert again.reach(spark.createDataFrame([("hub",)], "id string"), 1).count() > 60
    again.close()


@pytest.mark.parametrize("partitions", ["4", "16"])
def test_no_hop_shuffles_the_edges(spark, graph, tmp_path, partitions):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", partitions), strict=True):
            spark.conf.set(k, v)
        laid = layout.EdgeLayout.write(graph, f"file://{tmp_path}/laid", 4, hub=7)
        frontier = spark.createDataFrame([(f"n{k}",) for k in range(50)], "id string")
        for direction in ("out", "in"):
            plan = laid.hop(frontier, direction, ["CALLS"])._jdf.queryExecution().executedPlan().toString()
            assert "SelectedBucketsCount: 4 out of 4" in plan and "Broadcast" not in plan
            lines = plan.splitlines()
            indent = [len(re.match(r"[\s:+\-]*", line)[0]) for line in lines]
            at = next(k for k, line in enumerate(lines) if "SelectedBucketsCount: 4 out of 4" in line)
            above = []  # what stands between the scan of the edges and the join
            while "SortMergeJoin" not in lines[at]:
                above.append(lines[at])
                at = next(k for k in range(at - 1, -1, -1) if indent[k] < indent[at])
            assert len(above) > 1 and not any("Exchange" in line for line in above), plan
        laid.close()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_empty_edges(spark, tmp_path):
    laid = layout.EdgeLayout.write(spark.createDataFrame([], "source long, target long, type string"), f"file://{tmp_path}/laid", 3)
    assert [tuple(r) for r in laid.reach(spark.createDataFrame([(1,)], "id long"), 4).collect()] == [(1, 0)]
    with pytest.raises(ValueError):
        laid.hop(spark.createDataFrame([(1,)], "id long"), "up")
    laid.close()
