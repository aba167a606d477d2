import random

import pytest

from ripplet.operators import components, traverse


def walk(edges, start, depth, types, direction):
    links = {}
    for a, b, t in edges:
        if t in types:
            if direction in ("out", "both"):
                links.setdefault(a, set()).add(b)
            if direction in ("in", "both"):
                links.setdefault(b, set()).add(a)
    seen, frontier = {start: 0}, {start}
    for d in range(1, depth + 1):
        frontier = {y for x in frontier for y in links.get(x, ()) if y not in seen}
        seen |= dict.fromkeys(frontier, d)
    return seen


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(30), rng.randrange(30), rng.choice(["CALLS", "IMPORTS", "CONTAINS"])) for _ in range(60)] + [(1, 1, "CALLS"), (1, 2, "CALLS"), (2, 1, "CALLS"), (5, 6, "OTHER")]
    return edges, spark.createDataFrame(edges, "source int, target int, type string").cache()


@pytest.mark.parametrize("direction", traverse.DIRECTIONS)
@pytest.mark.parametrize("depth", [0, 1, 3, 6])
def test_against_plain_search(graph, direction, depth):
    edges, df = graph
    want = walk(edges, 1, depth, {"CALLS", "IMPORTS", "CONTAINS"}, direction)
    for method in (traverse.reach, traverse.reach_sql):
        assert {r.id: r.distance for r in traverse.hop_detection(df, 1, depth, direction, method).collect()} == want
    want = {k: d for k, d in walk(edges, 1, depth, {"CALLS"}, direction).items() if d}
    assert {r.id: r.distance for r in traverse.impact_analysis(df, 1, depth, direction).collect()} == want


def test_missing_start(graph):
    assert traverse.impact_analysis(graph[1], 999, 3).count() == 0
    assert [r.id for r in traverse.hop_detection(graph[1], 999, 3).collect()] == [999]


def test_dispatch_and_bounds(graph, spark):
    named = graph[1].selectExpr("concat('n', source) as source", "concat('n', target) as target", "type")
    assert traverse.affected(named, "n1", "function", 1).where("id = 'n1'").count() == 0
    assert traverse.affected(named, "n1", "file", 1).where("id = 'n1'").count() == 1
    for depth, api in ((-1, False), (0, True), (21, True)):
        with pytest.raises(ValueError):
            traverse.check_depth(depth, api)
    with pytest.raises(ValueError):
        traverse.steps(named, "sideways")


def test_result_normalisation(spark):
    raw = [{"@@affected": ["a", {"v_id": "b"}], "@@reachable": ["x"]}, {"@@reachable": [{"id": "c"}, {"name": "d"}, 5]}, {}]
    assert [r.id for r in traverse.normalised_results(spark, raw).collect()] == ["a", "b", "c", "d", "5"]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, 0) for k in range(500, 600)] + [(i, i + 1) for i in range(300, 340)] + [(700, 700), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            lo, hi = sorted((top(a), top(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: top(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_raw_results_as_a_table(spark):
    rows = [
        (1, '[{"@@affected": ["a", {"v_id": "b"}, {"v_id": "", "id": "c"}, {"name": "d", "x": 1}, 5, true, {"z": [1]}]}, {"@@reachable": ["e", "e"]}]'),
        (2, "{bad"), (3, None), (4, "[]"), (5, '[{"@@affected": [], "@@reachable": ["f"]}, {"@@affected": ["g"], "@@reachable": ["no"]}, {"other": []}, "text", null]'), (6, "[[]]"),
    ]
    raw = spark.createDataFrame([(k, t, "x") for k, t in rows], "key int, raw string, id2 string")
    got = sorted(((r.key, r.id) for r in traverse.raw_result_ids(raw).collect()), key=repr)
    assert got == sorted([(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, "5"), (1, "true"), (1, '{"z":[1]}'), (1, "e"), (1, "e"), (2, None), (3, None), (5, "f"), (5, "g")], key=repr)
