"""What a step shuffles, holds or asks for must not grow faster than its input: read from plans and from counted calls."""

import re

import pytest

from ripplet.operators import build, load, resolve, traverse
from ripplet.plans import derived
from ripplet.plans.schemas import EDGES
from ripplet.streaming import status


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.fixture
def program(spark):
    functions = spark.range(2_000).selectExpr("cast(id % 600 as int) as file_ord", "cast(id as int) as func_ord", "concat(id % 600, '.py') as path_id", "concat('f', id % 3) as name")
    calls = spark.range(5_000).selectExpr("cast(id % 600 as int) as file_ord", "cast(id % 2000 as int) as func_ord", "concat('f', id % 5) as callee")
    return calls, functions


def test_typed_edges_need_no_join(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "OTHER"), ("a", "b", None)], EDGES)
    typed = load.typed_edges(edges)
    assert "Join" not in plan(typed)
    assert [tuple(r) for r in typed.collect()] == [("CALLS", "a", "b", "CodeFunction", "CodeFunction")]


def test_call_edges_shuffle_functions_twice(program):
    """Once by file and name, and once by place; the first definition anywhere comes from the first ones of the files."""
    for mode in ("reference", "complete"):
        edges = build.call_edges(*program, mode)
        assert plan(edges).count("REPARTITION_BY_COL") == 1 and exchanges(edges) <= 7


def test_dropped_calls_are_dropped_before_callers_are_joined(program):
    text = program[0].sparkSession._jvm.PythonSQLUtils.explainString(build.call_edges(*program)._jdf.queryExecution(), "simple")
    join, found = text.index("Join [file_ord"), text.index("CASE WHEN isnotnull(local_ord")
    assert join < found  # plans are written from the top, so what is below comes first


def test_links_are_not_made_distinct_for_hops(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS")] * 3 + [("b", "c", "CALLS")], EDGES)
    for way in traverse.DIRECTIONS:
        assert "Aggregate" not in plan(traverse._ways(edges, way, ["CALLS"], traverse.reach))
    assert sorted(tuple(r) for r in traverse.hop_detection(edges, "a", 2).collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert "Aggregate" in plan(traverse._ways(edges, "out", ["CALLS"], traverse.reach_sql))


def test_names_are_listed_by_stretches_of_files(program):
    index = build.name_index(program[1])
    assert plan(index).count("collect_list") > 2  # more than one level of lists
    for r in index.collect():
        own = sorted({(k % 600, k) for k in range(2_000) if f"f{k % 3}" == r.name})
        assert r.func_ids == list(dict.fromkeys(f"func::{file}.py::{r.name}" for file, _ in own))


def test_words_of_questions_carry_no_digest(spark):
    vertices = spark.createDataFrame([("/etc/x",), (".hidden",), ("login",), ("é",)], "name string")
    asked = spark.createDataFrame([("what of /etc/x?",), ("is .hidden used",), ("login, login",), ("é",), ("",), (None,), ("x/etc/y",)], "question string")
    found = resolve.mentioned_targets(vertices, asked)
    assert "sha2" not in plan(found)
    got = {r.question: r.raw for r in found.collect()}
    assert got == {"what of /etc/x?": "/etc/x", "is .hidden used": ".hidden", "login, login": "login", "é": "é", "": "UNKNOWN", None: "UNKNOWN", "x/etc/y": "UNKNOWN"}


class _State:
    def __init__(self):
        self.value, self.asked = None, 0

    def get(self):
        self.asked += 1
        return self.value

    def exists(self):
        self.asked += 1
        return self.value is not None

    def update(self, value):
        self.asked += 1
        self.value = value


def test_a_key_costs_two_round_trips_to_its_state():
    from pyspark.sql import Row

    changes = status._Changes()
    changes.last = _State()
    line = Row("key", "seq", "status", "completed", "total", "error")
    for seq in (1, 2):
        found = [tuple(r) for r in changes.handleInputRows(("k",), iter([line("k", seq, "on", None, None, None)]), None)]
        assert len(found) == (seq == 1) and changes.last.asked == 2 * seq


def test_source_text_of_suppliers(spark, tmp_path):
    """As put together in plain Python, also with lines that are there twice, lack a part or an order, and suppliers without lines; lines go to their supplier in one shuffle, not to each part first."""
    lines = [(1, 5, 1, 1), (1, 7, 1, 2), (1, 7, 1, 2), (1, 5, 2, 3), (2, 7, 1, 3), (2, 9, 1, 1), (2, 7, 2, 1), (2, 9, 2, 2), (2, 5, 1, 3), (1, None, 1, 1), (1, 8, None, 1), (1, 8, None, 2), (2, None, 2, 4), (2, 6, 2, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 3), (2, 4), (3, 4)], "s_suppkey long, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    expected = {}
    for supplier, nation in ((1, 3), (2, 4), (3, 4)):
        calls = {part: [] for _, part, s, _ in sorted(lines, key=lambda x: x[1] or 0) if s == supplier and part is not None}
        for order, part, s, number in lines:
            if s == supplier and part is not None and order is not None:
                calls[part] += [(order, number, p) for o, p, _, n in lines if o == order and n == number + 1 and p is not None]
        code = [f"def part_{part}():\n" + ("\n".join(f"    part_{p}()" for _, _, p in sorted(c)) or "    pass") for part, c in calls.items()]
        expected[supplier] = f"import nation_{nation}\nfrom ledger import s_{supplier}, total\n" + "\n".join(code) + "\n"
    found = derived.source_files(spark, str(tmp_path))
    assert {r.file_ord: bytes(r.content).decode() for r in found.collect()} == expected
    assert re.search(r"hashpartitioning\(l_suppkey#\d+L?, \d", plan(found)) and not re.search(r"hashpartitioning\(l_suppkey#\d+L?, l_partkey", plan(found))
