import pytest
from pyspark.sql import functions as F

from ripplet.functions import extract
from ripplet.operators import build, load
from ripplet.plans.schemas import SOURCE_FILES


@pytest.fixture
def program(spark):
    """a.py: late() early(); b.py: early(), twice m(), self-call; pkg/__init__.py."""
    files = spark.createDataFrame([(0, "./a.py", "a.py"), (1, "./b.py", "b.py"), (2, "./pkg/__init__.py", "pkg/__init__.py")], "file_ord int, filepath string, path_id string")
    functions = spark.createDataFrame([(0, 0, "a.py", "f"), (0, 1, "a.py", "g"), (1, 0, "b.py", "f"), (1, 1, "b.py", "m"), (1, 2, "b.py", "m")], "file_ord int, func_ord int, path_id string, name string")
    calls = spark.createDataFrame([(0, 0, "g"), (0, 0, "f"), (0, 1, "m"), (1, 0, "g"), (1, 1, "f"), (1, 2, "m"), (1, 2, "m"), (1, 2, "nowhere")], "file_ord int, func_ord int, callee string")
    imports = spark.createDataFrame([(0, "b"), (0, "pkg"), (1, "a"), (1, "b"), (1, "missing"), (2, "")], "file_ord int, module string")
    return files, functions, calls, imports


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_call_edges_keep_only_what_was_seen(program):
    files, functions, calls, _ = program
    got = rows(build.call_edges(calls, functions).select("source", "target"))
    assert got == [
        ("func::a.py::f", "func::a.py::f"),  # itself; g comes later and is dropped
        ("func::b.py::f", "func::a.py::g"),
        ("func::b.py::m", "func::b.py::f"),  # its own file before the first anywhere
        ("func::b.py::m", "func::b.py::m"),
        ("func::b.py::m", "func::b.py::m"),
    ]


def test_complete_mode_keeps_later_definitions(program):
    files, functions, calls, _ = program
    got = rows(build.call_edges(calls, functions, "complete").select("source", "target"))
    assert ("func::a.py::f", "func::a.py::g") in got and ("func::a.py::g", "func::b.py::m") in got and len(got) == 7
    with pytest.raises(ValueError):
        build.call_edges(calls, functions, "other")


def test_vertices_collapse_and_contains_does_not(program):
    files, functions, _, _ = program
    assert rows(build.vertices(files, functions).select("id")) == [(x,) for x in sorted(["file::a.py", "file::b.py", "file::pkg/__init__.py", "func::a.py::f", "func::a.py::g", "func::b.py::f", "func::b.py::m"])]
    assert build.contains_edges(functions).count() == 5


def test_imports(program):
    files, _, _, imports = program
    assert rows(build.import_edges(imports, files).select("source", "target")) == [("file::a.py", "file::b.py"), ("file::a.py", "file::pkg/__init__.py"), ("file::b.py", "file::a.py"), ("file::b.py", "file::b.py")]


def test_module_suffixes(spark):
    files = spark.createDataFrame([(0, "/r/x/u.py"), (1, "/r/y/u.py"), (2, "/r/y/__init__.py")], "file_ord int, path_id string")
    got = dict(rows(build.module_index(files)))
    assert got["u"] == "file::/r/x/u.py" and got["y.u"] == "file::/r/y/u.py" and got[".r.y"] == got["y"] == "file::/r/y/__init__.py" and "" not in got


def test_load_appends_and_replaces(spark, program, tmp_path):
    files, functions, calls, imports = program
    v, e = build.vertices(files, functions), build.edges(files, functions, calls, imports).unionByName(spark.createDataFrame([("a", "b", "OTHER")], "source string, target string, type string"))
    path = str(tmp_path / "g")
    assert load.load_graph(spark, v, e, path) == (7, 14)
    more = spark.createDataFrame([("file::a.py", "File", "renamed", "x"), ("odd", "Other", "o", "o")], "id string, type string, name string, filepath string")
    load.load_graph(spark, more, e.limit(0), path)
    vertices, edges = load.graph(spark, path)
    named = {r.id: (r.type, r.name) for r in vertices.collect()}
    assert named["file::a.py"] == ("CodeFile", "renamed") and named["odd"] == ("Other", "o") and len(named) == 8
    assert edges.count() == 12 and set(edges.columns) == {"source", "target", "type", "source_type", "target_type"}
    load.load_graph(spark, more, e.limit(0), path, mode="replace")
    assert load.graph(spark, path)[0].count() == 2
    with pytest.raises(FileNotFoundError):
        load.graph(spark, str(tmp_path / "none"))


def test_edges_survive_hot_names(spark):
    """A name with most calls is resolved like any other."""
    functions = spark.createDataFrame([(i, 0, f"{i}.py", "get") for i in range(50)], "file_ord int, func_ord int, path_id string, name string")
    calls = spark.range(2000).selectExpr("cast(id % 50 as int) as file_ord", "0 as func_ord", "'get' as callee")
    assert build.call_edges(calls, functions).count() == 2000


PROGRAM = [
    ("./a.py", "a.py", "import b, b\nimport pkg\nfrom . import x\ndef f():\n    late()\n    g()\n    g()\n    far()\n    f()\ndef g(): f()\ndef late(): pass\n"),
    ("./b.py", "b.py", "import a\nfrom a import f\nimport missing\ndef far(): twice()\ndef twice(): nowhere()\nclass K:\n    def f(self): self.g()\n    def twice(self): far()\n"),
    ("./broken.py", "broken.py", "def (:\n"),
    ("./one/u.py", "x/y/u.py", "from u import *\ndef h(): g()\ndef k():\n    h()\n    only()\n"),
    ("./two/u.py", "x/y/u.py", "def only(): h()\ndef k():\n    only()\n    def inner(): later()\n    def k(): inner()\n"),
    ("./empty.py", "empty.py", ""),
    ("./imports.py", "imports.py", "import a as c\nif True:\n    from y.u import k\n"),
    ("./pkg/__init__.py", "pkg/__init__.py", "def later():\n    f()\n    h()\n    k()\n"),
]


def program_files(spark, lines):
    return spark.createDataFrame([(at, name, path, 0, len(text), text.encode()) for at, (name, path, text) in enumerate(lines)], SOURCE_FILES)


@pytest.mark.parametrize(("lines", "repeats"), [(PROGRAM, 1), (PROGRAM, 2), (PROGRAM[:3] + PROGRAM[5:], 1), (PROGRAM[5:6], 1), ([], 1)], ids=["shared path", "rows twice", "own paths", "empty file", "no files"])
@pytest.mark.parametrize("mode", ["reference", "complete"])
def test_a_graph_of_links_is_the_graph_of_parsed_files(spark, lines, repeats, mode):
    """Also where files share a path, names are defined again, and rows of the table are there twice."""
    files = program_files(spark, lines * repeats).withColumn("file_ord", F.col("file_ord") % max(1, len(lines)))
    parsed = extract.parsed_files(files).cache()
    known, functions = parsed.select("file_ord", "filepath", "path_id"), extract.functions_of(parsed)
    vertices, edges = build.graph_of_links(extract.links_of(files, mode).cache(), mode)
    assert rows(edges) == rows(build.edges(known, functions, extract.calls_of(parsed), extract.imports_of(parsed), mode).distinct())
    assert rows(vertices.select("id", "type", "name", "filepath")) == rows(build.vertices(known, functions).distinct())


def test_files_of_one_part_are_dealt_to_many_tasks(spark):
    files = program_files(spark, [(f"{k}.py", f"{k}.py", "def f(): pass\n") for k in range(64)]).coalesce(1)
    sizes = extract.links_of(files).where("kind = 'file'").rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 64 and len(sizes) == 4 and max(sizes) < 32
    with pytest.raises(ValueError):
        extract.links_of(files, "other")
