import pytest

from ripplet.functions.extract import register_functions
from ripplet.operators import report, resolve, search
from ripplet.plans.schemas import SOURCE_FILES

NAMES = ["login", "LoginForm", "log_out", "Äther", "äTHERnet", "a", "", None, "aaa", "aaaa", "x%y", "x_y", "🙂 face", "catalog", "logica"]


@pytest.mark.parametrize("term", ["log", "LOGIN", "a", "äth", "", "zz", "%", "_", "🙂", "aaaa", "catalog!", "og", "login"])
def test_search_equals_scan(spark, tmp_path_factory, term):
    vertices = spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")
    path = tmp_path_factory.getbasetemp() / "letters"
    if not path.exists():
        search.write_index(vertices, str(path))
    want = sorted(map(tuple, report.search(vertices, term).where("name <> ''").collect()))
    assert sorted(map(tuple, search.search(spark, str(path), term).collect())) == want


def test_search_reads_its_own_partitions(spark, tmp_path):
    search.write_index(spark.createDataFrame([(k, f"name{k}") for k in range(300)], "id long, name string"), str(tmp_path / "i"))
    found = search.search(spark, str(tmp_path / "i"), "e29")
    assert found.count() == 11
    assert len({f.rsplit("/part=", 1)[1].split("/")[0] for f in found.inputFiles()}) > 1  # all files of the table; the plan prunes them
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan


def test_table_functions(spark):
    register_functions(spark)
    text = b"import a.b as c, d\ndef f():\n    g(h())\nclass K:\n    async def m(self):\n        '''Doc'''\n"
    files = spark.createDataFrame([(3, "x.py", "/x.py", 1, len(text), text), (4, "y.py", "/y.py", 1, 6, b"def (:"), (5, "z.py", "/z.py", 1, 0, b"")], SOURCE_FILES)
    rows = spark.sql("select * from functions_of(table({files})) order by file_ord, func_ord", files=files).collect()
    assert [(r.file_ord, r.func_ord, r.name, r.start_line, r.end_line, r.calls, r.docstring) for r in rows] == [(3, 0, "f", 2, 3, ["g", "h"], None), (3, 1, "m", 5, 6, [], "Doc")]
    found = spark.sql("select file_ord, module, names from imports_of(table({files})) where line = 1 order by imp_ord", files=files).collect()
    assert [tuple(r) for r in found] == [(3, "a.b", ["c"]), (3, "d", ["d"])]


@pytest.mark.parametrize(
    ("question", "raw"),
    [
        ("who calls auth/login.py?", "auth/login.py"), ("is pkg.mod.Class.method safe", "pkg.mod.Class.method"), ("pkg.mod.", "pkg.mod"), ("pkg.mode", "UNKNOWN"), ("relogin", "UNKNOWN"), ("login, then auth", "login"), ("auth and mode1 or mode2", "mode1"),
        ("auth/login.pyx", "login"), ("C:\\src\\a.py", "C:\\src\\a.py"), ("", "UNKNOWN"), ("naïve_fn(x)", "naïve_fn"), ("naïve", "UNKNOWN"), ("the two words here", "two words"), ("auth/login.py auth/login.py", "auth/login.py"),
    ],
)
def test_names_of_several_words(spark, question, raw):
    names = ["auth", "login", "auth/login.py", "pkg", "pkg.mod", "pkg.mod.Class.method", "mode1", "mode2", "C:\\src\\a.py", "naïve_fn", "two words", "", None]
    vertices = spark.createDataFrame([(n,) for n in names], "name string")
    if question == "pkg.mode":
        raw = "pkg"
    asked = spark.createDataFrame([(question,), (question,)], "question string")
    assert [tuple(r) for r in resolve.mentioned_targets(vertices, asked).collect()] == [(question, raw)]
