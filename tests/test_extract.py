import gc
import os

import pyarrow as pa
import pytest
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ripplet.functions import extract
from ripplet.functions.extract import parse
from ripplet.plans.schemas import PARSED, SOURCE_FILES
from ripplet.sources.pytree import source_files, walk


def names(content, path="m.py"):
    return [f["name"] for f in parse(content, path)["functions"]]


def test_functions_come_level_by_level():
    code = b"class A:\n    def m(self): pass\ndef f():\n    def g(): pass\nasync def h(): pass\n"
    assert names(code) == ["f", "h", "m", "g"]


def test_calls_in_visiting_order():
    code = b"@deco(1)\ndef f(a=first()) -> last():\n    a.b().c()\n    x[0]()\n    f()()\n    def g(): inner()\n"
    got = parse(code, "m.py")["functions"][0]["calls"]
    assert got == ["first", "c", "b", "f", "inner", "deco", "last"]


def test_imports():
    code = b"import a.b as c, d\nfrom . import x\nfrom .m import y as z\nfrom q import *\n"
    got = [(i["module"], i["names"], i["line"]) for i in parse(code, "m.py")["imports"]]
    assert got == [("a.b", ["c"], 1), ("d", ["d"], 1), ("", ["x"], 2), ("m", ["y"], 3), ("q", ["*"], 4)]


@pytest.mark.parametrize(("content", "error"), [(b"", None), (b"x = '\xff\xfe'\n", None), (b"\xef\xbb\xbfx = 1\n", "SyntaxError"), (b"def f(:\n", "SyntaxError")])
def test_odd_files(content, error):
    found = parse(content, "m.py")
    assert found["error"] == error and found["functions"] == found["imports"] == []


def test_lines_and_docstrings():
    f = parse(b'def f():\n    """Doc."""\n    return 1\n', "m.py")["functions"][0]
    assert (f["start_line"], f["end_line"], f["docstring"]) == (1, 3, "Doc.")


@pytest.fixture
def tree(tmp_path):
    for path in ["z.py", "a.py", "__init__.py", "_private.py", "b/z.py", "b/a/q.py", "venv/x.py", ".hidden/x.py", "b/node_modules/x.py", "b/X.PY", "b/note.txt"]:
        full = tmp_path / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text("def f(): pass\n")
    os.symlink(tmp_path / "b", tmp_path / "link")
    return tmp_path


def test_scan_order(tree):
    assert [os.path.relpath(p, tree) for p in walk(str(tree))] == ["__init__.py", "_private.py", "a.py", "z.py", "b/z.py", "b/a/q.py"]


def test_data_source(spark, tree):
    rows = source_files(spark, str(tree)).orderBy("file_ord").collect()
    assert [os.path.relpath(r.filepath, tree) for r in rows] == ["__init__.py", "_private.py", "a.py", "z.py", "b/z.py", "b/a/q.py"]
    assert all(r.size == len(r.content) == 14 for r in rows)


def test_a_batch_of_many_files_is_passed_on_in_parts(spark):
    """However many files a batch brings, functions of about SLICE bytes of source are held at a time."""
    schema = to_arrow_schema(T.StructType.fromDDL(PARSED))
    code = b"def f():\n    g()\n" * 2_000
    batch = pa.RecordBatch.from_pylist([{"file_ord": k, "filepath": f"{k}.py", "path_id": f"{k}.py", "mtime_ns": 0, "size": len(code), "content": code} for k in range(100)])
    parts = [b.num_rows for b in extract._parsed_batches(iter([batch]), schema)]
    assert sum(parts) == 100 and max(parts) <= extract.SLICE // len(code) + 1


def test_table_functions_take_few_files_at_a_time(spark):
    """Arrow batches bring up to 10,000 files at once."""
    extract.register_functions(spark)
    files = spark.createDataFrame([(0, "a.py", "a.py", 0, 1, b"def f():\n    g()\nimport x\n")], SOURCE_FILES)
    found = spark.sql("select name, calls from functions_of(table({files}))", files=files)
    assert [tuple(r) for r in found.collect()] == [("f", ["g"])]
    assert "ArrowEvalPythonUDTF" not in found._jdf.queryExecution().toString()


def test_nested_definitions_are_visited_once():
    code = b"".join(b" " * k + b"def f%d(a=c%d()):\n" % (k, k) for k in range(60)) + b" " * 60 + b"last()\n"
    found = parse(code, "m.py")["functions"]
    assert [f["name"] for f in found] == [f"f{k}" for k in range(60)]
    assert [f["calls"] for f in found] == [[f"c{i}" for i in range(k, 60)] + ["last"] for k in range(60)]


def test_parsing_is_not_interrupted_by_collections(monkeypatch):
    """Collections look through the growing tree again and again; they are on again afterwards, also after an error."""
    seen = []
    real = extract._extracted
    monkeypatch.setattr(extract, "_extracted", lambda *a: seen.append(gc.isenabled()) or real(*a))
    for code in (b"def f(): pass\n", b"def f(:\n"):
        extract.parse(code, "m.py")
        assert gc.isenabled()
    assert seen == [False]
