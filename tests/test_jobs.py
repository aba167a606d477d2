"""The jobs: reruns, growing input, replays, command line."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import common, question_log, risk_report
from ripplet.plans.schemas import SOURCE_FILES

ROOT = Path(__file__).resolve().parent.parent
RISKS = [("func::a.py::login", "Function", "login", "a.py", 7, "High"), ("func::b.py::logout", "Function", "logout", "b.py", 1, "Low"), ("file::auth/a.py", "File", "a.py", "auth/a.py", 0, "None")]


def sources(spark, path, files):
    rows = [(k, name, name, 0, len(text), text.encode()) for k, (name, text) in enumerate(files.items())]
    spark.createDataFrame(rows, SOURCE_FILES).write.mode("overwrite").parquet(path)


def tables(spark, out):
    return {name: sorted(map(repr, spark.read.parquet(f"{out}/{name}").collect())) for name in ("vertices", "edges")}


def test_risk_report(spark, tmp_path):
    files = {
        "a.py": "import b\ndef f():\n    g()\n    h()\ndef g():\n    f()\n    g()\n",
        "b.py": "def h():\n    pass\ndef k():\n    h()\n    missing()\n",
        "c.py": "import b\nfrom b import h\ndef m():\n    h()\n    h()\n",
        "broken.py": "def (:\n",
    }
    sources(spark, f"{tmp_path}/in", files)
    numbers = risk_report.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert numbers == {"files_read": 4, "vertices_written": 9, "edges_written": 5 + 6 + 2, "errors_written": 1}
    found = {r.id: (r.type, r.n_dependents, r.risk) for r in spark.read.parquet(f"{tmp_path}/out/vertices").collect()}
    assert found["func::b.py::h"] == ("Function", 3, "Medium")
    assert found["func::a.py::g"] == ("Function", 1, "Low")  # its own call does not count
    assert found["file::b.py"] == ("File", 2, "Low")
    assert found["func::c.py::m"] == ("Function", 0, "None")
    assert [r.filepath for r in spark.read.parquet(f"{tmp_path}/out/errors").collect()] == ["broken.py"]
    assert {p.name for p in (tmp_path / "out" / "vertices").iterdir() if p.is_dir()} == {"type=File", "type=Function"}
    before = tables(spark, f"{tmp_path}/out")
    assert risk_report.run(spark, f"{tmp_path}/in", f"{tmp_path}/out") == numbers
    assert tables(spark, f"{tmp_path}/out") == before


def test_risk_report_leaves_no_stale_partitions(spark, tmp_path):
    sources(spark, f"{tmp_path}/in", {"a.py": "def f():\n    g()\ndef g():\n    pass\n"})
    risk_report.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    sources(spark, f"{tmp_path}/in", {"a.py": "x = 1\n"})
    numbers = risk_report.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert numbers == {"files_read": 1, "vertices_written": 1, "edges_written": 0, "errors_written": 0}
    assert [r.id for r in spark.read.schema(question_log.RISKS).parquet(f"{tmp_path}/out/vertices").collect()] == ["file::a.py"]


def shuffled_rows(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_calls_within_a_file_are_not_shuffled(spark, tmp_path):
    """A function goes to the count of its dependents and to the first definitions of its name; its calls, callers and edges stay in the task that has its file."""
    files, functions = 40, 200
    sources(spark, f"{tmp_path}/in", {f"m{k}.py": "".join(f"def f{k}_{i}():\n    f{k}_{(i + 1) % functions}()\n" for i in range(functions)) for k in range(files)})
    before = shuffled_rows(spark)
    numbers = risk_report.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert numbers == {"files_read": files, "vertices_written": files * (functions + 1), "edges_written": 2 * files * functions, "errors_written": 0}
    assert shuffled_rows(spark) - before < 3.5 * files * functions
    assert {r.n_dependents for r in spark.read.parquet(f"{tmp_path}/out/vertices").where("type = 'Function'").collect()} == {1}


@pytest.fixture
def paths(spark, tmp_path):
    spark.createDataFrame(RISKS, question_log.RISKS).write.partitionBy("type", "risk").parquet(f"{tmp_path}/risks")
    (tmp_path / "turns").mkdir()
    return {"turns": f"{tmp_path}/turns", "vertices": f"{tmp_path}/risks", "out": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/checkpoint"}


def deliver(spark, paths, *turns):
    spark.createDataFrame(list(turns), question_log.TURNS).coalesce(1).write.mode("append").parquet(paths["turns"])


def logged(spark, paths):
    return sorted((r.conv_id, r.turn, r.target, r.target_type, r.id, r.n_dependents, r.risk) for r in question_log.history(spark, paths["out"]).collect())


FIRST = [
    (1, 0, "login", "function", "func::a.py::login", 7, "High"),
    (1, 2, "UNKNOWN", "unknown", None, None, None),
    (2, 0, "UNKNOWN", "unknown", None, None, None),
]


def test_growing_input(spark, paths):
    deliver(spark, paths, (1, 0, "user", "What if login changes?"), (1, 1, "assistant", "logout"), (1, 2, "user", "relogin or login_x?"), (2, 0, "user", None))
    assert question_log.run(spark, **paths) == [{"batch": 0, "turns_read": 4, "entries_written": 3}]
    assert logged(spark, paths) == FIRST
    files = sorted(p for p in Path(paths["out"]).rglob("*.parquet"))
    assert question_log.run(spark, **paths) == []  # nothing new
    deliver(spark, paths, (2, 0, "user", "delivered again, logout"), (3, 0, "user", "is a.py or logout riskier? logout!"), (3, 0, "user", "is a.py or logout riskier? logout!"))
    assert question_log.run(spark, **paths) == [{"batch": 1, "turns_read": 3, "entries_written": 2}]
    assert logged(spark, paths) == [*FIRST, (3, 0, "logout", "function", "func::b.py::logout", 1, "Low")]
    assert set(files) <= set(Path(paths["out"]).rglob("*.parquet"))  # what was written before stays as it was


def test_file_targets(spark, paths):
    deliver(spark, paths, (1, 0, "user", "who uses a.py?"))
    question_log.run(spark, **paths)
    assert logged(spark, paths) == [(1, 0, "a.py", "file", "file::auth/a.py", 0, "None")]


def test_a_replayed_batch_changes_nothing(spark, paths):
    deliver(spark, paths, (1, 0, "user", "login"))
    question_log.run(spark, **paths)
    deliver(spark, paths, (1, 1, "user", "logout"))
    question_log.run(spark, **paths)
    before = logged(spark, paths)
    for name in ("1", ".1.crc"):  # as if the last batch had failed after its rows were written
        (Path(paths["checkpoint"]) / "commits" / name).unlink()
    assert question_log.run(spark, **paths) == [{"batch": 1, "turns_read": 1, "entries_written": 1}]
    assert logged(spark, paths) == before
    assert spark.read.schema(question_log.ENTRIES).parquet(paths["out"]).count() == 2


def test_many_files_come_in_batches(spark, paths):
    for k in range(5):
        deliver(spark, paths, (k, 0, "user", "login"))
    assert [b["turns_read"] for b in question_log.run(spark, **paths, files_per_batch=2)] == [2, 2, 1]
    assert len(logged(spark, paths)) == 5


def test_empty_folder(spark, paths):
    assert question_log.run(spark, **paths) == []


def test_command_line(spark, tmp_path):
    sources(spark, f"{tmp_path}/in", {"a.py": "def f():\n    pass\n"})
    config = json.loads((ROOT / "jobs" / "risk_report.json").read_text())
    config["spark"] |= {"spark.master": "local[2]", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{tmp_path}/shared"}
    (tmp_path / "config.json").write_text(json.dumps(config))
    command = [sys.executable, str(ROOT / "jobs" / "risk_report.py"), "--config", f"{tmp_path}/config.json", "--sources", f"{tmp_path}/in", "--out", f"{tmp_path}/out"]
    done = subprocess.run(command, capture_output=True, text=True, timeout=300, env=os.environ | {"PYTHONPATH": str(ROOT)}, cwd=tmp_path, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "'files_read': 1" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out/vertices").count() == 2


def test_missing_parameters():
    with pytest.raises(SystemExit):
        common.main(lambda *_, **__: None, "x", "doc", ("sources",), [])
