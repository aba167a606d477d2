"""Discovery, cache and watched trees: growing, changing and shrinking source."""

import os
import random
from pathlib import Path

import pytest

from ripplet import api
from ripplet.operators import cache, load
from ripplet.sources import discover
from ripplet.sources.pytree import walk
from ripplet.streaming import status, watch


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "app"
    (root / "lib").mkdir(parents=True)
    (root / "base.py").write_text("def connect():\n    pass\ndef save(x):\n    connect()\n")
    (root / "lib" / "__init__.py").write_text("")
    (root / "lib" / "auth.py").write_text("from base import save\ndef login(user):\n    save(user)\n")
    (root / "broken.py").write_text("def f(:\n")
    return root


def test_discovery_is_the_walk(spark, tmp_path):
    rng = random.Random(1)
    folders = [tmp_path / "t"]
    folders[0].mkdir()
    for _ in range(700):
        p = rng.choice(folders[-100:]) / (rng.choice(["a", "b", "B", "é", "z_1", "__x", "a.b", "lib"]) + str(rng.randrange(30)))
        if not p.is_dir():
            p.mkdir()
            folders.append(p)
    for name in (".hidden", "venv", "node_modules", "__pycache__"):
        (folders[0] / name).mkdir()
        (folders[0] / name / "q.py").touch()
    os.symlink(folders[3], folders[0] / "link")
    for k in range(5_000):
        (rng.choice(folders) / f"{rng.choice(['a', 'É', '_b'])}{k}{rng.choice(['.py', '.py', '.txt'])}").touch()
    found = discover.stat_files(spark, str(folders[0]))
    rows = found.orderBy("file_ord").collect()
    assert [r.filepath for r in rows] == list(walk(str(folders[0])))
    assert [r.file_ord for r in rows] == list(range(len(rows)))
    assert found.columns == [c.split()[0] for c in discover.STAT.split(", ")]


def test_discovery_of_nothing(spark, tmp_path):
    assert discover.stat_files(spark, str(tmp_path)).count() == 0


def graph_of(spark, path):
    return [sorted(map(repr, t.collect())) for t in load.graph(spark, path)]


def full(spark, tree, path):
    vertices, edges = api.build_graph(api.parse(spark, str(tree)))
    load.load_graph(spark, vertices, edges, path, "replace")
    return graph_of(spark, path)


def test_cache_parses_once_and_touches_changed_parts_only(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "PARTS", 256)  # so that the files lie in parts of their own
    store = cache.ParseCache(spark, str(tmp_path / "cache"))
    files = discover.stat_files(spark, str(tree))
    rows, counts = cache.update(files, store)
    assert counts == {"parsed": 4, "gone": 0} and rows.count() == 4
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    assert len(before) == 4
    (tree / "base.py").write_text("def other():\n    pass\n")
    (tree / "broken.py").unlink()
    rows, counts = cache.update(discover.stat_files(spark, str(tree)), store)
    assert counts == {"parsed": 1, "gone": 1}
    assert sorted(len(r.functions) for r in rows.collect()) == [0, 1, 1]
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "cache").rglob("*.parquet")}
    assert len(before.keys() & after.keys()) == 2 and all(before[p] == after[p] for p in before.keys() & after.keys())
    assert store.load().count() == 4 and store.live().count() == 3
    assert cache.update(discover.stat_files(spark, str(tree)), store)[1] == {"parsed": 0, "gone": 0}
    (tree / "broken.py").write_text("def f(:\n")  # it comes back
    assert cache.update(discover.stat_files(spark, str(tree)), store)[1] == {"parsed": 1, "gone": 0}
    assert store.live().count() == 4


def test_watched_tree(spark, tree, tmp_path):
    seen = []
    paths = [str(tmp_path / name) for name in ("cache", "graph", "checkpoint")]

    def run():
        watch.watch(spark, str(tree), *paths, seen=seen).awaitTermination()
        return graph_of(spark, paths[1])

    assert run() == full(spark, tree, str(tmp_path / "whole"))
    assert seen == [{"parsed": 4, "gone": 0}]
    run()
    assert len(seen) == 1  # nothing changed, so there was no batch
    (tree / "base.py").write_text("def connect():\n    save(1)\ndef save(x):\n    pass\n")
    (tree / "lib" / "auth.py").unlink()
    (tree / "new.py").write_text("import base\ndef fresh():\n    connect()\n")
    assert run() == full(spark, tree, str(tmp_path / "whole"))
    assert seen[1:] == [{"parsed": 2, "gone": 1}]
    commits = Path(paths[2]) / "commits"
    for name in ("1", ".1.crc"):  # the batch was applied, but not recorded
        (commits / name).unlink()
    assert run() == full(spark, tree, str(tmp_path / "whole"))
    assert seen[2:] == [{"parsed": 0, "gone": 0}]


def lines(path, *texts):
    Path(path).parent.mkdir(exist_ok=True)
    Path(path).write_text("\n".join(texts) + "\n")


def test_status_changes_across_batches(spark, tmp_path):
    line = '{{"key": "{}", "seq": {}, "status": "{}"{}}}'.format
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        return status.stream_reports(spark, source, out, checkpoint)

    lines(f"{source}/a", line("m", 2, "pull", ""), line("m", 1, "pull", ""), line("m", 3, "x", ', "completed": 1, "total": 10'), "{bad", "", "[1]", '{"status": "no key"}', line("n", 1, "a", ""))
    assert run() == {"lines": 7, "bad": 3}
    lines(f"{source}/b", line("m", 4, "pull", ""), line("m", 5, "done", ', "error": "boom"'), line("m", 6, "after", ""), line("n", 2, "a", ""), line("n", 1, "again", ""))
    assert run() == {"lines": 5, "bad": 0}
    lines(f"{source}/c", line("m", 7, "pull", ""), line("n", 3, "b", ""))
    assert run() == {"lines": 2, "bad": 0}
    assert run() == {"lines": 0, "bad": 0}
    rows = sorted((r.key, r.seq, r.kind, r.status, r.completed, r.total, r.error) for r in spark.read.parquet(out).collect())
    assert rows == [
        ("m", 1, "status", "pull", None, None, None), ("m", 3, "progress", "x", 1, 10, None), ("m", 5, "error", "done", None, None, "boom"),
        ("m", 5, "status", "done", None, None, None), ("n", 1, "status", "a", None, None, None), ("n", 3, "status", "b", None, None, None),
    ]
