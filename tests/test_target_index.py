import random

import pytest

from ripplet.operators import resolve, target_index
from ripplet.plans.schemas import VERTICES


@pytest.fixture(scope="module")
def vertices(spark):
    rng = random.Random(2)
    rows = [("file::x/oauth.py", "File", "oauth.py", "x/oauth.py"), ("file::x/auth.py", "File", "auth.py", "x/auth.py"), ("func::a::g", "Function", "f", "a"), ("f", "Function", "h", "a"), ("func::b::g", "Function", "g", "b"), ("func::c::g", "Function", "g", "c"), ("file::", "File", "", "")]
    for k in range(200):
        path = "/".join(rng.choice(["a", "lib", "é", "src"]) for _ in range(rng.randrange(4))) + f"/{rng.choice(['__init__', 'm', 'auth', 'x' + str(k)])}.py"
        rows.append((f"file::{path}", "File", path.rsplit("/", 1)[-1], path))
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], VERTICES + ", row_ord bigint")


def test_index_equals_matching(spark, vertices, tmp_path):
    target_index.write_index(vertices, str(tmp_path / "i"))
    asked = {("auth.py", "file"), ("uth.py", "file"), ("py", "file"), (".py", "file"), ("y", "file"), ("f", "function"), ("g", "function"), ("h", "function"), ("", "file"), ("x", "unknown"), ("none.py", "file"), ("lib/__init__.py", "file"), ("é/m.py", "file")}
    for r in vertices.collect():
        asked |= {(r.filepath, "file"), (r.id, "file"), (r.filepath[-5:], "file"), (r.filepath[-9:], "file"), (r.name, "function")}
    targets = spark.createDataFrame(sorted(asked), "target string, type string")
    want = sorted(map(tuple, resolve.match_targets(vertices, targets).collect()))
    assert len(want) > 100
    assert sorted(map(tuple, target_index.match_targets(spark, str(tmp_path / "i"), targets).collect())) == want
    known = {(t, k): i for t, k, i in want}
    for target, kind in (("auth.py", "file"), (" g ", "function"), ("none.py", "file"), (".py", "file")):
        assert target_index.resolve_target(spark, str(tmp_path / "i"), target, kind) == known.get((target.strip(), kind))


def test_a_lookup_reads_one_partition(spark, vertices, tmp_path):
    target_index.write_index(vertices, str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i"))
    assert rows.groupBy("target", "type").count().where("count > 1").isEmpty()  # unique keys: nothing is hot
    part = rows.where("target = '.py'").first().part
    assert rows.where("target = '.py'").select("part").distinct().count() == 1 and 0 <= part < target_index.PARTS
