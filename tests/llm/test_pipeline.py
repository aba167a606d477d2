"""The pipeline against its stages in plain Python."""

import random
import re

import corpus_pipeline
import pytest
from plain_components import brute_components

from ripplet.llm import exact_dedup, packing, pii, quality, simhash


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, labels)
    want = {i for i, r in rows.items() if model.scores([r.text])[0] >= quality.THRESHOLD}
    now = corpus_pipeline.quality_stage(spark, docs, small)
    assert {r.doc_id for r in now.collect()} == want and now.columns == docs.columns
    first = {}
    for i in sorted(want):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i].text), i)
    now = corpus_pipeline.exact_stage(spark, now, small)
    assert {r.doc_id for r in now.collect()} == set(first.values()) and now.columns == docs.columns
    found = brute_components([(i, simhash.fingerprint(rows[i].text)) for i in first.values()])
    now = corpus_pipeline.near_stage(spark, now, small)
    assert {r.doc_id for r in now.collect()} == set(found.values()) and now.columns == docs.columns
    now = corpus_pipeline.pii_stage(spark, now, small)
    assert {r.doc_id for r in now.collect()} == set(found.values()) and now.columns == docs.columns
    packed = corpus_pipeline.packing_stage(spark, now, small)
    assert {r.doc_id for r in packed.collect()} == set(found.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == sorted(map(tuple, packed.collect()))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("stage", [exact_dedup.keep_one, simhash.keep_one, pii.redact])
def test_stages_on_an_empty_table(spark, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, fp int, digest int")
    assert stage(docs).count() == 0 and stage(docs).columns == docs.columns


def written(spark, folder, rows, labels):
    """Tables of a scale factor's folder, with columns that bear the names of the stages' own."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y", 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, own_sha string, lost_id string, piece int")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, repeated ids and rows, ties and clashing columns, against plain Python."""
    rng = random.Random(21)
    good = lambda: " ".join(rng.choice("river stone cloud meadow lantern copper velvet orchard".split()) + rng.choice(["", "s", "ing", "ed"]) for _ in range(rng.randrange(30, 90)))
    bad = lambda: " ".join(rng.choice(["$$$", "BUY!!", "|", "%%%", "click"]) for _ in range(60))
    texts = {k: good() for k in range(60)} | {k: bad() for k in range(60, 90)}
    labels = [(k, int(k < 60), 0) for k in texts] + [(None, 1, 0), (3, None, None)]
    rows = [*texts.items(), (None, texts[5]), (None, good()), (None, None), (None, None), (7, texts[7]), (7, texts[7]), (8, good()), (200, texts[9].replace(" ", "\n ")), (201, texts[10] + " extra"), (202, None), (203, ""), (204, "mail me at a.b@c.de " + good())]
    folder = written(spark, tmp_path, rows, labels)
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    kept = [(i, t) for i, t in rows if model.scores([t or ""])[0] >= quality.THRESHOLD]
    assert 50 < len(kept) < len(rows) - 20
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for i, t in sorted(kept, key=order):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), (i, t))
    left = sorted(first.values(), key=lambda r: (*order(r), simhash.fingerprint(r[1] or "")))
    group = brute_components([(k, simhash.fingerprint(t or "")) for k, (_, t) in enumerate(left)])
    stay = [left[k] for k in sorted(set(group.values()))]
    got = corpus_pipeline.run(spark, folder)
    told = spark.createDataFrame(stay, "doc_id long, text string")
    want = packing.pieces(pii.redact(told))
    assert sorted(map(repr, (tuple(r)[:5] for r in got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert "[EMAIL]" in {w for r in pii.redact(told).collect() for w in (r.text or "").split()}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    folder = written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
