import math

import numpy as np
import pytest

from ripplet.llm import entries, whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(vectors, components=8):
    """By whole numbers and numpy's solver."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    away = x * n - sums
    centred = away.astype(float) / n
    values, components_ = np.linalg.eigh(centred.T @ centred / n)
    values, components_ = values[::-1], components_[:, ::-1]
    k = min(components, len(values))
    return n, (away * away).sum(axis=1), centred @ components_[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(rows, ids, vectors):
    n, deviation, whitened, explained = plain(vectors)
    k = whitened.shape[1]
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == len(ids) * k
    sign = [math.copysign(1, by[ids[0], c + 1].whitened * whitened[0, c]) for c in range(k)]
    for at, key in enumerate(ids):
        for c in range(k):
            r = by[key, c + 1]
            assert r.n == n and r.deviation == deviation[at]
            assert r.whitened == pytest.approx(sign[c] * whitened[at, c], abs=1e-8)
            assert r.explained == pytest.approx(explained[c], rel=1e-10)
            assert 0 <= r.identity_error < 1e-10


def test_query_against_plain_numbers(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    check(entries.op11_whitening(spark, small).collect(), [r.vec_id for r in table], [r.embedding for r in table])


def test_odd_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    good = [[float(np.float32(x)) for x in rng.normal(size=5) * [1, 2, 3, 4, 5]] for _ in range(200)]
    good += [good[0]] * 3  # repeats count
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [math.nan] * 5, [math.inf, 0.0, 0.0, 0.0, 0.0], [0.0, 0.0, -math.inf, 0.0, 0.0], [], [1.0, 2.0]]
    rows = [(k, v, "x", 1) for k, v in enumerate(good + bad)]
    table = spark.createDataFrame(rows, SCHEMA + ", text string, component int").repartition(7)
    check(whitening.whiten(table).collect(), list(range(len(good))), good)


def test_empty_single_equal_and_null_ids(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], SCHEMA)).collect() == []
    for rows in ([(None, [0.5, 0.25])], [(1, [0.5, 0.25])] * 4):
        found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
        assert len(found) == 2 * len(rows)
        assert {(r.whitened, r.explained, r.deviation, r.identity_error) for r in found} == {(0.0, 0.0, 0, 0.0)}
        assert {r.vec_id for r in found} == {rows[0][0]}


def test_huge_entries(spark):
    rows = [(k, [float(10**k), 1.0]) for k in range(0, 36, 5)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 16 and all(np.isfinite(r.whitened) for r in found)
    n, deviation, _, _ = plain([[min(v, 2**62 / 1024), o] for _, (v, o) in rows])
    assert {r.vec_id: r.deviation for r in found} == {key: (d if d < 2**63 else None) for (key, _), d in zip(rows, deviation, strict=True)}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["full", "diagonal", "ones", "zero", "twice"])
def test_symmetric_qr(n, kind):
    x = np.random.default_rng(n).normal(size=(3 * n, n)) * 10.0 ** np.random.default_rng(9).uniform(-3, 3, n)
    a = {"full": x.T @ x, "diagonal": np.diag(np.diag(x.T @ x)), "ones": np.ones((n, n)), "zero": np.zeros((n, n)), "twice": np.eye(n)}[kind]
    values, vectors = whitening.symmetric_qr(a)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-11 * size
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-11 * size


def test_moments_merge_in_any_split():
    rng = np.random.default_rng(2)
    x = rng.integers(-600, 600, size=(300, 6))
    whole = whitening.Moments(6)
    for part in np.array_split(x, [3, 3, 100, 299]):
        one = whitening.Moments(6)
        one.add(part.astype(float))
        one.count(part)
        whole.merge(one)
    assert whole.n == 300 and whole.sums == x.sum(axis=0).tolist()
    assert np.allclose(whole.products / 300, np.cov(x.T, bias=True), rtol=1e-12)
