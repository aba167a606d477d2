"""Bounded samples of labelled rows, and a logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import discard, materialize

#: Bytes of labelled text that a fit takes of each class at most; a documented parameter of every ``fit``.
MOST_BYTES = 32 << 20


def remainder(mod: int) -> F.Column:
    """crc32 of the doc_id as text, modulo ``mod``; null for a null doc_id."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(mod))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: F.Column, per_class: dict[int, int], most_bytes: int = MOST_BYTES) -> tuple[dict[int, list[str]], dict[int, int]]:
    """Distinct texts by class, and how many labelled rows each class has.

    Rows come in the order of a hash of their ids, at most ``per_class`` of a class and as many as ``most_bytes`` hold; the first
    that does not fit ends the sample, and a single text over ``most_bytes`` is passed over. A doc_id with
    several labels counts once for each distinct label, and rows that repeat id and text count once. Rows with null ids or
    labels are ignored.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(learn & F.col("doc_id").isNotNull()).where(F.col("y").isin(*per_class)).distinct()
    counts = {int(r.y): int(r["count"]) for r in known.groupBy("y").count().collect()}
    chosen = None
    for y, most in per_class.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # as many ids as ``per_class`` allows
    found = materialize(found.select("doc_id", "y", "text", F.xxhash64("doc_id").alias("place"), F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("size")), "labelled")
    picked: list[tuple[int, str]] = []
    for y, most in per_class.items():
        rows = found.where((F.col("y") == y) & (F.col("size") <= most_bytes)).select("place", "doc_id", "sha", "size").distinct().orderBy("place", "doc_id", "sha").limit(most).collect()
        fits = np.cumsum([r["size"] for r in rows]) <= most_bytes
        picked += [(y, r.doc_id, r.sha) for r, fit in zip(rows, fits, strict=True) if fit]
    take = found.sparkSession.createDataFrame(picked, "y int, doc_id long, sha string")
    own = found.withColumn("y", F.col("y").cast("int")).join(F.broadcast(take), ["y", "doc_id", "sha"])  # as many rows as ``per_class`` allows
    texts = own.dropDuplicates(["y", "doc_id", "sha"]).select("y", "place", "doc_id", "sha", "text").collect()
    discard(found)
    out: dict[int, list[str]] = {y: [] for y in per_class}
    for r in sorted(texts, key=lambda r: (r.y, r.place, r.doc_id, r.sha)):
        out[int(r.y)].append(r.text)
    return out, {y: counts.get(y, 0) for y in per_class}


class Logistic:
    """Logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 1e-3) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        a = self._with_bias(x)
        b = np.zeros(a.shape[1])
        w = weights / weights.mean()
        keep = ridge * len(y) * np.diag([0.0] + [1.0] * (len(b) - 1))
        for _ in range(40):
            p = self._sigmoid(a @ b)
            step = np.linalg.solve((a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + keep, a.T @ (w * (y - p)) - keep @ b)
            b += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.b = b

    def _with_bias(self, x: np.ndarray) -> np.ndarray:
        return np.c_[np.ones(len(x)), (x - self.mean) / self.scale]

    @staticmethod
    def _sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._with_bias(x) @ self.b)
