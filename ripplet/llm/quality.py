"""Compression classifier of quality.

Two zstandard dictionaries are built, one from texts labelled good and one from
texts labelled bad. A text is compressed with each, piece by piece of ``PIECE`` bytes, so that a long text, or one that repeats itself,
is measured against the dictionaries all the way and not against its own beginning. The difference of the
two sizes, normalised by the length and by the sizes, is the evidence. Text that the good dictionary does not shrink further than the bad one, as words
repeated over and over, has none for it, whatever the difference is. A logistic calibration, fitted on labelled texts
that the dictionaries have not seen, turns it into a probability; the logarithm of the length stands beside it only
because a short text has an uncertain difference.

The fit takes at most ``per_class`` labelled texts and ``most_bytes`` bytes of each class; the class shares come from all labels.

Cases: null and empty texts are scored like any text of length zero; with no labels of one class, every score
is the smoothed share of the other; repeated rows get equal scores; equal scores need no order, as each row is judged by itself; columns
beside doc_id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import small_batches, texts
from ripplet.llm.fitting import MOST_BYTES, Logistic, labelled_sample, remainder

#: Bound of the labelled sample, for each class: the default of ``fit``.
PER_CLASS = 2000
#: Bytes that are compressed at a time.
PIECE = 1024
#: Bytes saved for each byte of text beyond which the evidence no longer grows.
MOST = 0.2
#: The same for each byte of the two sizes.
MOST_OF_SIZES = 0.3
DICTIONARY_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.3
FOLDS = 5
_SLICE = 512


def dictionary(samples: list[bytes]) -> tuple[bytes, int]:
    """Dictionary bytes and their zstandard type, from slices of the samples."""
    slices = [x[i : i + _SLICE] for x in samples for i in range(0, len(x), _SLICE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, slices, k=64, d=8).as_bytes(), zstandard.DICT_TYPE_FULLDICT
    except zstandard.ZstdError:  # too little text for training
        return b"".join(slices)[:DICTIONARY_BYTES], zstandard.DICT_TYPE_RAWCONTENT


@lru_cache(maxsize=8)
def compressor(data: bytes, kind: int) -> zstandard.ZstdCompressor:
    known = zstandard.ZstdCompressionDict(data, dict_type=kind)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


class Classifier:
    def __init__(self, samples: dict[int, list[str]], counts: dict[int, int]) -> None:
        self.share = (counts[1] + 1) / (counts[0] + counts[1] + 2)
        raw = {y: [t.encode() for t in samples[y]] for y in (0, 1)}
        self.calibrate = None
        if min(len(raw[0]), len(raw[1])) < 2:
            return
        self.dictionaries = {y: dictionary(raw[y][0::2]) for y in (0, 1)}
        rest = [(t, y) for y in (0, 1) for t in raw[y][1::2]]
        y = np.array([k for _, k in rest])
        weights = np.where(y == 1, self.share / (y == 1).mean(), (1 - self.share) / (y == 0).mean())
        self.calibrate = Logistic(self.features([t for t, _ in rest]), y, weights)

    def features(self, data: list[bytes]) -> np.ndarray:
        n = np.array([len(t) + 1 for t in data], dtype=float)
        bad, good = self.sizes(data, 0), self.sizes(data, 1)
        return np.c_[np.clip((bad - good) / n, 0.0, MOST), np.clip((bad - good) / (bad + good + 1), 0.0, MOST_OF_SIZES), np.log(n)]

    def sizes(self, data: list[bytes], y: int) -> np.ndarray:
        """Bytes that the texts take under the dictionary of class ``y``."""
        small = compressor(*self.dictionaries[y]).compress
        return np.array([sum(len(small(t[i : i + PIECE])) for i in range(0, len(t), PIECE)) for t in data], dtype=float)

    def scores(self, data: list[str]) -> np.ndarray:
        if self.calibrate is None or not data:
            return np.full(len(data), self.share)
        return self.calibrate(self.features([t.encode() for t in data]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Classifier:
    return Classifier(*labelled_sample(docs, labels, "quality", remainder(FOLDS) != 0, {0: per_class, 1: per_class}, most_bytes))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; no shuffle. A null doc_id is never learnt from: held out."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held = texts(docs).withColumn("held_out", F.coalesce(remainder(FOLDS) == 0, F.lit(True)))
    return held.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows that the classifier does not reject, whole and without a shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(s >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
