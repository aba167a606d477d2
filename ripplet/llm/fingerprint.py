"""Quartile bucket digests of documents.

A digest counts hashed byte triplets in 128 buckets, writes for each bucket
the quartile that its count falls in, and puts the length before that. Two
digests compare by a bounded difference: buckets that lie quartiles apart, the
opposite quartiles weighted most, and the logarithms of the lengths.

Cases: null and empty texts have the digest of no bytes; texts under four bytes
have no triplets and only carry their length; equal texts have equal digests; repeated
rows are digested each for itself.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplet.llm.common import partitions, small_batches, texts

BUCKETS = 128
#: Difference up to which steps count in full: unrelated texts of one language lie near it. Beyond it they count ``BEYOND`` of that, so that what lies far off still has an order.
KNEE, BEYOND = 160.0, 0.04
#: The largest difference, at which likeness is zero.
BOUND = 176.0
_GAP = np.array([0, 1, 3, 6], dtype=np.float64)
_CHUNK = 1 << 20
#: Characters of a text that tell the range of rows which share a doc_id.
LEAD = 64


def digest(data: bytes) -> str:
    """``length byte, quartile ratio byte, 128 two-bit quartiles`` in lowercase hex (68 digits)."""
    n = len(data)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    a = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, max(0, n - 3), _CHUNK):
        w = a[at : at + _CHUNK + 3].astype(np.uint32)
        b0, b1, b2, b3 = w[:-3] * np.uint32(0x9E3779B1), w[1:-2] * np.uint32(0x85EBCA77), w[2:-1] * np.uint32(0xC2B2AE3D), w[3:]
        for salt, mixed in ((1, b0 + b1 + w[2:-1] * np.uint32(0x27D4EB2F)), (2, b0 + b1 + b3 * np.uint32(0x165667B1)), (3, b0 + b2 + b3 * np.uint32(0xD3A2646D))):
            mixed = (mixed ^ (mixed >> np.uint32(15)) ^ np.uint32(salt * 0x632BE5AB & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(mixed >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    body = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = body[0::4] << 6 | body[1::4] << 4 | body[2::4] << 2 | body[3::4]
    ratio = (int(q1 * 15 // q3) << 4 | int(q2 * 15 // q3)) if q3 else 0
    return f"{min(255, round(12 * math.log1p(n))):02x}{ratio:02x}{packed.astype(np.uint8).tobytes().hex()}"


def difference(a: str, b: str) -> float:
    """Symmetric, zero for equal digests, at most ``BOUND``."""
    if a == b:
        return 0.0
    x, y = (np.frombuffer(bytes.fromhex(s), dtype=np.uint8) for s in (a, b))
    quarters = [np.stack([p >> 6 & 3, p >> 4 & 3, p >> 2 & 3, p & 3]).astype(np.int8) for p in (x[2:], y[2:])]
    apart = _GAP[np.abs(quarters[0] - quarters[1])].sum()
    length = abs(int(x[0]) - int(y[0]))
    ratios = abs(int(x[1] >> 4) - int(y[1] >> 4)) + abs(int(x[1] & 15) - int(y[1] & 15))
    total = float(apart + max(0, length - 1) + max(0, ratios - 1))
    return min(BOUND, total if total <= KNEE else KNEE + BEYOND * (total - KNEE))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 at the bound of the difference."""
    return 1.0 - difference(a, b) / BOUND


@F.pandas_udf(T.StringType())
def digest_column(text):  # noqa: ANN001, ANN201
    """Digest of a string column; null counts as empty."""
    return text.map(lambda t: digest((t or "").encode()))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Digest every text, and the text whose last half gave way to the start of the next document.

    The next document is that of the next doc_id; rows that share a doc_id follow
    one another by text, and a null doc_id comes first. After the last comes the
    first; a lone document follows itself.

    One shuffle of ids and beginnings of texts finds where each range of (id, text) begins; one shuffle of texts
    deals the documents to these ranges, with the first row of each sent to the range before as well. So rows that share an
    id, or have none, spread over ranges by their texts; only equal beginnings stay together, and a range is read row by row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = texts(docs)
    n = partitions(spark)
    keys = docs.select("doc_id", F.substring("text", 1, LEAD).alias("lead"))
    heads = [r for r in keys.repartitionByRange(n, "doc_id", "lead").sortWithinPartitions("doc_id", "lead").mapInArrow(_head, "seen boolean, first long, lead string").collect() if r.seen]
    firsts = sorted({_key(r.first, r.lead) for r in heads})
    if not firsts:
        return spark.createDataFrame([], SCHEMA)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), batch.column(1)
            data = rows.to_pylist()
            own = [_key(i, t[:LEAD]) for i, t in zip(ids.to_pylist(), data, strict=True)]
            part = np.array([max(0, bisect.bisect_right(firsts, k) - 1) for k in own], dtype=np.int64)
            first: dict[int, int] = {}  # of each range that begins here, the smallest text
            for k, x in enumerate(own):
                if x == firsts[part[k]] and (part[k] not in first or data[k].encode() < data[first[part[k]]].encode()):
                    first[part[k]] = k
            lead = np.array(list(first.values()), dtype=np.int64)
            take = pa.array(np.concatenate([np.arange(len(part)), lead]))
            where = np.concatenate([part, (part[lead] - 1) % len(firsts)]).astype(np.int32)
            guard = np.concatenate([np.zeros(len(part), bool), np.ones(len(lead), bool)])
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(guard), ids.take(take), rows.take(take)], ["part", "guard", "doc_id", "text"])

    dealt = docs.mapInArrow(deal, "part int, guard boolean, doc_id long, text string").repartitionById(max(n, len(firsts)), F.col("part"))
    return dealt.sortWithinPartitions("part", "guard", "doc_id", "text").mapInArrow(_edit, SCHEMA)


def _key(doc_id: int | None, lead: str) -> tuple[bool, int, bytes]:
    """In the order of Spark: no id first, texts by their bytes."""
    return doc_id is not None, doc_id or 0, lead.encode()


def _head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, lead, seen = None, None, False
    for batch in batches:
        if batch.num_rows and not seen:
            first, lead, seen = batch.column(0)[0].as_py(), batch.column(1)[0].as_py(), True
    yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([first], pa.int64()), pa.array([lead], pa.string())], ["seen", "first", "lead"])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    before, over = None, set()
    for batch in batches:
        out = []
        for part, guard, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part in over:
                continue
            own = digest(text.encode())
            if before and before[0] == part:
                out.append(_row(*before[1:], text, own))
            if guard:
                over.add(part)
                before = None
            else:
                before = (part, doc_id, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names)


def _row(doc_id: int | None, text: str, own: str, following: str, other: str) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + following[:half]).encode()
    changed = digest(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, other)
