"""Sum-of-squares packing of tokenised documents into sequences.

A document longer than a sequence is cut; only its first piece may be shorter.
The pieces are dealt by hash to groups of bounded expected size. Within a group,
pieces come by falling length, and each goes to that open sequence by which the sum over all residual gaps of
the squared count of open sequences becomes smallest; ties take the smallest gap that remains. Only a piece that
no open sequence can hold opens a new one: with falling lengths this needs about 1 % fewer sequences
than weighing a new one against the open ones each time. A group leaves few sequences open, so the loss falls with its size.

Cases: null and empty texts are one piece that holds the end token alone; white space of any
length is encoded whole; an empty table gives an empty result; repeated rows are packed each for itself and dealt to all groups; pieces that
tie in length come by doc_id, piece and checksum; further columns of any name are left alone. Pieces are the same in every run; which sequence one
goes to depends on how the rows lie.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.bpe import PRETOKEN, byte_characters, vocabulary_path
from ripplet.llm.common import materialize, small_batches, texts

CAPACITY = 1024
END = 2
#: Pieces in a group, on average.
GROUP_ROWS = 16_384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@lru_cache(maxsize=2)
def whole_encoder(path: str):  # noqa: ANN201
    """The tokenizers library, which has no limit to a run."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def fast_encoder(path: str):  # noqa: ANN201
    """Ids of a text as a numpy array: the vocabulary of the tokenizers file, merged by tiktoken.

    The regular expressions of tiktoken refuse white space of about a million characters in a row; such texts go to the tokenizers library.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {c: b for b, c in enumerate(byte_characters())}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    own = tiktoken.Encoding("file", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)
    found = regex.compile("|".join(map(regex.escape, special))) if special else None

    def encode(text: str) -> np.ndarray:
        try:
            if found and found.search(text):
                return np.array(own.encode(text, allowed_special="all"), dtype=np.uint32)
            return np.asarray(own.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
        except ValueError:
            return np.array(whole_encoder(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                starts = [0, *range(first, len(ids), capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY, online: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, placed in the order given. ``online``: a new bin is weighed against the open ones each time."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; a gap of zero is closed
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for k, size in enumerate(lengths.tolist()):
        # by remaining gap r = 0 .. capacity - size: what changes if a bin with gap r + size takes it
        change = 2 * count[: capacity - size + 1] + 1
        change[0] = 0
        taken = count[size:]
        new = int(change[-1])
        change = np.where(taken > 0, change - 2 * taken + 1, np.iinfo(np.int64).max)
        rest = int(change.argmin())
        if not taken[rest] or online and new < change[rest]:
            rest = capacity - size  # none fits: a new bin
        gap = rest + size
        if gap == capacity:
            at, made = made, made + 1
        else:
            at = open_[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = at, capacity - gap
        if rest:
            open_[rest].append(at)
            count[rest] += 1
    return bins, offsets


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, online: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset. ``online``: as in ``sum_of_squares``."""
    cut = materialize(pieces(docs, path, capacity, end), "pieces")
    groups = max(1, -(-cut.count() // GROUP_ROWS))

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]))
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity, online)
        return rows.drop_columns("pack_group").append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    # the row's number in the written table deals rows that repeat everything to all groups alike
    dealt = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(place, PACKED)
