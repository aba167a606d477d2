"""Byte-level BPE: encoding and decoding.

Each pretoken is a doubly linked list of symbols; a priority queue holds the ranks of
its neighbouring pairs with their places. What is popped is skipped if its pair has
changed since; else the two symbols become one and the two new pairs enter the
queue. Decoding concatenates vocabulary strings and turns their characters back into bytes.

Cases: null and empty texts have no ids and decode to the empty text; the strings of special tokens
in a text become their ids, as in the tokenizers library; a text of any length takes
time n log n in its longest pretoken.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ripplet.llm.common import Memory, small_batches, texts

#: Fixed value: how byte-level tokenizers of this kind split a text.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pretokens that a worker remembers, beyond which it starts anew, and the longest of them: together they bound its memory.
CACHE, CACHED_CHARS = 400_000, 48


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer's vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[b] = chr(256 + k)
    return out


class BytePairCoder:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_characters()
        self.byte_ids = [vocab[c] for c in chars]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks.setdefault(vocab[left] << 20 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        back = {c: bytes([b]) for b, c in enumerate(chars)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max(chain(vocab.values(), self.special.values())))
        for token, k in chain(vocab.items(), self.special.items()):
            self.bytes_of[k] = b"".join(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.split = regex.compile(PRETOKEN)
        self.split_special = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) if self.special else None
        self.words = Memory(self.merge, CACHE, CACHED_CHARS)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one pretoken."""
        byte_ids, ranks, merged = self.byte_ids, self.ranks, self.merged
        ids = [byte_ids[b] for b in word.encode()]
        n = len(ids)
        queue = [r << 32 | i for i in range(n - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return tuple(ids)
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            entry = pop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j < 0 or ranks.get(ids[i] << 20 | ids[j]) != rank:
                continue  # stale
            own = ids[i] = merged[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(own << 20 | ids[k])) is not None:
                    push(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks.get(ids[h] << 20 | own)) is not None:
                push(queue, r << 32 | h)
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str) -> list[int]:
        if self.split_special is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(map(self.words.__getitem__, self.split.findall(text))))
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += chain.from_iterable(map(self.words.__getitem__, self.split.findall(text[at : m.start()])))
            out.append(self.special[m[0]])
            at = m.end()
        out += chain.from_iterable(map(self.words.__getitem__, self.split.findall(text[at:])))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def coder(path: str) -> BytePairCoder:
    """One coder for each worker and vocabulary."""
    return BytePairCoder(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text; no shuffle."""
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        names = list(map(str, range(len(own.bytes_of))))
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = own.encode(text)
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of every whole text."""
    small_batches(docs.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [coder(path).encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def detokenized(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the text of (doc_id, ids); null ids give the empty text."""
    small_batches(encoded.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [coder(path).decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
