"""Exact deduplication against a minimal perfect hash of earlier digests.

The distinct digests of the earlier documents go to shards by hash. For each
shard a minimal perfect hash is built level by level: keys that are alone at
their position of a level are settled there, the others go on to the next; the
rank of the settled bit is the slot. A slot holds the full digest and the locator
(doc_id) of the document that stays. A digest that is looked up reaches one slot at
most, and counts as a member only if all bytes there are equal; members are repeats of
the slot's document, nonmembers group among themselves.

Digests are grouped before any lookup, so that a text with a third of all rows is
one lookup; only 32-byte digests are shuffled, never texts.

Cases: null and empty texts count as empty and equal one another, as do texts
of white space only (they are one space; empty text is another class). An empty table gives an empty result. Rows
with a null doc_id have their class's keep_id and never stay unless the whole class has none (keep_id
null, kept false). Rows that repeat a doc_id and text are flagged alike; ``keep_one`` leaves one of them. Further columns of any name are
left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.common import fresh, materialize, partitions, texts

#: Digests in a shard of the index, on average.
SHARD_ROWS = 16_384
GAMMA = 1.7
MAX_LEVELS = 60
INDEX = "shard int, slots long, levels array<binary>, digests binary, winners binary, named binary, sizes binary"
GROUPS = "digest binary, keep_id long, group_size long"
_INDEX_ARROW = pa.schema([("shard", pa.int32()), ("slots", pa.int64()), ("levels", pa.list_(pa.binary())), ("digests", pa.binary()), ("winners", pa.binary()), ("named", pa.binary()), ("sizes", pa.binary())])
_GROUPS_ARROW = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def normalised(text: str = "text") -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the 32-byte digest of the normalised text."""
    return docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"))


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests; slots are 0..n-1."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x) - x for x in levels]

    @staticmethod
    def words(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.ascontiguousarray(keys).view(np.uint64)
        return w[:, 0] ^ w[:, 2], (w[:, 1] ^ w[:, 3]) | np.uint64(1)

    @staticmethod
    def spot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        x = a + b * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        return ((x ^ (x >> np.uint64(28))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        a, b = cls.words(keys)
        left, levels = np.arange(len(keys)), []
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("digests are not distinct")
            size = max(8, int(GAMMA * len(left)))
            at = cls.spot(a[left], b[left], len(levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, dtype=bool)
            bits[at[alone]] = True
            levels.append(bits)
            left = left[~alone]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 where no level has a bit. What is no member may get any slot."""
        a, b = self.words(keys)
        out, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = self.spot(a[left], b[left], level, len(bits))
            hit = bits[at]
            out[left[hit]] = self.before[level] + self.ranks[level][at[hit]]
            left = left[~hit]
        return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 32)


def _build(key: tuple, rows: pa.Table) -> pa.Table:
    keys = _matrix(rows["digest"])
    table = PerfectHash.build(keys)
    order = np.argsort(table.slots(keys))
    levels = [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in table.levels]
    winners, sizes = (rows[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[order].tobytes() for c in ("first", "n"))
    named = rows["first"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)[order].tobytes()
    found = {"shard": key[0].as_py(), "slots": len(keys), "levels": levels, "digests": keys[order].tobytes(), "winners": winners, "named": named, "sizes": sizes}
    return pa.Table.from_pylist([found], schema=_INDEX_ARROW)


def build_index(grouped: DataFrame, shards: int) -> DataFrame:
    """Index over (digest, first, n): one row a shard."""
    return grouped.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build, INDEX)


def _shard(shards: int) -> F.Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")


def _lookup(index: pa.Table, new: pa.Table) -> pa.Table:
    """Every group of one shard: the slots with what was matched to them, then the nonmembers."""
    rest = new.select(["digest", "first", "n"]).rename_columns(["digest", "keep_id", "group_size"]).cast(_GROUPS_ARROW)
    if not index.num_rows:
        return rest
    row = index.to_pylist()[0]
    stored = np.frombuffer(row["digests"], dtype=np.uint8).reshape(-1, 32)
    sizes = np.frombuffer(row["sizes"], dtype=np.int64).copy()
    winners, named = np.frombuffer(row["winners"], dtype=np.int64).copy(), np.frombuffer(row["named"], dtype=bool).copy()
    if new.num_rows:
        levels = [np.unpackbits(np.frombuffer(x[8:], dtype=np.uint8), count=int.from_bytes(x[:8], "little")).astype(bool) for x in row["levels"]]
        keys = _matrix(new["digest"])
        slots = PerfectHash(levels).slots(keys)
        member = (slots >= 0) & (stored[slots] == keys).all(axis=1)  # every byte of the slot's digest
        np.add.at(sizes, slots[member], new["n"].to_numpy()[member])
        first = new["first"].combine_chunks()
        gives = member & first.is_valid().to_numpy(zero_copy_only=False)
        gives[gives] = ~named[slots[gives]]  # the slot's rows have no id: the smallest new one stays
        winners[slots[gives]] = first.fill_null(0).to_numpy(zero_copy_only=False)[gives]
        named[slots[gives]] = True
        rest = rest.filter(pa.array(~member))
    known = pa.table([pa.array([x.tobytes() for x in stored], pa.binary()), pa.array(winners, mask=~named), pa.array(sizes)], schema=_GROUPS_ARROW)
    return pa.concat_tables([known, rest])


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``history``: earlier documents; all its rows count in the groups, those without an id too, and none is
    returned. A text that it holds under an id stays there, whatever the ids of ``docs`` are; a row of ``docs`` with that id and text is that document
    once more. Without history, ``docs`` is taken as two
    deliveries: the ids up to the middle of their range are the earlier one. As these ids are the smaller
    ones, the smallest id of a group is the slot's wherever the text is a member.
    """
    spark = docs.sparkSession
    own = materialize(digests(docs), "digests")
    if history is None:
        low, high = own.agg(F.min("doc_id"), F.max("doc_id")).first()
        old = F.coalesce(F.col("doc_id") <= F.lit(0 if low is None else low + (high - low) // 2), F.lit(False))
        earlier, later = own.where(old), own.where(~old)
    else:
        earlier, later = digests(history), own
    grouped = materialize(_grouped(earlier), "history")
    shards = max(4 * partitions(spark), -(-grouped.count() // SHARD_ROWS))
    index = materialize(build_index(grouped, shards), "index")
    new = _grouped(later).withColumn("shard", _shard(shards))
    groups = index.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(_lookup, GROUPS)
    flagged = own.join(groups, "digest")
    return flagged.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns: one for each text.

    Where doc_ids are unique, the ids of the rows that go are all that is joined. Else rows are told by doc_id and
    digest, so a doc_id that stands for several texts loses none of them; of rows that repeat both, and of
    rows without a doc_id in a class that has none, one is left.
    """
    lost_id, lost_sha, own_sha = fresh(docs, "lost_id", "lost_sha", "own_sha")
    flags = materialize(exact_dedup(docs), "flags")
    lost = flags.where("not kept and keep_id is not null").select(F.col("doc_id").alias(lost_id), F.col("text_sha256").alias(lost_sha))
    same_id = F.col("doc_id").eqNullSafe(F.col(lost_id))
    if flags.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(materialize(lost.select(lost_id), "lost"), same_id, "left_anti")
    own = docs.withColumn(own_sha, F.sha2(normalised(), 256))
    kept = own.join(lost.distinct(), same_id & (F.col(own_sha) == F.col(lost_sha)), "left_anti")
    return kept.dropDuplicates(["doc_id", own_sha]).drop(own_sha)


ORACLE = r"""
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       coalesce(doc_id = min(doc_id) over w, false) as kept, sha256(t) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
window w as (partition by t)
"""
