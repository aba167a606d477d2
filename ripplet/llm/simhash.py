"""SimHash near-duplicates by covering with anchor points.

The 64 bits of a fingerprint are two halves, each covered by an anchor code of
32 bits: the perfect Hamming code of 31 bits, with the last bit free, whose
covering radius is one. Of two fingerprints at most ``t`` bits apart, one half is at most
``t // 2`` bits apart; some point lies at most ``ceil(t // 2 / 2)`` bits from both, and an anchor at most one bit from that point.
So replicating every half to all anchors within ``1 + ceil(t // 2 / 2)`` bits (16 to 18 anchors at ``t`` = 4)
brings every linked pair together at some anchor: the radius plus the half of the threshold that a midpoint takes.

Fingerprints are made distinct first. At an anchor a search from member to member over those
not yet reached emits one link for each member found, never all pairs. Anchors with more than
``TILE`` members are dealt out as pairs of tiles, so no task holds an unbounded group, and no link is lost.
Where that would copy a fingerprint to more tiles than there are points within half the threshold of it (2,081),
it goes to these points instead: any two that are linked share a midpoint, and no point has more
than 2,081 distinct fingerprints. So the copies of a fingerprint are bounded, however many share its anchor.

Cases: null and empty texts have fingerprint zero and are linked like any other; fewer words than a shingle
make one shingle; an empty table gives an empty result. Rows with a null doc_id are linked like any other and pass on links; the
component_id is null only where no row of the component has an id. Rows that repeat a doc_id are rows of their own; further columns of
any name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplet.llm.common import fresh, materialize, partitions, small_batches, texts
from ripplet.operators.components import connected_components

WORDS = 4
SEED = 42
THRESHOLD = 4
TILE = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CHUNK = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is one if it is set in over half of the shingles' hashes, repeats included."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return 0
    h = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        hashes = np.array([h(b" ".join(parts[i : i + words]), SEED) for i in range(at, min(n, at + _CHUNK))], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def anchor_masks(reach: int) -> list[np.ndarray]:
    """For each of the 32 syndromes, the bit patterns of up to ``reach`` bits that lead to an anchor."""
    found: list[list[int]] = [[] for _ in range(32)]

    def grow(first: int, mask: int, syndrome: int, left: int) -> None:
        found[syndrome].append(mask)
        if left:
            for bit in range(first, 32):
                grow(bit + 1, mask | 1 << bit, syndrome ^ ((bit + 1) % 32), left - 1)  # bit 31 has syndrome 0: it is free

    grow(0, 0, 0, reach)
    return [np.array(sorted(x), dtype=np.uint64) for x in found]


def midpoint_masks(threshold: int) -> np.ndarray:
    """All patterns of up to half the threshold (rounded up) of 64 bits."""
    return np.array([sum(1 << b for b in bits) for k in range(-(-threshold // 2) + 1) for bits in combinations(range(64), k)], dtype=np.uint64)


def syndromes(half: np.ndarray) -> np.ndarray:
    out = np.zeros(len(half), dtype=np.int64)
    for bit in range(31):
        out ^= ((half >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) * (bit + 1)
    return out


def anchors(fp: np.ndarray, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cells (half and anchor in one number) of all replicas of unsigned fingerprints."""
    rows, cells = [], []
    for side in (0, 1):
        half = fp >> np.uint64(32) if side else fp & np.uint64(0xFFFFFFFF)
        kinds = syndromes(half)
        for s in range(32):
            at = np.flatnonzero(kinds == s)
            rows.append(np.repeat(at, len(masks[s])))
            cells.append(((half[at, None] ^ masks[s][None, :]) | np.uint64(side << 32)).ravel())
    return np.concatenate(rows), np.concatenate(cells).view(np.int64)


def local_links(fp: np.ndarray, rep: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links that join the members of each cluster to its first member: at most one for each member."""
    out, left = [], np.argsort(rep, kind="stable")
    while len(left) > 1:
        root, left = left[0], left[1:]
        open_ = [root]
        while open_ and len(left):
            near = np.bitwise_count(fp[left] ^ fp[open_.pop()]) <= threshold
            if near.any():
                reached, left = left[near], left[~near]
                open_ += reached.tolist()
                out += [(int(rep[x]), int(rep[root])) for x in reached]
    return out


def _scan(threshold: int):  # noqa: ANN202
    """Over rows sorted by cell and tile: links within each."""

    def links(keys: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
        sizes = np.diff(edge)
        a = edge[:-1][sizes == 2]
        near = a[np.bitwise_count(fp[a] ^ fp[a + 1]) <= threshold]
        src, dst = [*rep[near].tolist()], [*rep[near + 1].tolist()]
        for k in np.flatnonzero(sizes > 2):
            for s, d in local_links(fp[edge[k] : edge[k + 1]], rep[edge[k] : edge[k + 1]], threshold):
                src.append(s)
                dst.append(d)
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, reps = [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, tile, fp, rep = (batch.column(i).to_numpy() for i in range(4))
            keys.append(np.stack([cell, tile], axis=1))
            fps.append(fp.view(np.uint64))
            reps.append(rep)
            if sum(map(len, keys)) < 65_536:
                continue
            k = np.concatenate(keys)
            cut = int(np.flatnonzero((k != k[-1]).any(axis=1))[-1]) + 1 if (k[0] != k[-1]).any() else 0
            f, r = np.concatenate(fps), np.concatenate(reps)
            if cut:
                yield links(k[:cut], f[:cut], r[:cut])
            keys, fps, reps = [k[cut:]], [f[cut:]], [r[cut:]]  # the last group may go on
        if keys and len(k := np.concatenate(keys)):
            yield links(k, np.concatenate(fps), np.concatenate(reps))

    return run


def links(distinct: DataFrame, threshold: int = THRESHOLD, most_tiles: int | None = None) -> DataFrame:
    """(src, dst) among the rep of ``distinct(fp, rep)``, enough to connect all at most ``threshold`` bits apart.

    Anchors of over ``most_tiles`` tiles (by default, the number of midpoints) are compared by midpoints.
    """
    spark = distinct.sparkSession
    small_batches(spark)
    masks = anchor_masks(1 + -(-(threshold // 2) // 2))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            row, cell = anchors(fp, masks)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp[row].view(np.int64)), pa.array(rep[row])], ["cell", "fp", "rep"])

    around = midpoint_masks(threshold)
    most_tiles = len(around) if most_tiles is None else most_tiles

    def halfway(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cell = (fp.view(np.uint64)[:, None] ^ around[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.full(len(cell), -1)), pa.array(np.repeat(fp, len(around))), pa.array(np.repeat(rep, len(around)))], ["cell", "tile", "fp", "rep"])

    n = partitions(spark)
    placed = distinct.select("fp", "rep").where("rep is not null").mapInArrow(replicate, "cell long, fp long, rep long")
    hot = materialize(placed.groupBy("cell").count().where(F.col("count") > TILE).select("cell", F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("tiles")), "hot")
    if not hot.limit(1).count():
        dealt = placed.withColumn("tile", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("long")
        pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda x: F.least(x, F.col("own")) * F.col("tiles") + F.greatest(x, F.col("own")))
        both = placed.join(hot, "cell", "left").withColumn("own", own)
        tiled = both.where(F.col("tiles").isNull() | (F.col("tiles") <= most_tiles))
        dealt = tiled.withColumn("tile", F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)))
        if not (dense := hot.where(F.col("tiles") > most_tiles)).isEmpty():
            crowd = placed.join(dense.select("cell"), "cell").select("fp", "rep").distinct()
            dealt = dealt.select("cell", "tile", "fp", "rep").union(crowd.mapInArrow(halfway, "cell long, tile long, fp long, rep long"))
    dealt = dealt.select("cell", "tile", "fp", "rep").repartition(n, "cell", "tile").sortWithinPartitions("cell", "tile")
    return dealt.mapInArrow(_scan(threshold), "src long, dst long")


def classes(own: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(fp, node, component_id) of every distinct fp of ``own(doc_id, fp)``: ``node`` is the component's smallest fp, as a signed number."""
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = materialize(connected_components(materialize(links(distinct.select("fp", F.col("fp").alias("rep")), threshold).distinct(), "links")), "components")
    smallest = found.join(distinct, F.col("node") == F.col("fp")).groupBy("component").agg(F.min("first").alias("least"))
    linked = found.join(smallest, "component").select(F.col("node").alias("fp"), F.col("component").alias("joint"), "least")
    rows = distinct.join(linked, "fp", "left")
    named = rows.select("fp", F.coalesce("joint", "fp").alias("node"), F.when(F.col("joint").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return materialize(named, "classes")  # a written table has no partitioning, so a join with it shuffles both sides and AQE splits the rows of a hot text


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    own = materialize(fingerprints(docs, words), "fingerprints")
    return own.join(classes(own, threshold), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id (none comes last), then of the smallest fingerprint and digest of the text.

    Where doc_ids are unique, the ids of the rows that go are all that is joined.
    """
    own = materialize(fingerprints(docs, words), "fingerprints")
    known = classes(own, threshold)
    if own.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        (lost_id,) = fresh(docs, "lost_id")
        lost = own.join(known, "fp").where("doc_id <> component_id").select(F.col("doc_id").alias(lost_id))
        return docs.join(materialize(lost, "near"), F.col("doc_id") == F.col(lost_id), "left_anti")
    fp, sha, node, order, least = fresh(docs, "own_fp", "own_sha", "own_node", "own_order", "least_order")
    told = with_fingerprints(docs, fp, words).withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    told = told.join(known.select(F.col("fp").alias(fp), F.col("node").alias(node)), fp).withColumn(order, F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), fp, sha))
    firsts = materialize(told.groupBy(node).agg(F.min(order).alias(least)), "firsts")
    kept = told.join(firsts, node).where(F.col(order) == F.col(least)).dropDuplicates([node])
    return kept.select(*docs.columns)


def with_fingerprints(docs: DataFrame, name: str, words: int = WORDS) -> DataFrame:
    """All columns and the fingerprint, as a signed long, under a further name."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or "", words) for t in batch.column(at).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
