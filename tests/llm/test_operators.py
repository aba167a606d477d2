"""Operators against plain versions, on odd rows and on the small tables."""

import hashlib
import random
import re
import time
import zlib

import pytest
from plain_components import brute_components

from ripplet.llm import bpe, entries, exact_dedup, fingerprint, fitting, html, packing, pii, quality, secrets, simhash, toxicity

SCHEMA = "doc_id bigint, text string, lang string, digest int, fp string, part string, count int, keep_id int"
BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "漢字", "🙂"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    long = prose(30_000)
    base = prose(200)
    texts = [None, "", " ", "\t\n", "a", "ab c", base, base.replace(" ", "\n\t"), base + " x", base, long, "a" * 20_000, "mail me: a.b@c.de, +1 (555) 123-4567 4111 1111 1111 1111 from 10.0.0.1", "password = 'Abc123Def456Ghi'", "<|endoftext|> end <|endoftext|>", prose(50)]
    rows = [(k * 3 + 1, t) for k, t in enumerate(texts)]
    rows += [(7, "a second text of id 7"), rows[6], rows[6], (None, base), (None, "only null ids"), (None, "only null ids"), (BIG, prose(40)), (-5, prose(30))]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame([(i, t, "xx", 1, "f", "p", 2, 3) for i, t in odd_rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_fingerprint_edits(odd, odd_rows, none):
    rows = sorted(((i, t or "") for i, t in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        a, b, c = (fingerprint.digest(x.encode()) for x in (t, edited, other))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    got = [tuple(r) for r in fingerprint.fingerprint_edits(odd).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert fingerprint.fingerprint_edits(none).count() == 0
    lone = fingerprint.fingerprint_edits(odd.where("doc_id = -5")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_likeness():
    rng = random.Random(2)
    letters = "abcdefghij klmnop"
    text = "".join(rng.choice(letters) for _ in range(3000))
    near, far = text[:2900] + "".join(rng.choice("xyzw ") for _ in range(100)), "".join(rng.choice("qrstuvwxyz ") for _ in range(3000))
    a, b, c = (fingerprint.digest(x.encode()) for x in (text, near, far))
    assert fingerprint.likeness(a, a) == 1 and len(a) == 68
    assert fingerprint.likeness(a, b) > 0.5 > 0.3 > fingerprint.likeness(a, c) >= 0
    assert fingerprint.likeness(a, b) == fingerprint.likeness(b, a)


def test_digest_counts_every_triplet():
    data = bytes(range(256)) * 9000  # over several chunks
    whole = fingerprint.digest(data)
    old, fingerprint._CHUNK = fingerprint._CHUNK, 1000
    try:
        assert fingerprint.digest(data) == whole
    finally:
        fingerprint._CHUNK = old


def normal(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def dedup_rows(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(repr((i, keep[normal(t)], len(groups[normal(t)]), i is not None and i == keep[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest())) for i, t in rows)


def test_exact_dedup(spark, odd, odd_rows, none):
    assert sorted(map(repr, map(tuple, exact_dedup.exact_dedup(odd).collect()))) == dedup_rows(odd_rows)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(t) for _, t in odd_rows})
    assert exact_dedup.keep_one(none).count() == 0


def test_exact_dedup_with_history(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    new = spark.createDataFrame([(10, "a"), (11, "c"), (12, "c")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(new, old).collect()}
    assert got == {10: (1, 3, False), 11: (11, 2, True), 12: (11, 2, False)}


def test_perfect_hash():
    import numpy as np

    keys = np.frombuffer(b"".join(hashlib.sha256(str(k).encode()).digest() for k in range(5000)), dtype=np.uint8).reshape(-1, 32)
    table = exact_dedup.PerfectHash.build(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(5000))
    with pytest.raises(ValueError):
        exact_dedup.PerfectHash.build(np.concatenate([keys[:2], keys[:1]]))


def test_bpe_against_tokenizers(odd, odd_rows, none, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.vocabulary_path())
    for table in (odd, docs):
        texts = [(r.doc_id, r.text or "") for r in table.collect()]
        want = []
        for i, t in texts:
            ids = own.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert sorted(map(repr, map(tuple, bpe.encode_decode(table).collect()))) == sorted(map(repr, want))
    assert bpe.encode_decode(none).count() == 0
    back = bpe.detokenized(bpe.tokens(odd)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in odd_rows)


def test_bpe_on_odd_characters():
    from tokenizers import Tokenizer

    own, coder = Tokenizer.from_file(bpe.vocabulary_path()), bpe.coder(bpe.vocabulary_path())
    rng = random.Random(4)
    pool = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x1F600, 0x1D7D8, 0x660, *range(0x4E00, 0x4E20)]] + [" ", "\n", "'s", "'ll", "123"]
    for _ in range(500):
        t = "".join(rng.choice(pool) for _ in range(40))
        ids = own.encode(t, add_special_tokens=False).ids
        assert coder.encode(t) == ids and coder.decode(ids) == own.decode(ids, skip_special_tokens=False) == t


def pii_base(t):
    luhn = lambda s: sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(s))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    tests = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return sorted((m.start(), k, m.end(), name) for k, (name, pattern, ok) in enumerate(tests) for m in re.finditer(pattern, t) if ok(m[0]))


def pii_want(i, t):
    found = pii_base(t)
    text = ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
    return (i, *(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(text.encode()).hexdigest())


def test_pii(spark, odd, none, docs):
    rng = random.Random(9)
    parts = ["a@b.c", "@", ".", "..", "x@y", "@z.com", "1.2.3.4", "256.1.1.1", "0001.2.3.4.5.6.7", "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "+49 (30) 123-4567", "+1", "-", " ", "é", "🙂", "12", "9999", "+", "a.b%c"]
    noisy = spark.createDataFrame([(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for k in range(800)] + [(900, "1" * 50_000), (901, "a" * 50_000 + "@"), (902, "1." * 30_000), (903, "a@b" + ".c" * 30_000), (904, "1 " * 30_000), (905, "é a@b.co 1.2.3.4 " * 1_000)], "doc_id long, text string")
    for table in (noisy, odd, docs):
        got = [tuple(r)[:6] for r in pii.pii_report(table).collect()]
        assert sorted(map(repr, got)) == sorted(repr(pii_want(r.doc_id, r.text or "")) for r in table.collect())
    assert pii.pii_report(none).count() == 0


def test_pii_added_kinds_and_scores(spark):
    t = "Konto DE89 3704 0044 0532 0130 00 and DE89 3704 0044 0532 0130 01; SSN 123-45-6789, part 987-65-4321, ref 123-45-6789"
    row = pii.pii_spans(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    kinds = [(s.kind, t[s.start : s.end]) for s in row.spans]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds and sum(k == "iban" for k, _ in kinds) == 1
    assert [x for k, x in kinds if k == "ssn"] == ["123-45-6789"]
    near, bare = (pii.pii_spans(spark.createDataFrame([(1, x + "a@b.de")], "doc_id long, text string")).first().spans[0].score for x in ("mail: ", ""))
    assert near > bare


def test_pii_context_of_lists_and_brackets(spark):
    """Candidates of a list share the words before its first one, up to 40 characters back; words in brackets count behind a candidate."""
    number, other = "123-45-6789", "234-56-7890"
    texts = {
        f"SSNs: {number}, {other}; 345-67-8901": 3,
        f"SSN {number}, part {other}": 1,
        f"SSN {number}, 987-65-4321, {other}": 2,
        f"{number} (SSN)": 1,
        f"{number} [ Social  Security no.]": 1,
        f"{number}; SSN: {other}": 1,
        f"{number} is an SSN": 0,
        number: 0,
        f"SSN {'x' * 36} {number}": 0,
        f"SSN {'x' * 35} {number}": 1,
        f"SSN {'x' * 24} {number} {other}": 1,
        f"SSN {'x' * 20} {number} {other}": 2,
        "SSNs: " + f"{number} " * 400: 3,
        f"social {number} security": 0,
    }
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: sum(s.kind == "ssn" for s in r.spans) for r in pii.pii_spans(rows).collect()}
    cleaned = {r.doc_id: r.text.count("[SSN]") for r in pii.redact(rows).collect()}
    assert list(texts.values()) == [got[i] for i in range(len(texts))] == [cleaned[i] for i in range(len(texts))]


def test_ibans_end_at_their_length(spark):
    ibans = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]
    rows = [x + end for x in ibans for end in (" Thanks", " Before", " B", " 2024", " 12 EUR", " " + ibans[0], "", ";", "x")]
    rows += [f"AB12 3456 7890 1234 {ibans[0]} Thanks", f"{ibans[0]}BEFORE"]
    got = [[t[s.start : s.end] for s in spans if s.kind == "iban"] for t, spans in ((r.text, r.spans) for r in pii.pii_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).join(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), "doc_id").orderBy("doc_id").collect())]
    want = [[x, ibans[0]] if t == f"{x} {ibans[0]}" else [x] for t, x in zip(rows, [x for x in ibans for _ in range(9)], strict=False)] + [[ibans[0]], []]
    assert got == want
    out = [r.text for r in pii.redact(spark.createDataFrame([(1, f"to {ibans[0]} Thanks"), (2, f"{ibans[1]} 2024")], "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out == ["to [IBAN] Thanks", "[IBAN] 2024"]


def test_redaction(spark, odd, docs):
    t = "mail a.b@c.de or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.1 v1.2.3"
    out = pii.redact(spark.createDataFrame([(1, t, 5), (2, None, 0)], "doc_id long, text string, n_chars long")).orderBy("doc_id").collect()
    assert out[0].text == "mail [EMAIL] or [PHONE], card [CARD], host [IP] v1.2.3" and out[0].n_chars == len(out[0].text)
    assert out[1].text is None
    assert pii.redact(odd).columns == odd.columns and pii.redact(odd).count() == odd.count()
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert all(not pii_base(x) for x in after.values()) and all(after[i] == t for i, t in before.items() if not pii_base(t))


def test_no_python_in_the_pii_plan(docs):
    plan = pii.pii_report(docs)._jdf.queryExecution().executedPlan().toString() + pii.redact(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def plain_fingerprint(t):
    import xxhash

    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_want(rows):
    fps = [(i, simhash.fingerprint(t or "")) for i, t in rows]
    least = {}
    for i, f in fps:
        if i is not None:
            least[f] = min(least.get(f, i), i)
    found = brute_components([(i, f) for f, i in least.items()])
    return sorted(repr((i, f"{f:016x}", found[least[f]] if f in least else None)) for i, f in fps)


def test_simhash(spark, odd, odd_rows, none, docs):
    for _, t in odd_rows[:9]:
        assert simhash.fingerprint(t or "") == plain_fingerprint(t or "")
    unique = [r for r in odd_rows if r[0] != 7]  # one doc_id with two texts belongs to two classes
    assert sorted(map(repr, map(tuple, simhash.near_duplicates(odd.where("doc_id is null or doc_id <> 7")).collect()))) == near_want(unique)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, simhash.near_duplicates(docs).collect()))) == near_want(rows)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(odd).columns == odd.columns


@pytest.mark.parametrize(("tile", "most"), [(simhash.TILE, None), (16, None), (16, 2), (4, 0)])
def test_links_lose_nothing(spark, monkeypatch, tile, most):
    """Random clusters of fingerprints, with and without tiles and midpoints: the components are those of all pairs."""
    from ripplet.operators.components import connected_components

    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(tile)
    fps = set()
    for _ in range(25):
        centre = rng.getrandbits(64)
        for _ in range(20):
            f = centre
            for _ in range(rng.randrange(7)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    rows = list(enumerate(sorted(fps)))
    signed = [(f - (1 << 64) if f >> 63 else f, k) for k, f in rows]
    links = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), most_tiles=most)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = brute_components(rows)
    assert {k: got.get(k, k) for k in want} == want


def test_anchors_cover():
    """Any two halves at most two bits apart share an anchor."""
    import numpy as np

    masks = simhash.anchor_masks(2)
    rng = random.Random(6)
    for _ in range(3000):
        x = rng.getrandbits(32)
        y = x ^ (1 << rng.randrange(32)) ^ (rng.randrange(2) << rng.randrange(32))
        spots = []
        for f in (x, y):
            _, cells = simhash.anchors(np.array([f], dtype=np.uint64), masks)
            spots.append({c for c in cells.tolist() if not c >> 32 & 1})
        assert spots[0] & spots[1]
    assert max(map(len, masks)) == 17


def test_packing(spark, odd, odd_rows, none, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.vocabulary_path())
    for table in (odd, docs):
        want = []
        for r in table.collect():
            ids = own.encode(r.text or "", add_special_tokens=False).ids + [2]
            cuts = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids), 1024), len(ids)]
            want += [(r.doc_id, k, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        got = packing.pack(table).collect()
        assert sorted(repr(tuple(r)[:5]) for r in got) == sorted(map(repr, want))
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(bins) <= 1.03 * sum(r.length for r in got) / 1024 + 2
    assert packing.pack(none).count() == 0


def test_packing_of_very_long_white_space(spark):
    """Runs that tiktoken refuses have the ids of the plain coder."""
    encode, plain = packing.fast_encoder(bpe.vocabulary_path()), bpe.coder(bpe.vocabulary_path())
    n = 1_100_000
    for t in ("x" + " " * n + "a", "x" + "\n" * n, "é \u3000" + "\u3000" * n + " b", "a<|endoftext|>" + " " * n + "<|endoftext|>b 1"):
        assert encode(t).tolist() == plain.encode(t)
    got = packing.pack(spark.createDataFrame([(1, "x" + " " * n + "a"), (2, "b")], "doc_id long, text string")).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == n + 2 and sum(r.doc_id == 2 for r in got) == 1


def test_sum_of_squares_against_plain():
    import numpy as np

    rng = random.Random(8)
    sizes = sorted((rng.randrange(1, 33) for _ in range(300)), reverse=True)
    bins, offsets = packing.sum_of_squares(np.array(sizes), 32)
    fill = {}
    for k, size in enumerate(sizes):
        def squares(b, size=size):
            gaps = [32 - f for f in ({**fill, b: fill.get(b, 0) + size}).values() if f < 32]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        open_ = [b for b, f in fill.items() if f < 32 and f + size <= 32]
        b = int(bins[k])
        assert int(offsets[k]) == fill.get(b, 0)
        assert (squares(b) == min(map(squares, open_))) if open_ else b not in fill
        fill[b] = fill.get(b, 0) + size


@pytest.mark.parametrize(("name", "label"), [("op6_toxicity", "toxic"), ("op7_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    import os

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    got = {r.doc_id: r for r in entries.queries()[name](spark, path).collect()}
    labels = [r for r in spark.read.parquet(f"{path}/labels.parquet").collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].predicted == r[label] for r in labels)
    assert len(labels) > 500 and right / len(labels) > 0.96
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_rows(spark, odd, none, module):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    few = spark.createDataFrame([(k * 3 + 1, k % 2, k % 2) for k in range(16)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for labels in (no_labels, few):
        got = module.score(odd, module.fit(odd, labels)).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert module.score(none, module.fit(none, labels)).count() == 0


def test_folds(spark):
    got = spark.range(50).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'t' as text")
    for module, mod, rest in ((toxicity, 3, 1), (quality, 5, 0)):
        empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in module.score(got, module.fit(got, empty)).collect())


def test_restoration(docs):
    restorer = toxicity.Restorer(toxicity.character_counts(docs))
    assert restorer.decode("i d i o t") == "idiot" and restorer.decode("1d10t") == "idiot" and restorer.decode("idiiiot") == "idiot"
    for disguised in ("i-d-1-0-t", "i.d.i.o.t", "1D10T", "idіоt", "і d і о t", "id\u200biot", "ｉｄｉｏｔ", "i_d_i_o_t"):
        assert restorer.restore(f"an {disguised} said") == "an idiot said"
    for plain in ("2024-05-01", "well-known", "and/or", "the!!", "привет мир", "a@b.co", "1,000", "10.0.0.1", ""):
        assert restorer.restore(plain) == plain


def plain_reading(restorer, token):
    """The likeliest of all paths of a token, one by one."""
    found = []

    def go(at, text, cost, a, b):
        if at == len(token):
            found.append((cost + restorer.cost[a, b, 0], text))
            return
        c = token[at]
        run = next(m for m in re.finditer(r"(.)\1*", token, re.S) if m.start() <= at < m.end())
        for read, more, k in toxicity.options(c, min(at - run.start(), 2), len(run[0]) > 2):
            go(at + 1, text + read, cost + more + (restorer.cost[a, b, k] if k >= 0 else 0), *((b, k) if k >= 0 else (a, b)))

    go(0, "", 0.0, 0, 0)
    k = [0, 0, *toxicity.codes(token).tolist(), 0]
    stands = sum(restorer.cost[x, y, z] for x, y, z in zip(k, k[1:], k[2:], strict=False))
    least = min(found)[0]
    return {text for cost, text in found if cost < least + 1e-9} if least + toxicity.DISGUISED < stands else {token}


def test_restoration_against_all_paths(docs):
    restorer = toxicity.Restorer(toxicity.character_counts(docs))
    rng = random.Random(11)
    for _ in range(400):
        token = "".join(rng.choice("aidtos10$!-._й") for _ in range(rng.randrange(1, 8)))
        want = plain_reading(restorer, token) if toxicity._MANY.search(token) and toxicity._LATIN.search(token) else {token}
        assert restorer.decode(token) in want


@pytest.mark.parametrize("run", ["ab", "1", "AKIA"])
def test_restoration_of_very_long_runs(run):
    """A run of 200,000 letters or digits beside a disguised word takes linear time."""
    restorer = toxicity.Restorer(toxicity.np.ones(toxicity.A**3))
    text = run * (200_000 // len(run)) + " 1d10t"
    began = time.monotonic()
    assert restorer.restore(text).startswith(run.lower()) and time.monotonic() - began < 20


def test_restoration_across_parts(docs, monkeypatch):
    """Long segments are read as a whole: runs and letters drawn apart go on over the seams."""
    restorer = toxicity.Restorer(toxicity.character_counts(docs))
    assert restorer.decode("st" + "u" * 71 + "pid") == "stupid" and restorer.restore("a st" + "u" * 1000 + "pid b") == "a stupid b"
    rng = random.Random(7)
    segments = ["".join(rng.choice("idtos1@$.- 0") for _ in range(rng.randrange(65, 200))) for _ in range(40)] + [" ".join("what an idiot you are to say that of others here".replace(" ", ""))]
    got = [restorer.decode(x) for x in segments]
    monkeypatch.setattr(toxicity, "_PART", 10_000)
    assert got == list(map(restorer.decode, segments)) and any("idiot" in x for x in got)


def test_character_counts_cover_every_text(spark):
    two = spark.createDataFrame([(1, "ab"), (2, "ab")], "doc_id long, text string").repartition(2)
    counts = toxicity.character_counts(two)
    size = toxicity.A
    assert counts[(0 * size + 1) * size + 2] == 2 and counts[(1 * size + 2) * size + 0] == 2
    for text in ("a" * 1_200_000, "aé1й " * 300_000):
        counts = toxicity.character_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
        assert counts.sum() == len(text) + 2


def disguise(word, rng):
    """One of the ways in which people hide a word."""
    signs = {"a": "@4а", "e": "3е", "i": "1!і", "o": "0о", "s": "$5ѕ", "t": "7+", "c": "с", "l": "1|", "h": "һ", "m": "м", "r": "г", "u": "υ", "p": "р"}
    match rng.randrange(4):
        case 0:
            return "".join(rng.choice(signs[c]) if c in signs and rng.random() < 0.6 else c for c in word)
        case 1:
            return " ".join(word)
        case 2:
            return rng.choice(".-_*").join(word)
        case _:
            at = rng.randrange(len(word))
            return word[:at] + word[at] * rng.randrange(3, 7) + word[at + 1 :]


def test_restoration_finds_disguised_insults(spark):
    """Of held-out toxic texts whose telling words are all disguised, far more are found with the restored text than with the text as it stands."""
    import os

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{path}/{x}.parquet") for x in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    for plain in ("04dbeb9f3a11c2d4", "sha256:9f86d081884c7d65", "mp3", "r2d2 x64"):  # a model of more text knows digests
        assert model.restorer.restore(plain) == plain
    rng = random.Random(12)
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = [texts[r.doc_id] for r in labels.collect() if r.toxic == 1 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    telling = lambda w: model.odds.strongest(toxicity.features(w.lower().translate(toxicity._ACCENTS))) is not None
    open_, hidden = [], []
    for t in toxic:
        if model.scores([t])[0] >= toxicity.THRESHOLD and t.isascii():
            open_.append(t)
            hidden.append(re.sub(r"[^\W\d_]+", lambda m: disguise(m[0].lower(), rng) if telling(m[0]) else m[0], t))
    restored = model.scores(hidden) >= toxicity.THRESHOLD
    model.restorer.decode = lambda token: token  # as it stands
    model.hits.clear()
    standing = model.scores(hidden) >= toxicity.THRESHOLD
    assert len(open_) > 50 and restored.mean() > 0.9 and standing.mean() < 0.2


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def test_labelled_sample_is_bounded(spark):
    """Repeats count once, bytes are bounded by the number of rows, and a text over the bound is passed over."""
    docs = spark.createDataFrame([(1, "a" * 100)] * 5000 + [(2, "b" * 100), (3, "c" * 5000), (4, None), (5, "d" * 100), (None, "e")], "doc_id long, text string")
    rows = [(k, 1) for k in (1, 2, 3, 4, 5)] + [(1, 1), (6, 1), (None, 1), (2, None)]
    take = lambda n, size: fitting.labelled_sample(docs, labels_of(spark, rows), "toxic", fitting.F.lit(True), {0: n, 1: n}, size)
    texts, counts = take(10, 1 << 20)
    assert sorted(texts[1]) == sorted(["a" * 100, "b" * 100, "c" * 5000, "", "d" * 100]) and texts[0] == [] and counts == {0: 0, 1: 6}
    texts, _ = take(10, 1000)
    assert sorted(texts[1]) == sorted(["a" * 100, "b" * 100, "", "d" * 100])
    texts, _ = take(10, 250)
    assert sum(map(len, texts[1])) <= 250 and len([t for t in texts[1] if t]) == 2
    assert len(take(3, 1 << 20)[0][1]) <= 3


def test_quality_difference_alone(spark):
    """The normalised difference of sizes alone drops nine of ten bad held-out texts and keeps 98 of 100 good ones."""
    import os

    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{path}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = [(model.features([texts[r.doc_id].encode()])[0][0], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = sorted(x for x, y in held if y == 1), [x for x, y in held if y == 0]
    least = good[len(good) // 50]
    assert sum(x < least for x in bad) > 0.9 * len(bad) > 50


def test_quality_features_against_plain():
    """Sizes, piece by piece, by compressing each piece afresh."""
    import zstandard

    rng = random.Random(13)
    words = lambda pool: " ".join(rng.choice(pool) for _ in range(300))
    good, bad = [words(["tree", "river", "stone", "cloud"]) for _ in range(40)], [words(["$$$", "!!", "buy", "|"]) for _ in range(40)]
    model = quality.Classifier({1: good, 0: bad}, {1: 40, 0: 40})
    texts = [*good[:3], *bad[:3], "", "x", "tree " * 5000, "é" * 3000]
    for t, row in zip(texts, model.features([t.encode() for t in texts]), strict=True):
        data, sizes = t.encode(), []
        for y in (0, 1):
            own = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(model.dictionaries[y][0], dict_type=model.dictionaries[y][1]), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(own.compress(data[i : i + 1024])) for i in range(0, len(data), 1024)))
        assert row[0] == pytest.approx(min(max((sizes[0] - sizes[1]) / (len(data) + 1), 0), quality.MOST))
        assert row[1] == pytest.approx(min(max((sizes[0] - sizes[1]) / (sum(sizes) + 1), 0), quality.MOST_OF_SIZES))
    scores = model.scores(texts)
    assert min(scores[:3]) > 0.5 > max(scores[3:6])


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<header><p>Site name here</p></header><div class="cookie-notice"><p>We use cookies on this site to make it work better for you and all others.</p></div>
<article><h1>Head &amp; more</h1><p>First   <b>bold</b> text.<br>Second&nbsp;line<p>Unclosed &lt;tag&gt;<script>var x = "</p>";</script></p>
<form><p>Name please</p></form><aside><p>Related reading is found here today.</p></aside><ul><li>Point one</li><li><a href=x>linked</a> point</li></ul>
<div class="comments"><p>I like this very much, thank you.</p></div></article><footer>&copy; 2024</footer></body></html>"""


def test_html(spark):
    want = "Head & more\n\nFirst bold text. Second line\n\nUnclosed <tag>\n\nPoint one\n\nlinked point"
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (4, "u", PAGE[:400], 1), (5, "u", "<p>" * 20_000 + "x", 1), (None, "u", "<!-- never closed <p>text", 1), (7, "u", PAGE, 1)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    assert got[1].text == got[7].text == want and got[1].n_chars == len(want)
    assert got[2].text == got[3].text == got[None].text == "" and len(got) == 7
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_with_many_unclosed_elements():
    began = time.monotonic()
    assert html.main_text("<article><p>Some words</p>" + "<button>" * 100_000) == "Some words" and time.monotonic() - began < 20


def test_html_closes_elements_at_any_depth():
    body = "<article><h1>Head</h1><p>Some words of the text</p></article>"
    want = "Head\n\nSome words of the text"
    for unclosed in ("<li>Item", "<dt>Item<dd>Item", "<div>Item", "<table><tr><td>Item", "<div><li>Item"):
        assert html.main_text(f"<nav><ul>{unclosed * 200}</ul></nav>{body}") == want
    page = html.blocks(f"<article><p>In</p>{'<section>' * 200}</article><p>Out</p>")
    assert [(b[0], b[3]) for b in page] == [("In", 1), ("Out", 0)]


def test_html_closes_items_and_cells_implicitly():
    hinted = lambda page: {b[0]: b[5] for b in html.blocks(page)}
    assert hinted("<ul><li class=ad>A<li>B<ul><li class=ad>C</ul>D</li><li class=ad><ul><li>E</ul><li>F</ul>") == {"A": 1, "B": 0, "C": 1, "D": 0, "E": 1, "F": 0}
    assert hinted("<table><tr><td class=ad>A<td>B<tr class=ad><td>C<table><tr><td>D</table>E<tr><td>F<tbody class=ad><tr><td>G<tbody><tr><td>H</table>") == {"A": 1, "B": 0, "C": 1, "D": 1, "E": 1, "F": 0, "G": 1, "H": 0}
    assert hinted("<dl><dt class=ad>A<dd>B<dd class=ad><dl><dt>C</dl>D<dt>E</dl>") == {"A": 1, "B": 0, "C": 1, "D": 1, "E": 0}
    assert hinted("<ul><li class=ad>A<ul></li><li>B</ul></li><li>C</ul>") == {"A": 1, "B": 1, "C": 0}


def test_html_with_many_end_tags_takes_linear_time():
    began = time.monotonic()
    for page in ("<div>" * 100_000 + "</section>" * 100_000, "<ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000, "<li>x<table>" * 50_000 + "</li>" * 50_000, "<div><li>" * 50_000 + "</div>" * 50_000):
        html.blocks(page)
    assert time.monotonic() - began < 20


def test_html_hints_of_layout_and_anchors():
    for a, b in (('<div class="layout has-sidebar"><article>', "</article></div>"), ('<div class="sidebar-layout"><article>', "</article></div>"), ('<div class="widget"><main>', "</main></div>"), ("<article>", "</article>")):
        page = f'{a}<h2 id="related-work">Related work</h2><section id="legal-background"><p>Words of law</p></section><section id="related-posts"><p>Read this</p></section><section id="comments"><p>Well said</p></section>{b}'
        assert html.main_text(page) == "Related work\n\nWords of law"
    assert html.main_text('<article>Text</article><div class="related has-image"><article>Other</article></div><div id="sidebar">Side</div>') == "Text"


def test_html_without_article_mark():
    para = "These words make a paragraph that is long enough to look like an article. " * 3
    page = f"<div><a href=1>One</a> <a href=2>Two</a></div><div><p>{para}</p><p>{para}</p></div><div><a>About</a></div>"
    assert html.main_text(page) == "\n\n".join([para.strip()] * 2)


def pages_at(spark, scale):
    import os

    path = f"/root/testdata/{scale}/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    return spark.read.parquet(path)


def test_html_against_plain_cutting(spark):
    """The article element of every page, cut by regular expressions alone."""
    import html as entities

    def plain(page):
        body = "".join(re.findall(r"(?s)<article[^>]*>(.*?)(?:</article>|\Z)", re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", page)))
        parts = re.split(r"</?(?:p|h[1-6]|div|ul|ol|li|blockquote|table|tr|td|th|section|pre|header|footer|nav|aside)\b[^>]*>", body)
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
        return "\n\n".join(x for x in blocks if x)

    pages = pages_at(spark, "sf0.01")
    assert {r.page_id: r.text for r in html.extract(pages).collect()} == {r.page_id: plain(r.html or "") for r in pages.collect()}


def neutral(page):
    """The page with plain containers for all that says what it is, and without classes, ids and roles."""
    page = re.sub(r"(</?)(?:article|main|nav|footer|header|aside)\b", r"\1div", page)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


@pytest.mark.parametrize("strip", ["marks", "classes"])
def test_html_by_words_and_densities(spark, strip):
    """With the article's marks gone, and with all tags and classes that help gone too, words and densities still find it."""
    from collections import Counter

    unmark = (lambda x: re.sub(r"(</?)(?:article|main)\b", r"\1div", x)) if strip == "marks" else neutral
    same = got = want = 0
    for r in pages_at(spark, "sf0.01").collect():
        a, b = Counter(html.main_text(unmark(r.html)).split()), Counter(html.main_text(r.html).split())
        same, got, want = same + (a & b).total(), got + a.total(), want + b.total()
    assert 2 * same / (got + want) >= 0.95


def test_html_neighbours_decide():
    """The same block, kept between paragraphs and dropped between links and a heading."""
    block, para = "<div>Ten words stand here and they say nothing much</div>", f"<p>{'These words make a paragraph. ' * 12}</p>"
    links = "".join(f"<div><a href={k}>Link</a></div>" for k in range(5))
    assert "Ten words" in html.main_text(f"{links}<h1>A heading of the page</h1>{para}{block}{para}{para}")
    assert "Ten words" not in html.main_text(f"{links}{block}<h1>A heading of the page</h1>{para}{para}{para}")
    assert {"link before"} <= {("words", "link", "words before", "link before", "words after", "link after", "heading", "main")[k] for k in splits(html.tree().root)}


def splits(node):
    return {node[0]} | splits(node[2]) | splits(node[3]) if isinstance(node, tuple) else set()


def test_html_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "x", 5, "y", "z")] * 2, "page_id long, url string, html string, text string, n_chars int, doc_id string, words string")
    got = html.extract(rows).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].n_chars == len(got[0].text) > 0


@pytest.mark.parametrize("n", [1, 64, 1_000, 100_000])
def test_html_with_unclosed_elements_before_the_article(n):
    began = time.monotonic()
    for unclosed in ("<li>Item", "<table><tr><td>Item" if n < 100_000 else "<td>Item", "<dd>Item", "<div>Item"):
        assert html.main_text(f"<nav><ul>{unclosed * n}</ul></nav><article><h1>Head</h1><p>Some words</p></article>") == "Head\n\nSome words"
    assert time.monotonic() - began < 60


def secret_base(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    return sorted(
        [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    )


def test_secrets(spark, odd, none, docs):
    rng = random.Random(5)
    parts = ["password", "PassWd", "ſecret", "token", "API_KEY", "apikey", "=", ":", " ", '"', "'", "abcDEF123456_-", "AKIA", "AKIAAKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef", "é", "\n", "x", "é=", "->"]
    noisy = spark.createDataFrame([(k, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 16)))) for k in range(1500)] + [(2000, "token = " * 20_000), (2001, "a = b\n" * 20_000), (2002, "secret" + " " * 50_000)], "doc_id long, text string")
    for table in (noisy, odd, docs):
        texts = [(r.doc_id, r.text or "") for r in table.collect()]
        want = []
        for i, t in texts:
            found = secret_base(t)
            want.append((i, *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(secrets.written(found).encode()).hexdigest()))
        assert sorted(repr(tuple(r)[:5]) for r in secrets.scan(table).collect()) == sorted(map(repr, want))
    assert secrets.scan(none).count() == 0


LITERAL = "Zx8$kQ2!vB7p"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ('k = "Zx8$kQ2!vB7p"\nj = k\ndb_pwd = j\n', ["Zx8$kQ2!vB7p"]),
        ('{"db_password": "hunter2Xk9", "user": "hunter2Xk9"}', ["hunter2Xk9"]),
        ("aws:\n  secret_key: abcDEF123456\n", ["abcDEF123456"]),
        ('base = "s3cr3t-Ab9"\nauth_token = base + "Tail99xyz"\n', ["s3cr3t-Ab9", "Tail99xyz"]),
        *((form % LITERAL, [LITERAL]) for form in (
            'db_pwd: str = "%s"', 'const dbPwd: string = "%s";', 'var password string = "%s"', 'val secret: String = "%s"', 'pwd: Optional[str] = "%s"', 'String apiToken = "%s";',
            'os.environ["DB_PWD"] = "%s"', "$cfg['db']['pass'] = '%s';", 'pwd = \"\"\"%s\"\"\"', "secret = b'%s'", 'pwd = ("%s")', 'pwd = x if y else "%s"', 'pwd = f("%s")', 'password := "%s"',
            '<user name="a" pwd="%s"/>', "<password>%s</password>", '<add key="DbPassword" value="%s" />', "- name: DB_PASSWORD\n  value: '%s'\n", '{"name": "DB_PASSWORD", "value": "%s"}',
            'connect(user="u1234567", password="%s")', 'conn = connect(host="h.example.com",\n   password="%s", port=1)\nx = "Ab9$kQ2!vB7p"', 'api_key = os.getenv("API_KEY_PROD_1", "%s")', 'keys = ["%s", "b"]\npassword = keys[0]',
        )),
        ('api_key = os.environ["API_KEY_PROD_1"]', []),
        ('if password == "Zx8$kQ2!vB7p": pass', []),
        ('password = foo(\n\nother = "Zx8$kQ2!vB7p"', []),
        ('url = "Zx8$kQ2!vB7p"; pwd = other; x = "Q"', []),
        ('password = "changeme"', []),
        ('title = "Zx8$kQ2!vB7p"', []),
        ("The token: is a word of prose, key = value", []),
    ],
)
def test_literals(text, found):
    assert [text[a:b] for a, b, _ in secrets.literal_spans(text)] == found


def test_propagation_against_plain():
    """Random programs: what reaches a sensitive name, by sets of literals that are handed on line by line."""
    rng = random.Random(14)
    wraps = ("%s", "(%s)", "f(%s)", "[%s]", "a if b else %s", "new(1, %s)")
    declares = ("%s = %s", "const %s: string = %s;", "%s := %s", '"%s": %s,', "final String %s = %s;")
    for _ in range(300):
        names = ["alpha", "beta", "gamma", "db_password", "delta", "authToken", "eps"]
        holds, want, lines = {}, set(), []
        for k in range(rng.randrange(1, 25)):
            name, reached, parts = rng.choice(names), set(), []
            for _ in range(rng.randrange(1, 4)):
                if rng.random() < 0.5:
                    literal = f"Q{k}x$" + "".join(rng.choice("abcXYZ0189!") for _ in range(12))
                    reached.add(literal)
                    parts.append(f'"{literal}"')
                else:
                    other = rng.choice(names)
                    reached |= holds.get(other, set())
                    parts.append(other)
            holds[name] = reached
            if name in {"db_password", "authToken"}:
                want |= reached
            lines.append(rng.choice(declares) % (name, rng.choice(wraps) % " + ".join(parts)))
        text = "\n".join(lines)
        assert {text[a:b] for a, b, _ in secrets.literal_spans(text)} == want, text


def test_propagation_is_linear():
    """100,000 chained lines in under 200 MB."""
    import tracemalloc

    n = 100_000
    text = 'x0 = "Zx8$kQ2!vB7p"\n' + "".join(f'x{k + 1} = x{k} + "Ab{k}$kQ2!v"\n' for k in range(n)) + f"password = x{n}\n"
    tracemalloc.start()
    began = time.monotonic()
    found = secrets.literal_spans(text)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == n + 1 and most < 200 << 20 and time.monotonic() - began < 60
    for odd in ("password = (" * 50_000, '"' * 100_001, "<a" * 100_000, "<a>" * 100_000, "(" * 100_000 + 'pwd="', "key = [" * 50_000, "\n" * 100_000):
        began = time.monotonic()
        secrets.spans(odd + " password")
        assert time.monotonic() - began < 20


def test_columns_with_clashing_names_are_left_alone(spark):
    """Every operator with columns beside its own that bear the names of its result."""
    row = (1, "text of a@b.co, token = abcDEF123456ghi", "en", 5, "x", "y", "z", 0.5, True, "w", "v")
    extra = spark.createDataFrame([row, row, (None, None, *row[2:])], "doc_id long, text string, lang string, n_tokens int, spans string, base_sha256 string, fingerprint string, score double, kept boolean, ids string, sequence_id string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outs = [pii.pii_report(extra), secrets.scan(extra), bpe.encode_decode(extra), packing.pack(extra), exact_dedup.exact_dedup(extra), simhash.near_duplicates(extra), fingerprint.fingerprint_edits(extra)]
    outs += [m.score(extra, m.fit(extra, empty)) for m in (toxicity, quality)]
    plain = extra.select("doc_id", "text")
    again = [pii.pii_report(plain), secrets.scan(plain), bpe.encode_decode(plain), packing.pack(plain), exact_dedup.exact_dedup(plain), simhash.near_duplicates(plain), fingerprint.fingerprint_edits(plain)]
    again += [m.score(plain, m.fit(plain, empty)) for m in (toxicity, quality)]
    for a, b in zip(outs, again, strict=True):
        rows = a.collect()
        assert len(rows) == 3 and sorted(map(repr, rows)) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_fingerprint_edits_with_hot_ids(spark, seed):
    """A third of the rows without an id, a third with one id, equal beginnings and equal rows: each row has its next one."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, 5, 5, k]), rng.choice(["", "same beginning " * 6, chr(97 + k % 26)]) + str(rng.randrange(30))) for k in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = fingerprint.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        edited = t[: len(t) - len(t) // 2] + rows[(k + 1) % len(rows)][1][: len(t) // 2]
        want.append((i, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(map(repr, ((r.doc_id, r.edited_sha256) for r in got))) == sorted(map(repr, want))


def plain_digest(data):
    """The digest by its definition, one triplet at a time."""
    import math

    mask, counts = 0xFFFFFFFF, [0] * 128
    for a, b, c, d in zip(data, data[1:], data[2:], data[3:], strict=False):
        for salt, mixed in ((1, a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0x27D4EB2F), (2, a * 0x9E3779B1 + b * 0x85EBCA77 + d * 0x165667B1), (3, a * 0x9E3779B1 + c * 0xC2B2AE3D + d * 0xD3A2646D)):
            x = mixed & mask
            counts[((x ^ x >> 15 ^ salt * 0x632BE5AB & mask) * 0x2C1B3C6D & mask) >> 25] += 1
    q = sorted(counts)
    q1, q2, q3 = q[31], q[63], q[95]
    quarters = [(n > q1) + (n > q2) + (n > q3) for n in counts]
    body = "".join(f"{quarters[k] << 6 | quarters[k + 1] << 4 | quarters[k + 2] << 2 | quarters[k + 3]:02x}" for k in range(0, 128, 4))
    ratio = (q1 * 15 // q3) << 4 | q2 * 15 // q3 if q3 else 0
    return f"{min(255, round(12 * math.log1p(len(data)))):02x}{ratio:02x}{body}"


def plain_likeness(a, b):
    apart = 0
    for k in range(4, 68, 2):
        x, y = int(a[k : k + 2], 16), int(b[k : k + 2], 16)
        apart += sum((0, 1, 3, 6)[abs((x >> s & 3) - (y >> s & 3))] for s in (0, 2, 4, 6))
    apart += max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1) + max(0, abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16)) - 1)
    return 1 - min(176, apart if apart <= 160 else 160 + 0.04 * (apart - 160)) / 176 if a != b else 1.0


def test_digests_against_plain(docs):
    texts = [(r.text or "")[:4000].encode() for r in docs.collect()[:60]] + [b"", b"a", b"abc", b"abcd", bytes(range(256)) * 3]
    digests = [fingerprint.digest(t) for t in texts]
    assert digests == list(map(plain_digest, texts))
    for a, b in zip(digests, digests[1:], strict=False):
        assert fingerprint.likeness(a, b) == pytest.approx(plain_likeness(a, b))


def test_exact_dedup_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a", 1, "x", "p"), (2, "a", 2, "y", "q"), (2, "a", 2, "y", "q"), (2, "b", 3, "z", "r")], "doc_id long, text string, _lost_id int, _own_sha string, own_sha string")
    for rows in (docs, docs.where("_lost_id <> 3").dropDuplicates()):
        kept = exact_dedup.keep_one(rows)
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == [(1, "a", 1, "x", "p"), *([(2, "b", 3, "z", "r")] if rows is docs else [])]


def test_exact_dedup_with_history_without_ids(spark):
    """Rows of the history without an id count; a text that only such rows hold stays where its smallest new id is."""
    old = spark.createDataFrame([(1, "a"), (None, "a"), (None, "b"), (None, "c"), (50, "e"), (None, None)], "doc_id long, text string")
    new = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (None, "c"), (13, "d"), (14, "e"), (15, "")], "doc_id long, text string")
    got = sorted(map(repr, ((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(new, old).collect())))
    assert got == sorted(map(repr, [(10, 1, 3, False), (11, 11, 3, True), (12, 11, 3, False), (None, None, 2, False), (13, 13, 1, True), (14, 50, 2, False), (15, 15, 2, True)]))


def test_simhash_links_pass_through_rows_without_ids(spark, monkeypatch):
    """Two rows that are linked only by way of a row without an id are one component; repeats of an id and rows without one leave one row."""
    bits = {"a": 0, "m": 0b111, "b": 0b111111, "far": (1 << 40) - 1}
    make = lambda rows: spark.createDataFrame([(i, bits[t], t) for i, t in rows], "doc_id long, fp long, text string")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, words=4: docs.select("doc_id", "fp"))
    monkeypatch.setattr(simhash, "with_fingerprints", lambda docs, name, words=4: docs.withColumn(name, simhash.F.col("fp")))
    rows = [(1, "a"), (2, "b"), (None, "m"), (3, "far")]
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(make(rows)).collect()} == {1: 1, 2: 1, None: 1, 3: 3}
    assert sorted(r.doc_id for r in simhash.keep_one(make(rows)).collect()) == [1, 3]
    assert sorted(r.doc_id for r in simhash.keep_one(make([(1, "a"), (2, "b"), (4, "m"), (3, "far")])).collect()) == [1, 3]
    for rows, want in (([(7, "a")] * 3, [(7, "a")]), ([(None, "a"), (None, "m")], [(None, "a")]), ([(7, "a"), (7, "m"), (8, "far")], [(7, "a"), (8, "far")]), ([(7, "a"), (7, "far"), (5, "m")], [(5, "m"), (7, "far")])):
        assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(make(rows)).collect()), key=repr) == sorted(want, key=repr)


def test_packing_deals_equal_rows_to_all_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    rows = packing.pack(spark.createDataFrame([(1, "same words")] * 2000, "doc_id long, text string")).collect()
    groups = {}
    for r in rows:
        groups[r.sequence_id >> 32] = groups.get(r.sequence_id >> 32, 0) + 1
    assert len(rows) == 2000 and len(groups) == 20 and max(groups.values()) < 200


def test_memory_is_bounded():
    from ripplet.llm.common import Memory

    known = Memory(str.upper, 3, 5)
    assert [known[x] for x in ("a", "b", "c", "toolong", "d")] == ["A", "B", "C", "TOOLONG", "D"] and set(known) == {"d"}


def test_pii_scores(spark):
    row = pii.pii_report(spark.createDataFrame([(1, "mail: a@b.de 10.0.0.1"), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (row[0].spans, row[0].scores) == ("email:6:12,ip:13:21", "1.00,0.80") and (row[1].spans, row[1].scores) == ("", "")


def test_online_sum_of_squares_against_plain():
    """Weighing a new bin each time, as the plain rule has it."""
    import numpy as np

    rng = random.Random(18)
    sizes = [rng.randrange(1, 33) for _ in range(250)]
    bins, _ = packing.sum_of_squares(np.array(sizes), 32, online=True)
    fill = {}
    for k, size in enumerate(sizes):
        def squares(b, size=size):
            gaps = [32 - f for f in ({**fill, b: fill.get(b, 0) + size}).values() if f < 32]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        choices = [b for b, f in fill.items() if f < 32 and f + size <= 32] + [max(fill, default=-1) + 1]
        assert squares(int(bins[k])) == min(map(squares, choices))
        fill[int(bins[k])] = fill.get(int(bins[k]), 0) + size
    assert len(set(bins.tolist())) >= len(set(packing.sum_of_squares(np.array(sorted(sizes, reverse=True)), 32)[0].tolist()))


def test_edited_texts_are_likelier_than_strangers(spark):
    """Over all documents, the edited text is liker than the next document is, but for few."""
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    rows = fingerprint.fingerprint_edits(spark.read.parquet(path)).collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.99 * len(rows) > 900
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))


def test_doubled_letters_stay(spark):
    """On the given documents fewer than 1 in 10,000 tokens of letters without a longer run are read with other letters."""
    import os

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    texts = spark.read.parquet(path)
    restorer = toxicity.Restorer(toxicity.character_counts(texts))
    tokens = [x for r in texts.select("text").collect() for x in restorer.tokens(r.text or "") if re.fullmatch(r"[^\W\d_]+", x) and not re.search(r"(.)\1\1", x)]
    assert len(tokens) > 100_000 and sum(restorer.decode(x) != x for x in tokens) < len(tokens) / 10_000
    for word in ("erre", "coffee", "kopplung", "ää", "hello"):
        assert restorer.decode(word) == word
