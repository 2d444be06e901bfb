"""BPE, fingerprints, SimHash groups and packing against the library and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bomweave.llm import bpe, fingerprints, packing, queries, simhash_dedup

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = bpe.Encoder(bpe.read_tokenizer(PATH))
QUICK = bpe.LibraryEncoder(bpe.read_tokenizer(PATH))
ODD = [None, "", "  \n\t ", "a", "A b", "<|endoftext|>x<|END", "don't''s x²3 É", "\x1c\x85 中文 𝒜", "word " * 3000, "a" * 5000, "same text here now", "same text here now"]


def documents(spark, rows, extra=""):
    """Rows (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, "x", 2, "y") for i, t in rows], "doc_id long, text string, id int, decoded string, bucket int, row string")


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdest 'sreIİé.,!\n\t<|endoftext|>ß\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_equals_library(text):
    own = np.frombuffer(OWN.encode(text), np.int32).tolist()
    assert own == ids(text) == np.frombuffer(QUICK.encode(text), np.int32).tolist()
    assert OWN.decode(own) == LIBRARY.decode(own, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 3000, "é" * 1500, "ndbthe" * 500, "".join(random.Random(1).choices("ethanrs", k=2000))])
def test_bpe_long_fragments(text):
    assert np.frombuffer(OWN.encode(text), np.int32).tolist() == ids(text)


def test_forced_boundaries():
    assert all(pair not in OWN.inner for pair in [("q", "z")]) or OWN.fragments([*"aqza"]) == [["a", "q", "z", "a"]]
    cut = OWN.fragments([*"thexqzjthe"])
    assert sum(cut, []) == [*"thexqzjthe"] and len(cut) > 1
    for part, after in zip(cut, cut[1:], strict=False):
        pair = part[-1] + after[0]
        assert not any(pair in t.removesuffix("</w>") for t in OWN.vocabulary if not t.endswith(pair + "</w>"))


def test_op1(spark, small):
    found = {r.doc_id: r for r in queries.op1_bpe(spark, small).collect()}
    for row in pq.read_table(f"{small}/documents.parquet").to_pylist():
        own = ids(row["text"] or "")
        r = found.pop(row["doc_id"])
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(own, skip_special_tokens=False).encode()).hexdigest()
    assert not found


def test_bpe_cases(spark):
    rows = [*enumerate(ODD), (None, "null id"), (3, "again"), (3, "again")]
    out = bpe.encode_decode(documents(spark, rows), PATH).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == Counter((i, tuple(ids(t or ""))) for i, t in rows)
    assert bpe.encode_decode(documents(spark, []), PATH).count() == 0


def simhash128(text):
    own = (text or "").lower().split()
    votes, total = np.zeros((2, 64)), 0
    for i, x in enumerate(own):
        w = min(fingerprints.MAX_WEIGHT, len(x) + (len(own[i + 1]) if i + 1 < len(own) else 0))
        for k in range(2):
            h = 42
            for part in [x, *own[i + 1 : i + 2], *["b"] * k]:
                h = xxhash.xxh64_intdigest(part.encode(), h)
            votes[k] += w * np.array([h >> b & 1 for b in range(64)])
        total += w
    return "".join(f"{sum(1 << b for b in range(64) if 2 * v[b] > total):016x}" for v in votes)


def edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + n[:half], n))
    return out


@pytest.mark.parametrize("per_partition", [1, 4])
@pytest.mark.parametrize("case", ["plain", "null ids", "one", "only nulls", "repeated"])
def test_edited_texts(spark, case, per_partition):
    texts = ["alpha beta gamma", "é ü ö", None, "", "one", "x y z " * 50, "alpha beta gamma"] * 5
    rows = {"plain": [*enumerate(texts)], "null ids": [*enumerate(texts), (None, "nu ll"), (None, "zz top")], "one": [(7, "just one")], "only nulls": [(None, "a b c d"), (None, "b")], "repeated": [(i % 9, f"{i} text {i % 4}") for i in range(30)]}[case]
    out = fingerprints.beside_edited(documents(spark, rows), per_partition=per_partition).collect()
    want = Counter((i, len(t), hashlib.sha256(e.encode()).hexdigest(), simhash128(t), simhash128(e), simhash128(n)) for i, t, e, n in edited(rows))
    text = lambda hi, lo: f"{hi % (1 << 64):016x}{lo % (1 << 64):016x}"
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, text(r.f_hi, r.f_lo), text(r.e_hi, r.e_lo), text(r.n_hi, r.n_lo)) for r in out) == want


def test_op2(spark, small):
    out = {r.doc_id: r for r in queries.op2_fingerprints(spark, small).collect()}
    own = {i: int(r.fingerprint, 16) for i, r in out.items()}
    following = dict(zip(sorted(own, reverse=True), [*sorted(own, reverse=True)[1:], max(own)], strict=True))

    def like(a, b):
        return 1 if a == b else 0 if 0 in (a, b) else max(0, np.cos(np.pi * (a ^ b).bit_count() / 128))

    for i, r in out.items():
        assert r.near_edited == pytest.approx(like(own[i], int(r.edited_fingerprint, 16))) and r.near_next == pytest.approx(like(own[i], own[following[i]]))
        assert r.n_near == (None if i % 50 else sum((x ^ own[i]).bit_count() <= fingerprints.RADIUS for x in own.values()) - 1)
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    for i, t, e, n in edited(rows):
        r = out.pop(i)
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.n_chars == len(t)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 and (t != n or r.near_next == 1)
    assert not out
    assert fingerprints.beside_edited(documents(spark, [])).count() == 0


def test_block_tables_find_all(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, (12, 2))
    rows = []
    for i in range(300):
        hi, lo = (int(x) for x in base[rng.integers(12)])
        for bit in rng.integers(0, 128, rng.integers(0, 4)).tolist():
            if bit < 64:
                lo = (lo ^ (1 << bit)) % (1 << 64)
            else:
                hi = (hi ^ (1 << bit - 64)) % (1 << 64)
        wrap = lambda x: (x + 2**63) % 2**64 - 2**63
        rows.append((i, wrap(hi), wrap(lo)))
    table = spark.createDataFrame(rows, "id long, hi long, lo long")
    apart = lambda a, b: sum((x ^ y) % (1 << 64) != 0 and bin((x ^ y) % (1 << 64)).count("1") for x, y in zip(a[1:], b[1:], strict=True))
    want = {(a[0], b[0]): apart(a, b) for a in rows[::10] for b in rows if apart(a, b) <= 3}
    for extra in (1, 2):
        found = fingerprints.within(table.where("id % 10 = 0"), table, 3, extra).collect()
        assert {(r.q, r.t): r.apart for r in found} == want and len(found) == len(want)


def test_near_rows_of_hot_blocks(spark):
    """Groups of near copies that share blocks, with more queries in a block than a share takes, and repeated fingerprints."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(1500):
        x = int(rng.integers(3)) << 100 | 12345
        for bit in rng.integers(0, 128, rng.integers(0, 5)).tolist():
            x ^= 1 << bit
        rows.append((i, *((h + 2**63) % 2**64 - 2**63 for h in (x >> 64, x & (1 << 64) - 1)), x))
    table = spark.createDataFrame([r[:3] for r in rows], "id long, hi long, lo long")
    asked = table.where("id % 5 = 0")
    got = {(r.hi, r.lo): r.n for r in fingerprints.count_within(asked, table).collect()}
    assert got == {r[1:3]: sum((r[3] ^ o[3]).bit_count() <= fingerprints.RADIUS for o in rows) for r in rows[::5]}
    assert fingerprints.count_within(asked.limit(0), table).count() == fingerprints.count_within(asked, table.limit(0)).count() == 0


def groups(points, radius):
    """Component of each of the distinct points, by comparing all pairs."""
    label = list(range(len(points)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= radius) + i + 1:
            label[root(int(j))] = root(i)
    return [root(i) for i in range(len(points))]


def as_sets(labels):
    out = defaultdict(set)
    for i, x in enumerate(labels):
        out[x].add(i)
    return sorted(map(sorted, out.values()))


def clustered(rng, n, centres, flips):
    p = rng.integers(0, 1 << 63, centres, dtype=np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        p = p ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    return np.unique(p)


@pytest.mark.parametrize("seed", range(8))
def test_vantage_point_links(seed):
    rng = np.random.default_rng(seed)
    p = clustered(rng, int(rng.integers(1, 2500)), int(rng.integers(1, 30)), int(rng.integers(1, 10)))
    rng.shuffle(p)
    assert as_sets(simhash_dedup.link(p, 4).tolist()) == as_sets(groups(p, 4))


@pytest.mark.parametrize("limit", [8192, 40])
def test_components_of_points(spark, limit):
    rng = np.random.default_rng(limit)
    p = np.concatenate([clustered(rng, 600, 3, 5), clustered(rng, 600, 500, 3)])
    points = spark.createDataFrame([(int(x),) for x in np.unique(p).view(np.int64)], "fp long")
    roots = {r.node: r.root for r in simhash_dedup.components(simhash_dedup.edges(points, 4, limit)).collect()}
    own = np.unique(p)
    assert as_sets([roots.get(x, x) for x in own.view(np.int64).tolist()]) == as_sets(groups(own, 4))


@pytest.mark.parametrize("points", [10, 10**8, 10**11])
def test_blocks_cover_every_pair(points):
    masks = simhash_dedup.combinations_of_blocks(points, 4)
    rng = random.Random(points)
    for _ in range(300):
        apart = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not apart & m for m in masks)


def simhash64(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    shingles = [b" ".join(own[i : i + 4]) for i in range(max(1, len(own) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_groups(rows, out):
    own = [simhash64(t) for _, t in rows]
    points = sorted(set(own))
    label = dict(zip(points, groups(np.array(points, np.uint64), 4), strict=True))
    least = {}
    for (i, _), fp in zip(rows, own, strict=True):
        if i is not None:
            least[label[fp]] = min(i, least.get(label[fp], i))
    assert Counter(out) == Counter((i, fp, least.get(label[fp])) for (i, _), fp in zip(rows, own, strict=True))


def test_op6(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    check_groups(rows, [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in queries.op6_simhash_dedup(spark, small).collect()])


def test_simhash_cases(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(4)]
    rows = [*enumerate(ODD), (None, "null id alone in its group"), (None, ODD[-1]), (3, "again"), (3, "again")]
    rows += [(100 + k, base[k % 4].replace(f"w{k} ", "changed ", 1)) for k in range(40)]
    out = simhash_dedup.near_groups(documents(spark, rows))
    check_groups(rows, [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in out.collect()])
    kept = simhash_dedup.one_of_each(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    ids_kept = [r.doc_id for r in kept.collect()]
    first = {r.component_id for r in out.collect()} - {None}
    assert sorted(i for i in ids_kept if i is not None) == sorted(first) and ids_kept.count(None) == 2
    assert simhash_dedup.near_groups(documents(spark, [])).count() == 0


def pack_one_by_one(lengths, size):
    left, bins = sorted(lengths), []
    while left:
        gap, own = size, []
        while fit := [x for x in left if x <= gap]:
            left.remove(fit[-1])
            own.append(fit[-1])
            gap -= fit[-1]
        if gap and len(own) > 1:
            two = max(((a + b, a) for i, a in enumerate(left) for b in left[:i] if a + b <= gap + own[-1]), default=(0, 0))
            if two[0] > own[-1]:
                left.append(own.pop())
                for x in (two[1], two[0] - two[1]):
                    left.remove(x)
                    own.append(x)
                left.sort()
        bins.append(tuple(sorted(own, reverse=True)))
    return Counter(bins)


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 60), st.data())
def test_packing_by_counts_equals_piece_by_piece(size, data):
    lengths = data.draw(st.lists(st.integers(1, size), max_size=40))
    own = Counter()
    for lengths_of_bin, times in packing.LengthPacker(Counter(lengths), size).bins():
        own[tuple(lengths_of_bin)] += times
    assert own == pack_one_by_one(lengths, size)


def check_packing(rows, out, size):
    want = Counter()
    for i, t in rows:
        own = [*ids(t or ""), 0]
        for k, at in enumerate(range(0, len(own), size)):
            part = own[at : at + size]
            want[i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(n for _, n in parts) <= size
    assert len(by) == sum(pack_one_by_one([r.length for r in out], size).values())


def test_op7(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    check_packing(rows, queries.op7_packing(spark, small).collect(), 2048)


def test_packing_cases(spark):
    rows = [*enumerate(ODD), (None, "null id"), (3, "again"), (3, "again")]
    check_packing(rows, packing.pack(documents(spark, rows), PATH, 64).collect(), 64)
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_words_are_encoded_alike_when_the_store_runs_over(monkeypatch):
    """A store of a few words: halves change all the time, and no id may change with them."""
    source = bpe.read_tokenizer(PATH)
    texts = ["the cat's hat, a cat. 42x x42! don't \x00\x7f (a)b", "naïve Ünïcode café, \u4e2d\u6587 word word. " * 3, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4, "", " \t", "x" * 3000 + "."]
    for kept in (0, 800, 4000, 1 << 20):
        monkeypatch.setattr(bpe, "KEPT_BYTES", kept)
        for kind in (bpe.Encoder, bpe.LibraryEncoder):
            own = kind(source)
            for text in texts * 2:
                assert np.frombuffer(own.encode(text), np.int32).tolist() == ids(text)
            assert own.held <= max(kept // 2, bpe.KEPT_ENTRY * 400)
