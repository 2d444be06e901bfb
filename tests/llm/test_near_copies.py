"""Near copies by exact similarity of 5-word shingles, against brute force."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from bomweave.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingled(text):
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def brute_force(rows):
    """The ids that stay, by comparing all pairs."""
    sets = [shingled(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return sorted(min(r[0] for r, x in zip(rows, label, strict=True) if x == own) for own in set(label))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [None, "", " ", "a b", "A  b", "a b c", "a b c d e f"]
    for n in (60, 90, 200, 400) * 6:
        base = rng.choices(vocabulary, k=n)
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):  # edits of edits: chains, and similarities on both sides of 0.8
            base = [*base]
            for _ in range(rng.randint(1, max(1, n // 40))):
                base[rng.randrange(n)] = rng.choice(vocabulary)
            rows.append(" ".join(base))
    passage = rng.choices(vocabulary, k=100)  # candidates that are no near copies
    rows += [" ".join(passage + rng.choices(vocabulary, k=60)) for _ in range(30)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_stage_equals_brute_force(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == brute_force(rows)


def test_stage_in_blocks_equals_brute_force(spark, monkeypatch):
    """Bands that are cut into blocks, of points and of shingles."""
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    for points, shingles in ((3, 10**6), (10**6, 500)):
        monkeypatch.setattr(near_copies, "BLOCK_POINTS", points)
        monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", shingles)
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == brute_force(rows)


def test_unite_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        base = rng.integers(0, 1 << 60, (3, 40), np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base[rng.integers(3)], rng.integers(20, 40), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 6), np.uint64)])) for _ in range(n)]
        roots = rng.integers(0, n, n)
        label = {int(r): int(r) for r in roots}

        def top(x, label=label):
            while label[x] != x:
                x = label[x]
            return x

        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                    label[top(int(roots[i]))] = top(int(roots[j]))
        want = {(i, j) for i in range(n) for j in range(n) if top(int(roots[i])) == top(int(roots[j]))}
        found = near_copies.unite(roots, sets, 0.8)
        own = {int(r): int(r) for r in roots}
        for i, j in found:
            a, b = top(int(roots[i]), own), top(int(roots[j]), own)
            assert a != b
            own[a] = b
        assert {(i, j) for i in range(n) for j in range(n) if top(int(roots[i]), own) == top(int(roots[j]), own)} == want


def test_stage_cases(spark):
    long = " ".join(f"w{i}" for i in range(100))
    docs = [(None, long), (4, long + " x"), (4, "other words of the same id"), (9, long), (2, None), (3, "")]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(docs), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, long), (2, ""), (4, "other words of the same id")]
    assert corpus_pipeline.drop_near_duplicates(spark, frame([]), "").count() == 0


def test_simhash_takes_part(spark, monkeypatch):
    """The operator's fingerprints and trees give candidates of their own: with no bands at all, close copies are still found."""
    rng = random.Random(4)
    base = rng.choices([f"w{i}" for i in range(500)], k=3000)
    rows = [(0, " ".join(base)), (1, " ".join([*base, "x"])), (2, " ".join(["y", *base])), (3, " ".join(rng.choices(base, k=3000))), (4, "")]
    real = near_copies.signature
    monkeypatch.setattr(near_copies, "signature", lambda own: (real(own)[0], []))
    points = spark.createDataFrame(rows, "doc_id long, text string")
    marked = near_copies.marked(points).localCheckpoint()
    pairs = near_copies.simhash_pairs(marked.withColumnRenamed("n", "size")).collect()
    names = {r.key: r.id for r in marked.collect()}
    assert {names[x] for p in pairs for x in (p.a, p.b)} == {0, 1, 2} and len(set(map(tuple, pairs))) == 2
