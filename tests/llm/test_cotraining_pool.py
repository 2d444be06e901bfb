"""Co-training exchanges labels over every unlabelled document."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from bomweave.llm import cotraining, linear


def test_pool_is_every_unlabelled_document(spark):
    rng = random.Random(12)

    def row(i):
        good = i % 2
        words = rng.choices(["alpha", "beta", "gamma", "delta"] if good else ["%%", "&&", "##", "alpha"], k=rng.randint(8, 40))
        text = " ".join(words)
        return (text, rng.choice(["en", "de"]), rng.choice(["s1", "s2"] if good else ["s2", "s3"]), len(text))

    labelled, pool = [row(i) for i in range(80)], [row(i) for i in range(2_400)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(labelled + pool)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    model = cotraining.learn(docs, labels, F.lit(True))
    order = [i for label in (0, 1) for i in sorted(range(80)) if i % 2 == label]
    part = lambda keep: ([labelled[i] for i in order if keep(i)], np.array([float(i % 2) for i in order if keep(i)]))
    want = cotraining.CoTrained(*part(lambda i: i % 8 < 6), pool, *part(lambda i: i % 8 >= 6))
    assert model.exchanged == want.exchanged > 0
    for own, view in zip(model.views, want.views, strict=True):  # calibrated scores saturate and tell pools apart too little
        assert np.allclose(own.logits(pool), view.logits(pool), rtol=1e-4, atol=1e-4)


def test_a_rare_label_is_drawn(spark, monkeypatch):
    """A label of one in a hundred is learned from and calibrated on, and the scores keep its share."""
    monkeypatch.setattr(cotraining, "MAX_LABEL", 40)
    rng = random.Random(3)
    text = lambda good: " ".join(rng.choices(["alpha", "beta", "gamma", "delta"] if good else ["bad", "worse", "alpha"], k=20))
    rows = [(i, text(i % 100 > 0), "en", "s", 100) for i in range(4000)]
    docs = spark.createDataFrame([*rows, *[(7, "again", "en", "s", 5)] * 50], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 100 > 0)) for i in range(4000)], "doc_id long, quality int")
    scored = cotraining.score(docs, cotraining.learn(docs, labels, F.lit(True))).toPandas()
    good = scored.doc_id % 100 > 0
    assert scored.score[good].mean() > 0.97 and scored.score[~good].max() < scored.score[good].quantile(0.05) and scored.score[~good].mean() < 0.5
    assert cotraining.score(docs.limit(0), cotraining.learn(docs, labels, F.lit(True))).count() == 0


def test_word_model_against_brute_force():
    """Log-count ratios, and a logit that is the sum over the words that a text has."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh" if i % 3 else "ghijklmn", k=12)) for i in range(120)]
    y = np.array([float(i % 3 > 0) for i in range(120)])
    model = linear.WordModel().fit(texts, y)
    for t in texts + [None, "", "unknown words"]:
        assert np.isclose(model.logit(t), model.intercept + sum(model.weights.get(w, 0) for w in set((t or "").split())))
    # at the optimum of the penalized loss its gradient is near 0, by finite differences over the ratios' coefficients
    own = [set(t.split()) for t in texts]
    ratio = {w: np.log((sum(w in s for s, k in zip(own, y, strict=True) if k) + 1) / (y.sum() + 2)) - np.log((sum(w in s for s, k in zip(own, y, strict=True) if not k) + 1) / (len(y) - y.sum() + 2)) for w in model.weights}
    names = sorted(model.weights)
    x = np.array([[ratio[w] * (w in s) for w in names] for s in own])
    v = np.array([model.weights[w] / ratio[w] if ratio[w] else 0 for w in names])
    p = 1 / (1 + np.exp(-(x @ v + model.intercept)))
    assert np.abs(x.T @ (p - y) + v).max() < 0.5 and abs((p - y).sum()) < 0.5
