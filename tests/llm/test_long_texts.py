"""Each operator on one text of over 4 MB, more than an Arrow batch holds, beside short, empty and null ones."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from bomweave.llm import bpe, cotraining, fingerprints, language_id, linear, near_copies, packing, quality_rules, simhash_dedup, toxicity, url_filter, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(random.Random(1).choices(["river", "stone", "and", "the", "Wörter", "x1,", "cloud\n"], k=850_000))
TEXTS = [LONG, "the river and the stone", "", None, LONG + " end"]


@pytest.fixture(scope="module")
def docs(spark):
    """The long texts are made in the plan, so that no message holds them."""
    rows = spark.createDataFrame([(i, t if t is None or len(t) < 100 else None, i in (0, 4), " end" if i == 4 else "") for i, t in enumerate(TEXTS)], "doc_id long, t string, long boolean, tail string")
    shared = spark.sparkContext.broadcast(LONG)

    @F.udf("string")
    def text(short, long, tail):
        return shared.value + tail if long else short

    out = rows.select("doc_id", text("t", "long", "tail").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    from bomweave.llm.common import materialize

    return materialize(out, "long-texts")


def by_id(df, *columns):
    return {r[0]: r[1] if len(columns) == 1 else tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def test_bpe_and_packing(docs):
    assert len(LONG.encode()) > 4 << 20
    library = Tokenizer.from_file(PATH)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    found = by_id(bpe.encode_decode(docs, PATH).withColumn("same", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256)), "same")
    assert found == {i: hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for i, x in ids.items()}
    packed = packing.pack(docs, PATH).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed} == {i: len(x) + 1 for i, x in ids.items()}


def test_fingerprints_and_groups(docs):
    n = by_id(fingerprints.beside_edited(docs), "n_chars", "edited_sha256")
    assert {i: x[0] for i, x in n.items()} == {i: len(t or "") for i, t in enumerate(TEXTS)}
    half = len(TEXTS[4]) // 2  # the last in ids has the first id's text after it: here that of null
    assert n[4][1] == hashlib.sha256((TEXTS[4][: len(TEXTS[4]) - half]).encode()).hexdigest()
    fp = by_id(simhash_dedup.near_groups(docs), "fp", "component_id")
    assert {i: x[0] % (1 << 64) for i, x in fp.items()} == {i: simhash_dedup.fingerprint(None if t is None else t.encode(), 4) for i, t in enumerate(TEXTS)}
    assert fp[4][1] == 0 and by_id(near_copies.near_groups(docs), "component_id") == {0: 0, 1: 1, 2: 2, 3: 2, 4: 0}


def test_rules_and_classifiers(docs):
    measured = {r._other0: r for r in quality_rules.measured(docs, F.col("text"), F.col("doc_id")).collect()}
    assert measured[0].n_words == len(LONG.split()) and measured[0].word_chars == sum(map(len, LONG.split())) and measured[4].n_words == measured[0].n_words + 1
    profiles = language_id.learn(docs, F.lit(True))
    trigrams = language_id.Trigrams()
    langs = by_id(language_id.predict(docs, profiles), "lang_pred", "score")
    for i, (lang, score) in langs.items():
        want, cosine = profiles.predict([TEXTS[i]], trigrams)
        assert lang == want[0] and score == pytest.approx(cosine[0], abs=1e-4)
    model = linear.GramModel((3, 4), True).fit(["nasty words here"] * 5 + ["the river and the stone"] * 5, np.array([1.0] * 5 + [0.0] * 5))
    scores = by_id(toxicity.score(docs, model), "score")
    assert scores[0] == pytest.approx(float(linear.sigmoid(model.logit(LONG)))) and len(scores) == 5
    two = cotraining.CoTrained.of([([(t, "en", "s", 1) for t in ["bad worse"] * 6 + ["river stone"] * 6], np.array([0.0] * 6 + [1.0] * 6), np.ones(12))] * 2, [("river stone", "en", "s", 1), ("bad", "en", "s", 1)], np.array([1.0, 0.0]), np.ones(2))
    kept = by_id(cotraining.score(docs, two), "score")
    assert kept[0] == pytest.approx(float(two.scores([(LONG, "en", "s", 1)])[0, 2])) and len(kept) == 5


def test_pages(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/"), F.coalesce("text", F.lit(""))).alias("url"), F.col("text").alias("html"))
    back = {r.page: r for r in warc.round_trip(pages.withColumn("url", F.lit("u"))).collect()}
    assert {i: r.digest for i, r in back.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(TEXTS)} and not any(r.problem for r in back.values())
    judged = url_filter.judge(pages, url_filter.rule_table(pages.sparkSession, [("net", "/", "block")])).select("page_id", F.length("path").alias("n"), "verdict").collect()
    assert {r.page_id: (r.n, r.verdict) for r in judged} == {i: (len(t or "") + 1, "block") for i, t in enumerate(TEXTS)}
