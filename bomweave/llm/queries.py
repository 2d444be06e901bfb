"""The queries of this subpackage and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomweave.llm import bpe, cotraining, fingerprints, language_id, packing, quality_rules, simhash_dedup, toxicity, url_filter, warc
from bomweave.llm.common import materialize, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = bpe.encode_decode(table(spark, sf_dir, "documents"), TOKENIZER)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return own.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: of the queries, rows whose id is divisible by 50, how many other rows have a fingerprint within RADIUS bits."""
    own = materialize(fingerprints.beside_edited(table(spark, sf_dir, "documents")), "beside-edited")
    own = fingerprints.with_near_rows(own, F.col("doc_id") % 50 == 0)
    f, e, n = ((F.col(f"{x}_hi"), F.col(f"{x}_lo")) for x in "fen")
    return own.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_text(*f).alias("fingerprint"), fingerprints.as_text(*e).alias("edited_fingerprint"),
        fingerprints.likeness(f, e).alias("near_edited"), fingerprints.likeness(f, n).alias("near_next"), "n_near",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = warc.round_trip(table(spark, sf_dir, "pages"))
    return own.select(F.col("page").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


#: host, path, verdict
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.learn(docs, table(spark, sf_dir, "labels"), language_id.may_learn("id"))
    return cotraining.score(docs, model).withColumn("held_out", ~F.coalesce(language_id.may_learn(), F.lit(False)))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = simhash_dedup.near_groups(table(spark, sf_dir, "documents"))
    return own.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = quality_rules.judge(table(spark, sf_dir, "documents"), F.col("doc_id"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return own.select(F.col("_other0").alias("doc_id"), *counts, "base_failed", "kept")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = language_id.predict(docs, language_id.learn(docs, language_id.may_learn()))
    return own.select("doc_id", (~F.coalesce(language_id.may_learn(), F.lit(False))).alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda c: language_id.may_learn(c, 4, 2)
    own = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), fold("id")))
    return own.select("doc_id", (~F.coalesce(fold("doc_id"), F.lit(False))).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_fingerprints, op3_warc, op4_url_filter, op5_cotraining, op6_simhash_dedup, op7_packing, op8_quality_rules, op9_language_id, op10_toxicity)
}

_OP3 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS digest, min(page_id) OVER (PARTITION BY b) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM q"""

_OP4 = """
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict,
             row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
      FROM s LEFT JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1"""


def _op8() -> str:
    """The rules and their bounds in SQL, with this module's parameters."""
    measures = {"word_length": "word_chars, n_words", "symbols": "n_symbols, n_words", "dup_lines": "n_dup_lines, n_lines", "repeats": "n_repeat_words, n_words"}
    value = lambda m: "CASE WHEN {1} > 0 THEN 1000 * {0} // {1} ELSE 0 END".format(*measures[m].split(", "))
    tests, bounds = [], []
    for m, (least, both) in quality_rules.MEASURES.items():
        bounds.append(f"max(CASE WHEN measure = '{m}' THEN q2 + {quality_rules.REACH} * greatest({least}, q2 - q1) END) AS {m}_most")
        tests.append(f"{value(m)} <= {m}_most")
        if both:
            bounds.append(f"max(CASE WHEN measure = '{m}' THEN q2 - {quality_rules.REACH} * greatest({least}, q3 - q2) END) AS {m}_least")
            tests.append(f"{value(m)} >= {m}_least")
    quartile = ", ".join(f"min(CASE WHEN 4 * upto >= {k} * total THEN bucket END) AS q{k}" for k in (1, 2, 3))
    levels = ""
    for i, keys in enumerate((["lang", "source"], ["lang"], [])):
        by = "".join(f"{k}, " for k in keys)
        levels += f""",
c{i} AS (SELECT {by}measure, bucket, count(*) AS n FROM v GROUP BY {by}measure, bucket),
u{i} AS (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}measure) AS total FROM c{i}),
l{i} AS (SELECT {by}measure, max(total) AS total, {quartile} FROM u{i} GROUP BY {by}measure)"""
    weight, all_words = quality_rules.WEIGHT, ", ".join(f"'{m}'" for m in quality_rules.OWN_OF_LANGUAGE)
    drawn = lambda x, y, n: f"CASE WHEN {x} >= {y} THEN {x} - (({x} - {y}) * {weight}) // ({n} + {weight}) ELSE {x} + (({y} - {x}) * {weight}) // ({n} + {weight}) END"
    of_lang = ", ".join(f"CASE WHEN l1.measure IN ({all_words}) THEN l1.{q} ELSE {drawn(f'l1.{q}', f'l2.{q}', 'l1.total')} END AS {q}" for q in ("q1", "q2", "q3"))
    pick = ", ".join(f"{drawn(f'l0.{q}', f'm1.{q}', 'l0.total')} AS {q}" for q in ("q1", "q2", "q3"))
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {value(m)} AS x FROM f WHERE NOT base_failed" for m in measures)
    return rf"""
WITH w AS (SELECT doc_id, lang, source, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
x AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
y AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM x) WHERE n > 1),
z AS (SELECT doc_id, sum(least(3, i - before))::BIGINT AS n FROM (SELECT doc_id, i, lag(i, 1, -9) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM y) GROUP BY doc_id),
a AS (SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(z.n, 0) AS n_repeat_words
      FROM w LEFT JOIN z USING (doc_id)),
f AS (SELECT *, n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM a),
v AS (SELECT lang, source, measure, x - x % (1::BIGINT << greatest(0, length(bin(x::BIGINT)) - 7)::INT) AS bucket FROM ({each})){levels},
m1 AS (SELECT l1.lang, l1.measure, {of_lang} FROM l1 JOIN l2 ON l1.measure = l2.measure),
q AS (SELECT l0.lang, l0.source, l0.measure, {pick} FROM l0 JOIN m1 ON l0.lang IS NOT DISTINCT FROM m1.lang AND l0.measure = m1.measure),
b AS (SELECT lang, source, {", ".join(bounds)} FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({" AND ".join(tests)}, false) AS kept
FROM f LEFT JOIN b ON f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source"""


ORACLE_SQL: dict[str, str] = {"op3_warc": _OP3, "op4_url_filter": _OP4, "op8_quality_rules": _op8()}
