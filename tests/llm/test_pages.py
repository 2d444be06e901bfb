"""WARC archives and URL filters against brute force and SQL."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest

from bomweave.llm import queries, url_filter, warc
from bomweave.llm.common import new_path


def same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    own = queries.QUERIES[name](spark, sf_dir)
    assert sorted(own.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in own.select(*want.columns).collect()) == Counter(want.fetchall())


@pytest.mark.parametrize("name", ["op3_warc", "op4_url_filter", "op8_quality_rules"])
def test_against_sql(spark, small, name):
    same_as_sql(spark, small, name)


PAGES = [
    (1, "http://a/", "x" * 5000), (2, "http://b/ \r\nX: y", "x" * 5000), (3, None, None), (4, "u", ""), (5, "u", "é" * 4000 + "\r\n\r\nWARC/1.1\r\n"), (9, "u", "short"), (8, "u", "short"),
    (None, "u", "x" * 5000), (7, "u", "é" * 50), (6, "u", "é" * 50), (6, "u", "é" * 50), (11, "u", "z" * 99), (10, "u", "z" * 99), (12, "u", "z" * 100), (13, "u", "z" * 100),
]


@pytest.mark.parametrize("segment", [100, 65_536])
def test_warc_cases(spark, segment):
    pages = spark.createDataFrame([(*p, 0, "x") for p in PAGES], "page_id long, url string, html string, digest int, row string")
    out = warc.round_trip(pages, segment_bytes=segment).collect()
    want = Counter()
    for i, _, html in PAGES:
        payload = (html or "").encode()
        first = min((j for j, _, h in PAGES if h == html and j is not None), default=None)
        revisit = len(payload) >= 100 and i != first
        want[i, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((r.page, r.length, r.digest, r.type, r.refers_to) for r in out) == want
    assert not any(r.problem for r in out)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_segments_out_of_order_missing_and_altered(spark):
    path = new_path(spark, "warc")
    pages = spark.createDataFrame([(i, "u", chr(97 + i) * 3000) for i in range(4)], "page_id long, url string, html string")
    warc.write(pages, path, segment_bytes=500)
    rows = warc.records(spark, path).collect()
    schema = warc.records(spark, path).schema
    of = lambda page: [r for r in rows if r.record_id.startswith(f"<urn:page:{page}:")]
    shuffled = of(0)
    random.Random(1).shuffle(shuffled)
    missing = [r for r in of(1) if r.number != 3]
    altered = [{**r.asDict(), "total": (r.total or 0) + 1 if r.total else None} for r in of(2)]
    headless = [r for r in of(3) if r.number != 1]
    found = warc.reassemble(spark.createDataFrame([*shuffled, *shuffled[:2], *missing, *(tuple(a.values()) for a in altered), *headless], schema)).collect()
    by = {r.page: r for r in found}
    assert by["0"].payload == b"a" * 3000 and by["0"].problem is None
    assert by["1"].payload is None and "missing" in by["1"].problem
    assert by["2"].payload is None and "bytes of" in by["2"].problem
    assert by[None].payload is None and "missing" in by[None].problem


def test_every_reference_resolves(spark):
    """By the archives' own bytes: each record is a gzip member, ids are unique, and a revisit's reference is a response's id."""
    path = new_path(spark, "warc")
    rows = [*PAGES, (14, "u", "x" * 5000), (14, "u", "x" * 5000)]
    warc.write(spark.createDataFrame([(str(i) if i is not None else None, u, h) for i, u, h in rows] + [("a:b/<c> é", "u", "q" * 200), ("a:b/<d>", "u", "q" * 200)], "page_id string, url string, html string"), path, segment_bytes=700)
    heads, ends = [], {}
    for r in spark.read.format("binaryFile").load(path).collect():
        data = bytes(r.content)
        offset = 0
        while offset < len(data):  # each member alone
            z = zlib.decompressobj(31)
            own = z.decompress(data[offset:])
            offset = len(data) - len(z.unused_data)
            if own:
                ((head, block),) = warc.parse(gzip.compress(own))
                heads.append(head)
        ends |= {h["warc-record-id"]: block for h, block in warc.parse(data)}
    ids = [h["warc-record-id"] for h in heads]
    assert len(ids) == len(set(ids)) == len(ends)
    by = dict(zip(ids, heads, strict=True))
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 7
    for h in revisits:
        there = by[h["warc-refers-to"]]
        assert there["warc-type"] == "response" and there["warc-payload-digest"] == h["warc-payload-digest"]
    out = warc.follow(warc.read(spark, path)).collect()
    assert len(out) == len(rows) + 2 and not any(r.problem for r in out)
    assert {r.refers_to for r in out if r.page in ("a:b/<c> é", "a:b/<d>")} == {None, "a:b/<c> é"}
    lost = warc.follow(warc.read(spark, path).where("not (type = 'response' and page = '12')"))
    assert [(r.page, r.problem, r.length) for r in lost.collect() if r.problem] == [("13", "the response is missing", None)]


def test_archives_of_one_member_and_plain():
    records = b"".join(r + warc.SEPARATOR for r in warc.page_records("1", None, "u", b"z" * 9000, "d", None, 700))
    want = [*warc.parse(records)]
    assert len(want) == 14 and [*warc.parse(gzip.compress(records))] == want
    for bad in (records[:-3], gzip.compress(records)[:-9], b"junk" + records):
        with pytest.raises(warc.BadRecord):
            [*warc.parse(bad)]


def test_chunked_framing():
    for n in (0, 1, 4095, 4096, 4097, 10_000):
        assert warc.unchunked(warc.chunked(bytes(n))) == bytes(n)
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab", b"zz\r\n\r\n", b"3\r\nabcd\r\n0\r\n\r\n"):
        with pytest.raises(warc.BadRecord):
            warc.unchunked(bad)


def expected(url, rules):
    rest = url.partition("://")[2] if url and "://" in url else ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].partition("?")[0].partition("#")[0] if rest[end : end + 1] == "/" else ""
    fits = [r for r in rules if (r[0] == "" or host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(5)
    label = lambda: rng.choice(["a", "b", "net", "org", "x1", "\x01", "a,b", ""])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: rng.choice(["", "/", "/a", "/a/b", "/en/", "/en/x", "//"])
    rules = list({(host(), path(), rng.choice(["block", "allow"])) for _ in range(40)})
    urls = [None, "", "nothing", "://", "http://", "HTTP://A.NET/En/", "a://b?c://net/", "x://net#f", "x://net\n/a"] + [rng.choice(["http://", "https://", "", "x"]) + host() + path() + rng.choice(["", "?q=/a", "#f"]) for _ in range(800)]
    urls += ["http://hot.net/a"] * 500
    df = spark.createDataFrame([(i if i % 50 else None, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, stack int")
    out = url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    want = Counter((i if i % 50 else None, *expected(u, rules)) for i, u in enumerate(urls))
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect())
    assert got == want
    assert url_filter.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
