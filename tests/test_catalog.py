"""Every registered query with SQL, on the small tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from bomweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"tree_rows", "reveal_paths"}


def test_trees(spark, small):
    """Rows that only a walk gives: every root is open, hits are at the ends of paths, and paths begin at a root."""
    rows = catalog.tree_rows(spark, small).orderBy("place").collect()
    roots = [r.doc_id for r in rows if r.depth == 0]
    want = catalog.roots(spark, small).orderBy("ord").collect()
    assert roots == [r.doc_id for r in want] and {r.depth for r in rows} == {0, 1}
    assert all(r.kind in ("document", "element", "group", "placeholder") for r in rows)
    paths = [r.path.split("/") for r in catalog.reveal_paths(spark, small).orderBy("place").collect()]
    assert paths == sorted(paths) and all(p[0][2:] in roots for p in paths)
    assert all(p[:-1] in paths for p in paths if len(p) > 1)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, small, oracle, name):
    want = oracle.sql(catalog.ORACLE_SQL[name])
    own = catalog.QUERIES[name](spark, small)
    assert sorted(own.columns) == sorted(want.columns)
    assert Counter(map(repr, (tuple(r) for r in own.select(*want.columns).collect()))) == Counter(map(repr, want.fetchall()))
