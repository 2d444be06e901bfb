"""Groups of near copies: texts whose sets of word shingles have a Jaccard similarity of LIKE or more, linked into components.

Texts of one shingle set are one point. Points meet first by SimHash: those whose fingerprints simhash_dedup links, through its
vantage-point trees, at RADIUS bits are candidates. At similarity 0.8 fingerprints lie up to 14 bits apart, where such trees prune
nothing, so what lies further is found beside them: points that are not united yet and agree on ROWS minima of hashed shingles in any of BANDS bands are candidates:
at similarity 0.8 a pair is missed with probability 7e-6, above it with less. Each candidate pair is confirmed by the exact
similarity of the shingles themselves, on whole texts. Three more rounds keep a large group from meeting in all pairs: first every
point meets the least of its bands' least points; then the least points of its other bands, where they are in other components
so far; then the points of bands that are still in several components meet, with their shingle sets, in one task a band: it
compares those of different components and gives a spanning forest of what it finds, never pairs. A band of many points, or of
large sets, is cut into blocks, and every two blocks meet in a task. So no pair that could add a link is left out.

Cases: words and their case as in simhash_dedup; texts without words (null too) are one point; a text of fewer words than a
shingle is one shingle; points are told apart by 64 bits of their set (at 15 million points two fall together with
probability 6e-6).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomweave.llm.common import join_many_to_one, map_batches, materialize, shuffle_partitions
from bomweave.llm.simhash_dedup import components, edges, fingerprint, first_of_groups, named

WIDTH, LIKE = 5, 0.8
#: Bits by which fingerprints of candidates may differ.
RADIUS = 4
BANDS, ROWS = 30, 5
#: Shingles that are hashed anew at once.
_BLOCK = 4096
#: Points and shingles of a block of a band whose points meet in one task.
BLOCK_POINTS, BLOCK_SHINGLES = 2_048, 2_000_000
_DICE = np.random.default_rng(17).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, width: int = WIDTH) -> set[bytes]:
    """The distinct runs of `width` words of a UTF-8 text."""
    own = (text or b"").lower().split()
    return {b" ".join(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()


def hashed(own: set[bytes]) -> np.ndarray:
    """The shingles of a set as sorted 64-bit hashes."""
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in own), np.uint64, len(own)))


def signature(own: set[bytes]) -> tuple[int, list[int]]:
    """The key of a shingle set and one hash a band."""
    hashes = hashed(own)
    key = xxhash.xxh64_intdigest(hashes.tobytes(), 7)
    if not len(hashes):
        return key, []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK, None] * _DICE[0] + _DICE[1]
        least = np.minimum(least, (part ^ (part >> np.uint64(31))).min(axis=0))
    return key, [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def alike(a: bytes | None, b: bytes | None, width: int = WIDTH, like: float = LIKE) -> bool:
    x, y = shingles(a, width), shingles(b, width)
    both = len(x & y)
    return both >= like * (len(x) + len(y) - both)


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id, text (bytes), key, n (shingles), fp (the SimHash fingerprint) and bands of each row."""
    signed = lambda x: np.array(x, np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, fps, bands = [], [], [], []
            for t in batch[1]:
                own = shingles(t.as_py(), width)
                key, band = signature(own)
                keys.append(key)
                sizes.append(len(own))
                fps.append(fingerprint(t.as_py(), width))
                bands.append(signed(band))
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(signed(keys)), pa.array(sizes, pa.int64()), pa.array(signed(fps)), pa.array(bands, pa.list_(pa.int64()))], ["id", "text", "key", "n", "fp", "bands"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(chosen, run, f"id {chosen.schema['id'].dataType.simpleString()}, text binary, key long, n long, fp long, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """The pairs (a, b) of keys whose texts are alike; texts has one row a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [alike(x.as_py(), y.as_py(), width, like) for x, y in zip(batch[2], batch[3], strict=True)]
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    left, right = (texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b"), run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """Each row's id and component_id: the least id of the documents that links lead to, its own included."""
    rows = materialize(marked(docs, id_col, text_col, width).withColumn("row", F.monotonically_increasing_id()), "marked")
    points = materialize(rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.min("row").alias("row"), F.first("n").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands")), "points")
    dealt = points.select("key", "size", F.explode("bands").alias("band"))
    shared = dealt.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("key", "size")).alias("lead")).where("n > 1")
    cells = materialize(join_many_to_one(dealt, "band", materialize(shared, "shared-bands")), "cells")
    near = lambda x, y: F.least(x, y) >= like * F.greatest(x, y)  # noqa: E731  # sets of further sizes cannot be alike
    to_lead = cells.where((F.col("key") != F.col("lead.key")) & near(F.col("size"), F.col("lead.size"))).select(F.col("key").alias("a"), F.col("lead.key").alias("b"))
    to_lead = materialize(to_lead.distinct(), "leads")
    by_simhash = materialize(simhash_pairs(points), "simhash-pairs")
    # one text a point, that of its first row, so that copies don't meet; points without a candidate need none
    met = cells.select("key").union(by_simhash.select(F.explode(F.array("a", "b")))).distinct()
    wanted = materialize(points.join(met, "key", "left_semi").select("row"), "wanted-rows")
    texts = materialize(rows.join(wanted, "row", "left_semi").select("key", "text"), "texts")
    # SimHash's links; each point's first lead, then its leads, of other components, then points of a band that are still in several
    links = materialize(confirmed(by_simhash, texts, width, like), "links")
    roots = materialize(components(links), "components")
    first = materialize(_apart(to_lead.groupBy("a").agg(F.min("b").alias("b")), roots), "first-leads")
    more = materialize(confirmed(first, texts, width, like), "links")
    if not more.isEmpty():
        links = materialize(links.unionByName(more), "links")
        roots = materialize(components(links), "components")
    others = _apart(to_lead.join(first, ["a", "b"], "left_anti"), roots)
    more = materialize(confirmed(others, texts, width, like), "links")
    if not more.isEmpty():
        links = materialize(links.unionByName(more), "links")
        roots = materialize(components(links), "components")
    more = materialize(_between(cells, roots, texts, width, like), "links")
    if not more.isEmpty():
        roots = materialize(components(links.unionByName(more)), "components")
    labels = named(points, "key", roots)
    return join_many_to_one(rows.select("id", "key"), "key", labels).select(F.col("id").alias(id_col), "component_id")


def simhash_pairs(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): keys that SimHash links, at most one pair for each point: those of one fingerprint with its least key, and the least keys along edges()."""
    of_print = materialize(points.where("size > 0").groupBy("fp").agg(F.min("key").alias("lead"), F.count("*").alias("n")), "prints")
    same = join_many_to_one(points.where("size > 0").select("key", "fp"), "fp", of_print.where("n > 1").select("fp", "lead", "n"))
    ends = [of_print.select(F.col("fp").alias(c), F.col("lead").alias(f"lead_{c}")) for c in "ab"]
    across = edges(of_print.select("fp"), radius).distinct().join(ends[0], "a").join(ends[1], "b").select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))
    return same.where("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b")).unionByName(across)


def sets_of(texts: DataFrame, width: int) -> DataFrame:
    """key and hashes (the bytes of hashed()) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [hashed(shingles(t.as_py(), width)).tobytes() for t in batch[1]]
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(own, pa.binary())], ["key", "hashes"])

    return map_batches(texts.select("key", "text"), run, "key long, hashes binary")


def unite(roots: np.ndarray, sets: list[np.ndarray], like: float) -> list[tuple[int, int]]:
    """Pairs of places that unite the components (named by roots) of sets that are alike: at most one for each component less one.

    Every two sets of different components are compared, but for two that other links have united by then. Each set meets all
    others at once, by the places where its shingles occur.
    """
    label = np.unique(roots, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    found = []
    largest = np.bincount(label).argmax()
    for i in np.flatnonzero(label != largest).tolist():  # a pair of two components has a member outside the largest
        if (label == label[i]).all():
            break
        low, high = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        counts = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        near = np.flatnonzero((both >= like * (sizes + sizes[i] - both)) & (label != label[i]))
        for j in near.tolist():
            if label[j] != label[i]:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def _between(cells: DataFrame, roots: DataFrame, texts: DataFrame, width: int, like: float) -> DataFrame:
    """(a, b): links between points of one band that are in different components, as a spanning forest of each band's."""
    rooted = cells.select("band", "key", "size").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    rooted = materialize(rooted, "rooted-cells")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_POINTS, F.sum("size") / BLOCK_SHINGLES))
    open_ = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks.alias("blocks"), F.count("*").alias("n")).where("lo <> hi")
    open_ = materialize(open_.select("band", "blocks", "n"), "open-bands")
    met = materialize(join_many_to_one(rooted, "band", open_), "open-cells")
    # of several blocks, each point goes to the cells of its own block with every other
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != block)))
    dealt = met.withColumn("block", block).withColumn("other", other).select(F.xxhash64("band", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "key", "root")
    sets = materialize(sets_of(texts.join(met.select("key").distinct(), "key", "left_semi"), width), "sets")

    def solve(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
        own = unite(np.array([r for _, r, _ in rows]), [np.frombuffer(h, np.uint64) for *_, h in rows], like)
        return [(rows[i][0], rows[j][0]) for i, j in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out = []
            for cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell != at:
                    out += solve(held) if held else []
                    at, held = cell, []
                held.append(tuple(row))
            yield _links(out)
        yield _links(solve(held) if held else [])

    spread = dealt.join(sets, "key").select("cell", "key", "root", "hashes")
    spread = spread.repartition(shuffle_partitions(cells.sparkSession), "cell").sortWithinPartitions("cell")
    return map_batches(spread, run, "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["a", "b"])


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, like: float = LIKE) -> DataFrame:
    """The rows of docs without those whose group has a document of a smaller id; cases as in simhash_dedup."""
    return first_of_groups(docs, near_groups(docs, id_col, text_col, width, like), id_col, text_col)
