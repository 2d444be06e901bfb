"""SimHash near-duplicate groups, linked exactly through vantage-point trees.

A fingerprint has 64 bits: bit b is 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Two
fingerprints link at `radius` or fewer differing bits; a group is a connected component.

Equal fingerprints are one point. A pair within the radius agrees on all but `radius` of any `blocks` bit blocks (pigeonhole),
so the points are dealt to one forest a combination of blocks, by the exact bits there: inside a cell the distance in those
blocks is 0, and the triangle bound of a tree over them prunes every other cell. Inside a cell a vantage-point tree splits
the points by Hamming distance from a vantage point; two branches meet only in the strips that the triangle bound leaves. A
cell of over `cell_limit` points is cut into shells around its vantage point, and only shells whose distance ranges overlap
within the radius are queried together, in tasks of their own. A cell of at most LEAF points is one leaf, and such cells are
compared together. Every cell gives a spanning forest of its links, never all pairs, and components are found by joins over
those edges; rows of a large component, or of a frequent fingerprint, are joined by join_many_to_one(). Nothing but counts
reaches the driver.

Cases: null text and a text without words have fingerprint zero, linked like any other; texts of fewer words than a shingle
are one shingle; a repeated id keeps its rows, each labelled by its own fingerprint; null ids are labelled but never name a
group (null where a group has no other id); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomweave.llm.common import join_many_to_one, map_batches, materialize, shuffle_partitions, unused

#: Points that one cell may hold before it is cut into shells.
CELL_LIMIT = 8192
#: Points of a tree's leaf, compared directly, and pairs that two branches are compared in at once.
LEAF, CROSS = 32, 1 << 20
#: Points aimed at a cell when the number of blocks is chosen.
CELL_AIM = 2048


def fingerprint(text: bytes | None, width: int) -> int:
    """The fingerprint of a UTF-8 text over shingles of `width` words."""
    own = (text or b"").lower().split()  # for bytes: A to Z, and the white space 0x20 and 0x09 to 0x0D
    if not own:
        return 0
    n = max(1, len(own) - width + 1)
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(width, len(own)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp (the fingerprint's 64 bits as a long) of each row: a narrow map over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([fingerprint(t.as_py(), width) for t in batch[1]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(own)], ["id", "fp"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_batches(chosen, run, f"id {chosen.schema['id'].dataType.simpleString()}, fp long")


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Links:
    """Which of some points are in one component so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, members: np.ndarray) -> None:
        """Unite the components of the members."""
        labels = np.unique(self.label[members])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels[1:])] = labels[0]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite the components of a[i] and b[i]: smallest labels are passed along until none changes."""
        left, right = self.label[a], self.label[b]
        nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        low, high = at[: len(a)], at[len(a) :]
        own = np.arange(len(nodes))
        while True:
            least = np.minimum(own[low], own[high])
            new = own.copy()
            np.minimum.at(new, low, least)
            np.minimum.at(new, high, least)
            new = new[new]
            if (new == own).all():
                break
            own = new
        moved = np.flatnonzero(own != np.arange(len(nodes)))
        if len(moved):
            place = np.searchsorted(nodes, self.label)
            place[place == len(nodes)] = 0
            known = nodes[place] == self.label
            self.label[known] = nodes[own[place[known]]]


def link(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the index of a point that stands for its component at the radius, exactly."""
    links = Links(len(points))
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.arange(len(points)), None)]
    while todo:
        a, b = todo.pop()
        if b is None:
            if len(a) <= LEAF:
                _compare(points, links, a, a, radius)
                continue
            if (links.label[a] == links.label[a[0]]).all():
                continue  # all in one component already: no link among them can add to it
            far = _distance(points[a], points[a[0]])
            ball = a[far <= radius]
            links.join(ball)
            cut = int(np.median(far))
            inside = far <= cut
            if inside.all():
                inside = far < cut
            if not inside.any():
                _blocks(points, links, a, a, radius)
                continue
            todo += [(a[inside], None), (a[~inside], None)]
            reach = far[inside].max()
            near_in, near_out = a[inside & (far + np.uint8(radius) > reach)], a[~inside & (far <= reach + radius)]
            if len(near_in) and len(near_out):
                todo.append((near_in, near_out))
        else:
            if len(a) * len(b) <= CROSS:
                _blocks(points, links, a, b, radius)
                continue
            if (links.label[a] == links.label[a[0]]).all() and (links.label[b] == links.label[a[0]]).all():
                continue
            v = points[(a if len(a) >= len(b) else b)[0]]
            far_a, far_b = _distance(points[a], v).astype(int), _distance(points[b], v).astype(int)
            cut = int(np.median(np.concatenate([far_a, far_b])))
            in_a, in_b = far_a <= cut, far_b <= cut
            if in_a.all() and in_b.all() or not (in_a.any() or in_b.any()):
                _blocks(points, links, a, b, radius)
                continue
            strip_a, strip_b = (in_a & (far_a > cut - radius), in_b & (far_b > cut - radius))
            over_a, over_b = (~in_a & (far_a <= cut + radius), ~in_b & (far_b <= cut + radius))
            todo += [(x, y) for x, y in ((a[in_a], b[in_b]), (a[~in_a], b[~in_b]), (a[strip_a], b[over_b]), (a[over_a], b[strip_b])) if len(x) and len(y)]
    return links.label


def _blocks(points: np.ndarray, links: Links, a: np.ndarray, b: np.ndarray, radius: int) -> None:
    for at in range(0, len(a), 256):
        for to in range(0, len(b), CROSS // 256):
            _compare(points, links, a[at : at + 256], b[to : to + CROSS // 256], radius)


def _compare(points: np.ndarray, links: Links, a: np.ndarray, b: np.ndarray, radius: int) -> None:
    """Unite all of a and b within the radius; pairs that are in one component already are left out."""
    left, right = links.label[a], links.label[b]
    if (left == left[0]).all() and (right == left[0]).all():
        return
    i, j = np.nonzero((_distance(points[a][:, None], points[b][None, :]) <= radius) & (left[:, None] != right[None, :]))
    if len(i):
        links.pairs(a[i], b[j])


def _small_cells(cells: np.ndarray, points: np.ndarray, radius: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all cells of a sorted run at once, by comparing each point with the next ones of its cell."""
    found = []
    for step in range(1, largest):
        same = np.flatnonzero(cells[step:] == cells[:-step])
        if not len(same):
            break
        near = same[_distance(points[same], points[same + step]) <= radius]
        if len(near):
            found.append((near, near + step))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    links = Links(len(points))
    links.pairs(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
    child = np.flatnonzero(links.label != np.arange(len(points)))
    return child, links.label[child]


def edges_of_cells(radius: int):
    """A map over rows (cell, fp) sorted by cell: a spanning forest of each cell's links, as rows (a, b)."""
    small = LEAF + 1  # cells that are one leaf

    def solve(cells: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        points = fps.view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        count = np.diff(np.append(start, len(cells)))
        few = np.repeat(count < small, count)
        a, b = [], []
        at = np.flatnonzero(few)
        if len(at):
            child, root = _small_cells(cells[at], points[at], radius, small)
            a.append(fps[at[child]])
            b.append(fps[at[root]])
        for s, n in zip(start[count >= small].tolist(), count[count >= small].tolist(), strict=True):
            label = link(points[s : s + n], radius)
            child = np.flatnonzero(label != np.arange(n))
            a.append(fps[s + child])
            b.append(fps[s + label[child]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (a, b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cells, held = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, fps = (np.asarray(batch.column(i)) for i in (0, 1))
            last = int(np.flatnonzero(cells != cells[-1])[-1]) + 1 if cells[0] != cells[-1] else 0
            first = 0
            if held_cells and held_cells[-1][-1] == cells[0]:  # the cell at the seam goes on
                first = int(np.argmax(cells != cells[0])) if cells[0] != cells[-1] else len(cells)
            held_cells.append(cells[:first])
            held.append(fps[:first])
            if first < len(cells):
                ready_cells, ready = np.concatenate([*held_cells, cells[first:last]]), np.concatenate([*held, fps[first:last]])
                if len(ready):
                    yield solve(ready_cells, ready)
                held_cells, held = [cells[max(first, last) :]], [fps[max(first, last) :]]
        if sum(map(len, held)):
            yield solve(np.concatenate(held_cells), np.concatenate(held))

    return run


def combinations_of_blocks(points: int, radius: int) -> list[int]:
    """Masks, one a forest: any two fingerprints within the radius agree under at least one of them."""
    blocks = radius + 1
    while points >> (64 * (blocks - radius) // blocks) > CELL_AIM and comb(blocks + 1, radius) <= 100:
        blocks += 1
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(bounds, bounds[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def _signed(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def edges(points: DataFrame, radius: int = 4, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(a, b) longs: edges that connect the same distinct fingerprints (fp) as all links within the radius do."""
    spark = points.sparkSession
    n = points.count()
    if not n:
        return spark.createDataFrame([], "a long, b long")
    forests = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _signed(m).alias("mask")) for i, m in enumerate(combinations_of_blocks(n, radius)))))
    dealt = points.select("fp", forests.alias("f")).select(F.xxhash64("f.i", F.col("f.mask").bitwiseAND(F.col("fp"))).alias("cell"), "fp")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("vantage")).where(F.col("n") > cell_limit)
    hot = materialize(sizes, "hot-cells")
    if hot.isEmpty():
        cells = dealt
    else:
        kept = dealt.join(hot.select("cell"), "cell", "left_anti")
        cells = kept.unionByName(_shells(dealt, hot, radius, cell_limit))
    spread = cells.repartition(shuffle_partitions(spark), "cell").sortWithinPartitions("cell", "fp").select("cell", "fp")
    return map_batches(spread, edges_of_cells(radius), "a long, b long")


def _shells(dealt: DataFrame, hot: DataFrame, radius: int, limit: int) -> DataFrame:
    """The points of hot cells, each once for every pair of overlapping shells that its shell is in, as cells of these pairs.

    A shell holds whole distances from the vantage point up to about `limit` points; a single distance with more points is
    dealt to several shells by hash. Pairs of shells whose distance ranges are further apart than the radius cannot link.
    """
    far = dealt.join(hot, "cell").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage")))).select("cell", "fp", "d")
    by_d = far.groupBy("cell", "d").agg(F.count("*").alias("m"))
    up_to = Window.partitionBy("cell").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    shells = by_d.withColumn("subs", F.ceil(F.col("m") / limit)).withColumn(
        "shell", F.when(F.col("m") >= limit // 2, F.col("d") + 1000).otherwise(F.floor(F.coalesce(F.sum("m").over(up_to), F.lit(0)) / limit))
    )
    shells = materialize(shells, "shells")  # at most 65 rows a hot cell
    parts = (
        shells.groupBy("cell", "shell").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("subs").alias("subs"))
        .withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).withColumn("part", F.col("shell") * 1_000_000 + F.col("sub")).select("cell", "part", "lo", "hi")
    )
    left, right = parts.alias("l"), parts.alias("r")
    near = (F.col("l.lo") <= F.col("r.hi") + radius) & (F.col("r.lo") <= F.col("l.hi") + radius)
    pairs = left.join(right, (F.col("l.cell") == F.col("r.cell")) & near & (F.col("l.part") < F.col("r.part"))).select(
        F.col("l.cell").alias("cell"), F.explode(F.array("l.part", "r.part")).alias("part"), F.struct("l.part", "r.part").alias("pair")
    )
    own = parts.select("cell", "part", F.struct(F.col("part").alias("part"), F.col("part").alias("part")).alias("pair"))
    placed = far.join(shells.select("cell", "d", "shell", "subs"), ["cell", "d"]).select(
        "cell", "fp", (F.col("shell") * 1_000_000 + F.pmod(F.xxhash64("fp"), F.col("subs"))).alias("part")
    )
    alone = pairs.select("cell", "part").distinct()  # a part that is in a pair needs no cell of its own
    return placed.join(pairs.unionByName(own.join(alone, ["cell", "part"], "left_anti")), ["cell", "part"]).select(F.xxhash64("cell", "pair").alias("cell"), "fp")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of an edge, but that itself, its component's least node, by alternating star contraction.

    Each round is two group-bys with map-side minima, whose results the edges are joined to, with frequent nodes apart; labels
    are written to the shared folder, never collected. Rounds grow with the logarithm of the longest chain.
    """
    links, seen = materialize(links.where("a <> b").distinct(), "links"), None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).withColumn("m", F.least("u", "m")).where("n > 0"), "least")
        large = join_many_to_one(both.where("v > u"), "u", least).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        new = materialize(small, "links")
        digest = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if digest == seen:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        links, seen = new, digest


def near_groups(docs: DataFrame, radius: int = 4, width: int = 4, cell_limit: int = CELL_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, fp and component_id: the least id of the documents that links lead to, its own included."""
    marked = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    points = materialize(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "points")
    labels = named(points, "fp", components(edges(points, radius, cell_limit)))
    return join_many_to_one(marked, "fp", labels).select(F.col("id").alias(id_col), "fp", "component_id")


def named(points: DataFrame, key: str, roots: DataFrame) -> DataFrame:
    """(key, component_id, n) of written points (key, least, n): the least id of each component; roots (node, root) has all nodes but the roots."""
    roots = materialize(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "members")
    linked = materialize(points.join(roots, points[key] == roots.node).select(key, "least", F.col("n").alias("rows"), "root"), "linked")
    least = materialize(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "component-ids")
    of_linked = join_many_to_one(linked, "root", least).select(key, "component_id", F.col("rows").alias("n"))
    alone = points.join(roots.select(F.col("node").alias(key)), key, "left_anti").select(key, F.col("least").alias("component_id"), "n")
    return materialize(of_linked.unionByName(alone), "labels")


def one_of_each(docs: DataFrame, radius: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those whose group has a document of a smaller id.

    Rows with a null id stay. Of rows that repeat an id one stays, the least by text, if any of them is its group's first.
    """
    return first_of_groups(docs, near_groups(docs, radius, width, id_col=id_col, text_col=text_col), id_col, text_col)


def first_of_groups(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """one_of_each by the component_id that labelled has for each row's id.

    The ids to remove are a written table, so Spark broadcasts it only where its size is known to be small.
    """
    groups = materialize(labelled.select(F.col(id_col).alias("id"), "component_id"), "groups")
    by_id = groups.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.max((F.col("id") == F.col("component_id")).cast("int")).alias("first"))
    gone = materialize(by_id.where("first = 0").select("id"), "gone")
    again = materialize(by_id.where("first = 1 and n > 1").select("id"), "again")
    kept = docs.join(gone, docs[id_col] == gone.id, "left_anti")
    if again.isEmpty():
        return kept
    (place,) = unused(docs, "place")
    several = kept.join(again, kept[id_col] == again.id, "left_semi")
    one = several.withColumn(place, F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))).where(F.col(place) == 1).drop(place)
    return kept.join(again, kept[id_col] == again.id, "left_anti").unionByName(one)
