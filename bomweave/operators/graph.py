"""Graphs of documents and elements: roots, reach, levels, lanes, child edges, subtrees and plans over them.

Closures are breadth-first: every step joins the frontier to the edges, drops what was visited by an anti join and writes the
new frontier below one folder of the shared folder, which is read as one table, so a plan never grows with the depth. Only
emptiness of a frontier reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomweave.functions.identity import is_fetchable, is_sbom_like
from bomweave.model import Workspace
from bomweave.operators.order import numbered, numbered_within
from bomweave.operators.resolve import document_edges, resolutions
from bomweave.storage import Steps, materialize

MAX_SUBTREE = 50_000


def frontier(starts: DataFrame, edges: DataFrame, keys: list[str], max_steps: int | None = None, limit: int | None = None) -> DataFrame:
    """keys and level of everything that edges (columns <key> and next_<key>) lead to from starts (distinct keys), at its least level.

    limit stops after the step in which that many rows were reached.
    """
    edges = materialize(edges, "edges")
    steps = Steps(edges.sparkSession, "levels")
    step = steps.add(starts.select(*keys).distinct().withColumn("level", F.lit(0).cast("long")))
    level, reached = 0, 0
    while max_steps is None or level < max_steps:
        level += 1
        following = step.join(edges, keys).select(*(F.col(f"next_{k}").alias(k) for k in keys)).distinct()
        step = steps.add(following.join(steps.all().select(*keys), keys, "left_anti").withColumn("level", F.lit(level).cast("long")))
        if limit is not None:
            reached += step.count()
        if step.isEmpty() or (limit is not None and reached >= limit):
            break
    return steps.all()


def roots(ws: Workspace, edges: DataFrame) -> DataFrame:
    """doc_id and ord of documents that no other document's reference resolves to."""
    return ws.document.select("doc_id", "ord").join(edges.select(F.col("dst").alias("doc_id")), "doc_id", "left_anti")


def child_documents(ws: Workspace, edges: DataFrame) -> DataFrame:
    return ws.document.select("doc_id", "ord").join(edges.select(F.col("dst").alias("doc_id")), "doc_id", "left_semi")


def _as_next(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("doc_id"), F.col("dst").alias("next_doc_id")).distinct()


def reachable(starts: DataFrame, edges: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """doc_id and level of the starts and all that edges lead to, never entering a document of exclude."""
    if exclude is not None:
        edges = edges.join(exclude.select(F.col("doc_id").alias("dst")), "dst", "left_anti")
        starts = starts.join(exclude, "doc_id", "left_anti")
    return frontier(starts, _as_next(edges), ["doc_id"])


def levels(ws: Workspace, edges: DataFrame) -> DataFrame:
    """doc_id, level and is_root of every document: steps from the nearest root, 0 where no root leads to it."""
    top = materialize(roots(ws, edges), "roots")
    found = frontier(top.select("doc_id"), _as_next(edges), ["doc_id"])
    is_root = top.select("doc_id", F.lit(True).alias("is_root"))
    joined = ws.document.select("doc_id").join(found, "doc_id", "left").join(is_root, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("level", F.lit(0).cast("long")).alias("level"), F.coalesce("is_root", F.lit(False)).alias("is_root"))


def map_edges(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Edges of the document map: those from documents that a root leads to."""
    found = frontier(roots(ws, edges).select("doc_id"), _as_next(edges), ["doc_id"])
    return edges.join(found.select(F.col("doc_id").alias("src")), "src", "left_semi")


def stubs(resolved: DataFrame, level: DataFrame) -> DataFrame:
    """Unresolved structural references, one level below their owner."""
    rows = resolved.where("status = 'unresolved' and structural")
    return rows.join(level, "doc_id").select("doc_id", "doc_ref", (F.col("level") + 1).alias("level"))


def lanes(ws: Workspace, resolved: DataFrame) -> DataFrame:
    """(key, kind, doc_id, doc_ref, level, lane): places in the document map, by one pass of barycenters from the top.

    Level 0 keeps document order; below, items are ordered by the mean lane of their parents one level up (without such, by
    their own index), ties by index. As many steps as there are levels.
    """
    edges = materialize(document_edges(resolved), "edges")
    level = materialize(levels(ws, edges), "levels")
    docs = ws.document.select("doc_id", "ord").join(level, "doc_id").select(F.concat(F.lit("d:"), "doc_id").alias("key"), F.lit("doc").alias("kind"), "doc_id", F.lit(None).cast("string").alias("doc_ref"), "level", F.struct(F.lit(0).alias("s"), "ord", F.lit(0).cast("long").alias("pos")).alias("at"))
    refs = resolved.select("doc_id", "doc_ref", "pos")
    below = stubs(resolved, level).join(refs, ["doc_id", "doc_ref"]).join(ws.document.select("doc_id", "ord"), "doc_id")
    stub = below.select(F.concat(F.lit("s:"), "doc_id", F.lit(":"), "doc_ref").alias("key"), F.lit("stub").alias("kind"), "doc_id", "doc_ref", "level", F.struct(F.lit(1).alias("s"), "ord", "pos").alias("at"))
    items = materialize(numbered_within(docs.unionByName(stub), "level", "at", name="index"), "items")
    owner = level.select(F.col("doc_id").alias("p"), F.col("level").alias("up"))
    parent = edges.select(F.concat(F.lit("d:"), "dst").alias("key"), F.col("src").alias("p")).unionByName(items.where("kind = 'stub'").select("key", F.col("doc_id").alias("p")))
    parent = parent.join(owner, "p").select("key", F.concat(F.lit("d:"), "p").alias("parent"), "up")
    lanes = Steps(ws.document.sparkSession, "lanes")
    lanes.add(items.where("level = 0").withColumn("lane", F.col("index")).select("key", "level", "lane"))
    deepest = items.agg(F.max("level")).first()[0] or 0
    for depth in range(1, deepest + 1):
        here = items.where(F.col("level") == depth)
        above = lanes.all().where(F.col("level") == depth - 1).select(F.col("key").alias("parent"), F.col("lane").alias("up_lane"))
        mean = parent.where(F.col("up") == depth - 1).join(above, "parent").groupBy("key").agg(F.avg("up_lane").alias("center"))
        placed = numbered(here.join(mean, "key", "left"), F.coalesce("center", F.col("index").cast("double")), "index", name="lane")
        lanes.add(placed.select("key", "level", "lane"))
    return items.join(lanes.all().select("key", "lane"), "key").select("key", "kind", "doc_id", "doc_ref", "level", "lane")


def removal_plan(ws: Workspace, edges: DataFrame, requested: DataFrame) -> DataFrame:
    """doc_id and kind: `requested` documents that are loaded, and `orphaned` ones that only those lead to."""
    edges = materialize(edges, "edges")
    asked = materialize(ws.document.select("doc_id").join(requested.select("doc_id").distinct(), "doc_id", "left_semi"), "asked")
    kept = reachable(roots(ws, edges).select("doc_id"), edges, exclude=asked)
    dragged = reachable(asked, edges)
    orphaned = dragged.select("doc_id").join(asked, "doc_id", "left_anti").join(kept, "doc_id", "left_anti")
    return asked.withColumn("kind", F.lit("requested")).unionByName(orphaned.withColumn("kind", F.lit("orphaned")))


def fetch_candidates(ws: Workspace, resolved: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(url, doc_ref, doc_id, structural): what to download next, the first reference of each URL.

    Unresolved references with a web URL: structural ones, and informational ones whose URL looks like a document.
    """
    rows = resolved.where("status = 'unresolved'").withColumn("url", F.trim("uri")).where(F.col("url") != "")
    rows = rows.where(is_fetchable(F.col("url")) & (F.col("structural") | is_sbom_like(F.col("url"))))
    if exclude is not None:
        rows = rows.join(exclude.select("url"), "url", "left_anti")
    rows = rows.join(ws.document.select("doc_id", "ord"), "doc_id")
    return rows.groupBy("url").agg(F.min_by(F.struct("doc_ref", "doc_id", "structural"), F.struct("ord", "pos")).alias("f")).select("url", "f.doc_ref", "f.doc_id", "f.structural")


def root_elements(ws: Workspace) -> DataFrame:
    """(doc_id, spdx_id, pos) of each document's root elements.

    What it describes; else the packages that nothing in it contains or depends on; else its first package.
    """
    d = ws.document.select("doc_id", F.posexplode("describes").alias("pos", "spdx_id")).select("doc_id", "spdx_id", F.col("pos").cast("long"))
    rest = ws.document.where(F.coalesce(F.size("describes"), F.lit(0)) == 0).select("doc_id")
    packages = ws.element.where("kind = 'package'").select("doc_id", "spdx_id", "pos").join(rest, "doc_id", "left_semi")
    r = ws.relationship
    below = r.where("type in ('CONTAINS', 'DEPENDS_ON') and to_kind = 'local'").select("doc_id", F.col("to_id").alias("spdx_id"))
    below = below.unionByName(r.where("type in ('DEPENDENCY_OF', 'CONTAINED_BY') and from_kind = 'local'").select("doc_id", F.col("from_id").alias("spdx_id")))
    free = packages.join(below, ["doc_id", "spdx_id"], "left_anti").withColumn("top", F.lit(True))
    marked = packages.join(free, ["doc_id", "spdx_id", "pos"], "left")
    own = Window.partitionBy("doc_id")
    chosen = marked.withColumn("any", F.max("top").over(own)).withColumn("least", F.min("pos").over(own))
    return d.unionByName(chosen.where("top or (any is null and pos = least)").select("doc_id", "spdx_id", "pos"))


#: Which relationships lead from a parent to a child, in order: type, whether the child is the far end, whether only other documents count.
CHILD_RULES = [("DESCRIBES", True, False), ("CONTAINS", True, False), ("CONTAINED_BY", False, False), ("DEPENDS_ON", True, False), ("DEPENDENCY_OF", False, False), ("DESCRIBED_BY", True, True)]


def _ruled(ws: Workspace) -> DataFrame:
    """Relationships as (doc_id, parent_id, rule, rel_index, type, child kind, ref and id): the parent a local element."""
    out = None
    for i, (kind, forward, outside) in enumerate(CHILD_RULES):
        near, far = ("from", "to") if forward else ("to", "from")
        rows = ws.relationship.where((F.col("type") == kind) & (F.col(f"{near}_kind") == "local") & (F.col(f"{far}_kind") != "special"))
        if outside:
            rows = rows.where(F.col(f"{far}_kind") == "external")
        part = rows.select("doc_id", F.col(f"{near}_id").alias("parent_id"), F.lit(i).alias("rule"), "rel_index", "type", F.col(f"{far}_kind").alias("kind"), F.col(f"{far}_ref").alias("ref"), F.col(f"{far}_id").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


def child_edges(ws: Workspace, resolved: DataFrame) -> DataFrame:
    """(doc_id, parent_id, child_doc, child_id, rule, rel_index, type, placeholder_ref) of every parent.

    Children in this document need an element, and aren't the parent itself. A reference that resolves leads to the element it
    names in the other document, or, where it names none (or the document), to that document's root elements: the boundary
    collapses. One that doesn't is a placeholder: child_doc and child_id are null.
    """
    rows = _ruled(ws)
    own = ws.element.select(F.col("doc_id"), F.col("spdx_id").alias("id"))
    local = rows.where("kind = 'local' and id <> parent_id").join(own, ["doc_id", "id"], "left_semi")
    local = local.select("doc_id", "parent_id", F.col("doc_id").alias("child_doc"), F.col("id").alias("child_id"), "rule", "rel_index", "type", F.lit(None).cast("string").alias("placeholder_ref"))
    known = resolved.where("status = 'resolved'").select("doc_id", F.col("doc_ref").alias("ref"), "target_doc_id")
    outside = rows.where("kind = 'external'").join(known, ["doc_id", "ref"], "left")
    placeholder = outside.where("target_doc_id is null").select("doc_id", "parent_id", F.lit(None).cast("string").alias("child_doc"), F.lit(None).cast("string").alias("child_id"), "rule", "rel_index", "type", F.col("ref").alias("placeholder_ref"))
    there = ws.element.select(F.col("doc_id").alias("target_doc_id"), F.col("spdx_id").alias("id"), F.lit(True).alias("found"))
    target = outside.where("target_doc_id is not null").join(there, ["target_doc_id", "id"], "left").join(ws.document.select(F.col("doc_id").alias("target_doc_id"), F.col("spdx_id").alias("own_id")), "target_doc_id")
    direct = F.coalesce("found", F.lit(False)) & ~F.coalesce(F.col("id") == F.col("own_id"), F.lit(False))
    hop = target.where(direct).select("doc_id", "parent_id", F.col("target_doc_id").alias("child_doc"), F.col("id").alias("child_id"), "rule", "rel_index", "type", F.lit(None).cast("string").alias("placeholder_ref"))
    tops = root_elements(ws).select(F.col("doc_id").alias("target_doc_id"), F.col("spdx_id").alias("root_id"))
    spliced = target.where(~direct).join(tops, "target_doc_id").select("doc_id", "parent_id", F.col("target_doc_id").alias("child_doc"), F.col("root_id").alias("child_id"), "rule", "rel_index", "type", F.lit(None).cast("string").alias("placeholder_ref"))
    return local.unionByName(hop).unionByName(spliced).unionByName(placeholder)


def subtree(starts: DataFrame, children: DataFrame, limit: int | None = MAX_SUBTREE) -> DataFrame:
    """(doc_id, spdx_id, level): elements at or below the starts (doc_id, spdx_id); placeholders lead nowhere.

    A limit bounds the rows; which of the last step's elements it keeps is not defined.
    """
    edges = children.where("child_id is not null").select("doc_id", F.col("parent_id").alias("spdx_id"), F.col("child_doc").alias("next_doc_id"), F.col("child_id").alias("next_spdx_id")).distinct()
    found = frontier(starts, edges, ["doc_id", "spdx_id"], limit=limit)
    return found if limit is None else found.orderBy("level").limit(limit)


def subtree_of(ws: Workspace, starts: DataFrame, limit: int | None = MAX_SUBTREE) -> DataFrame:
    """subtree() of starts in a workspace: child edges are made for the documents alone that references lead to from theirs."""
    resolved, edges = graph_of(ws)
    starts = materialize(starts.select("doc_id", "spdx_id").distinct(), "starts")
    inside = materialize(reachable(starts.select("doc_id").distinct(), edges).select("doc_id"), "reached")
    part = {name: getattr(ws, name).join(inside, "doc_id", "left_semi") for name in ("document", "element", "relationship")}
    return subtree(starts, child_edges(ws.with_tables(**part), resolved.join(inside, "doc_id", "left_semi")), limit)


def spanning_parents(edges: DataFrame, level: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, parent): each document's first incoming edge from the level above, which makes the map a tree."""
    up, down = level.select(F.col("doc_id").alias("src"), F.col("level").alias("a")), level.select(F.col("doc_id").alias("dst"), F.col("level").alias("b"))
    rows = edges.join(up, "src").join(down, "dst").where("b = a + 1").join(ws.document.select(F.col("doc_id").alias("src"), "ord"), "src")
    return rows.groupBy(F.col("dst").alias("doc_id")).agg(F.min_by("src", "ord").alias("parent"))


def graph_of(ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Written resolutions and document edges, from which the other plans start."""
    resolved = materialize(resolutions(ws), "resolutions")
    return resolved, materialize(document_edges(resolved), "document-edges")
