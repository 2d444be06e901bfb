"""Trees over a bounded graph: rows of an expanded tree, reveal paths, filtering, pruning and subtree paths.

A tree shows one user's expanded nodes, so its rows are few even where the graph is large: children() is a distributed plan for
any set of parents, and the walks below it hold only the nodes that they show, on the driver, within the limits given here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomweave.model import Workspace
from bomweave.operators import graph, resolve
from bomweave.storage import materialize

MAX_DEPTH, MAX_PATHS, MAX_CLIMB = 64, 2_000, 128
EXTRA = "(external documents)"


@dataclass(frozen=True)
class Node:
    """A row of a tree; target is (kind, document, element or reference)."""

    path: tuple[str, ...]
    kind: str
    doc_id: str
    name: str | None
    edge: str | None = None

    @property
    def depth(self) -> int:
        return len(self.path) - 1


def node_key(kind: str, doc_id: str, name: str | None = None) -> str:
    """Document d:, element e:, placeholder p:, group of external documents x:, repeated ancestor c:."""
    return {"document": "d", "element": "e", "placeholder": "p", "group": "x", "cycle": "c"}[kind] + f":{doc_id}" + ("" if name is None else f"#{name}")


def parsed_key(key: str) -> tuple[str, str, str | None] | None:
    """(kind, document, name) of a node that can have children."""
    kind = {"d": "document", "e": "element", "x": "group"}.get(key[:1])
    doc_id, sign, name = key[2:].partition("#") if kind == "element" else (key[2:], "", "")
    return (kind, doc_id, name if sign else None) if kind else None


def target_doc(key: str) -> str:
    return key[2:].partition("#")[0]


def ordered_children(ws: Workspace, resolved: DataFrame) -> DataFrame:
    """child_edges() with the order of a parent's children: by rule, then by relationship, then by place among roots."""
    tops = graph.root_elements(ws).select(F.col("doc_id").alias("child_doc"), F.col("spdx_id").alias("child_id"), F.col("pos").alias("place"))
    return graph.child_edges(ws, resolved).join(tops, ["child_doc", "child_id"], "left")


class Forest:
    """Children on demand, from tables written once: what a walk is about to show is fetched for all its nodes together."""

    def __init__(self, ws: Workspace):
        self.resolved, self.edges = graph.graph_of(ws)
        self.ws = ws
        self.children_of = materialize(ordered_children(ws, self.resolved), "children")
        self.roots_of = materialize(graph.root_elements(ws), "root-elements")
        informational = resolve.informational_refs(ws).join(self.resolved.select("doc_id", "doc_ref", "status", "target_doc_id"), ["doc_id", "doc_ref"])
        self.informational = materialize(informational.select("doc_id", "pos", "doc_ref", "status", "target_doc_id"), "informational")
        self.documents = materialize(ws.document.select("doc_id", "spdx_id"), "document-ids")
        top = graph.roots(ws, self.edges).orderBy("ord").collect()
        self.roots = [Node((node_key("document", r.doc_id),), "document", r.doc_id, None) for r in top]
        self._root_ids = {r.doc_id for r in top}
        self._own: dict[str, str | None] = {}
        self._elements: dict[str, list[str]] = {}
        self._group: dict[str, list[tuple]] = {}
        self._edges: dict[tuple[str, str], list[tuple[str, str, str | None, str | None]]] = {}

    def _rows(self, table: DataFrame, keys: Iterable[tuple], names: list[str], *order: str) -> list:
        """The rows of table for some keys, in order: the keys are those of nodes on the driver."""
        wanted = table.sparkSession.createDataFrame([*keys], ", ".join(f"{n} string" for n in names))
        return table.join(F.broadcast(wanted), names, "left_semi").orderBy(*order).collect()

    def load(self, nodes: Iterable[tuple[str, str, str | None]]) -> None:
        """Fetch what children() needs for nodes (kind, document, name): one query a table for all of them."""
        nodes = [*nodes]
        docs = {d for _, d, _ in nodes} - self._own.keys()
        if docs:
            self._own |= dict.fromkeys(docs) | {r.doc_id: r.spdx_id for r in self._rows(self.documents, [(d,) for d in docs], ["doc_id"], "doc_id")}
            for known, table, value in ((self._elements, self.roots_of, lambda r: r.spdx_id), (self._group, self.informational, lambda r: r)):
                known |= {d: [] for d in docs}
                for r in self._rows(table, [(d,) for d in docs], ["doc_id"], "doc_id", "pos"):
                    known[r.doc_id].append(value(r))
        parents = {(d, self._own[d] if kind == "document" else name) for kind, d, name in nodes if kind in ("document", "element")}
        parents = {(d, x) for d, x in parents if x is not None} - self._edges.keys()
        if parents:
            self._edges |= {p: [] for p in parents}
            for r in self._rows(self.children_of, parents, ["doc_id", "parent_id"], "rule", "rel_index", "place"):
                self._edges[r.doc_id, r.parent_id].append(("placeholder", r.doc_id, r.placeholder_ref, r.type) if r.child_id is None else ("element", r.child_doc, r.child_id, r.type))

    def _targets(self, kind: str, doc_id: str, name: str | None) -> list[tuple[str, str, str | None, str | None]]:
        self.load([(kind, doc_id, name)])
        group = self._group[doc_id]
        if kind == "document":
            own = self._own[doc_id]
            found = [("element", doc_id, e, "DESCRIBES") for e in self._elements[doc_id]] if own else []
            found += [x for x in self._edges[doc_id, own] if x not in found] if own else []
            return found + ([("group", doc_id, None, None)] if group else [])
        if kind == "group":
            return [("document", r.target_doc_id, None, None) if r.status == "resolved" else ("placeholder", doc_id, r.doc_ref, None) for r in group]
        if kind != "element":
            return []
        found = [*self._edges[doc_id, name]]
        if doc_id not in self._root_ids and self._elements[doc_id][:1] == [name] and group:
            found.append(("group", doc_id, None, None))
        return found

    def children(self, node: Node) -> list[Node]:
        """The rows below a node: none from MAX_DEPTH on, a repeated ancestor as a leaf, each path once."""
        if node.depth >= MAX_DEPTH or node.kind in ("placeholder", "cycle"):
            return []
        out: dict[tuple[str, ...], Node] = {}
        for kind, doc_id, name, edge in self._targets(node.kind, node.doc_id, node.name):
            own = node_key(kind, doc_id, name)
            if own in node.path:
                kind, own = "cycle", node_key("cycle", doc_id, name)
            path = (*node.path, own)
            out.setdefault(path, Node(path, kind, doc_id, name, edge))
        return [*out.values()]

    def visible(self, expanded: Iterable[tuple[str, ...]]) -> list[Node]:
        """The rows that show, in order: roots, and below each expanded node its children."""
        chosen, out = set(expanded), []
        self.load(n for p in chosen if (n := parsed_key(p[-1])))

        def walk(node: Node) -> None:
            out.append(node)
            if node.path in chosen:
                for child in self.children(node):
                    walk(child)

        for root in self.roots:
            walk(root)
        return out

    def subtree_paths(self, node: Node, limit: int = MAX_PATHS) -> tuple[list[tuple[str, ...]], bool]:
        """Paths at or below a node that have children, at most limit, and whether there are more."""
        out, todo = [], [node]
        while todo:
            at = todo.pop()
            if (at.doc_id, at.name) not in self._edges:
                self.load((n.kind, n.doc_id, n.name) for n in [at, *todo])
            below = self.children(at)
            if below:
                if len(out) >= limit:
                    return out, True
                out.append(at.path)
                todo += reversed(below)
        return out, False

    def reveal(self, doc_id: str, spdx_id: str) -> tuple[str, ...] | None:
        """A path from a root to an element: its first parent by rule, that one's, and so on; None if no root leads there."""
        return self.reveal_all([(doc_id, spdx_id)])[0]

    def reveal_all(self, elements: list[tuple[str, str]]) -> list[tuple[str, ...] | None]:
        """The same for several elements, which climb together: one query a step for all of them."""
        climbs = [[e] for e in elements]
        found: list[tuple[str, ...] | None] = [None] * len(elements)
        open_ = [*range(len(elements))]
        for _ in range(MAX_CLIMB):
            tips = {climbs[k][-1] for k in open_}
            if not tips:
                break
            self.load(("group", d, None) for d, _ in tips)
            parents: dict[tuple[str, str], list] = {t: [] for t in tips}
            for r in self._rows(self.children_of, tips, ["child_doc", "child_id"], "rule", "doc_id", "rel_index"):
                parents[r.child_doc, r.child_id].append(r)
            self.load(("group", r.doc_id, None) for rows in parents.values() for r in rows)
            still = []
            for k in open_:
                tip = climbs[k][-1]
                path = lambda doc, own=climbs[k]: (node_key("document", doc), *(node_key("element", *e) for e in reversed(own)))
                if tip[0] in self._root_ids and tip[1] in self._elements[tip[0]]:
                    found[k] = path(tip[0])
                    continue
                for r in parents[tip]:
                    if self._own[r.doc_id] == r.parent_id:  # the document itself is the parent
                        if r.doc_id in self._root_ids:
                            found[k] = path(r.doc_id)
                            break
                    elif (r.doc_id, r.parent_id) not in climbs[k]:
                        climbs[k].append((r.doc_id, r.parent_id))
                        still.append(k)
                        break
            open_ = still
        return found

    def filtered(self, hits: Iterable[tuple[str, str]], limit: int = 500) -> tuple[list[tuple[str, ...]], int, int]:
        """Paths of hits and their ancestors in tree order, how many hits show and how many there are."""
        every = [*hits]
        paths = [p for p in self.reveal_all(every[:limit]) if p]
        return sorted({p[:n] for p in paths for n in range(1, len(p) + 1)}), len(paths), len(every)


def pruned(expanded: Iterable[tuple[str, ...]], gone: set[str]) -> list[tuple[str, ...]]:
    """Expanded paths that touch no removed document."""
    return [p for p in expanded if not any(target_doc(k) in gone for k in p)]


def default_expansion(nodes: int, stubs: int) -> str:
    return "all" if nodes + stubs <= 24 else "roots"


def fetch_to_fixpoint(ws: Workspace, landed: Callable[[list[str]], Workspace | None], rounds: int = 16, most: int = 500) -> Workspace:
    """Add documents that references lead to, round by round, from a catalogue of landed files; no URL is tried twice."""
    from bomweave.operators.workspace import add_documents

    spark, tried = ws.document.sparkSession, []
    for _ in range(rounds):
        resolved, _ = graph.graph_of(ws)
        known = spark.createDataFrame([(u,) for u in tried], "url string")
        urls = [r.url for r in graph.fetch_candidates(ws, resolved, known).orderBy("url").limit(most - len(tried)).collect()]
        if not urls:
            break
        tried += urls
        batch = landed(urls)
        if batch is not None:
            ws = add_documents(ws, batch)
    return ws
