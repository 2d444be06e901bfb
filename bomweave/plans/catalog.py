"""The queries over the star-schema workspace, each beside SQL that states its result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomweave.functions import identity, text
from bomweave.model import Workspace
from bomweave.operators import acceptance, conflicts, graph, profile, quality, resolve, search, tree, vex, workspace
from bomweave.sources import blobs, export, files, star, statements
from bomweave.sources.star import sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _with(views: tuple[str, ...], ctes: str, body: str) -> str:
    return sql("", *views).rstrip() + (f",\n{ctes}" if ctes else "") + f"\n{body}"


def _ws(spark: SparkSession, sf_dir: str) -> Workspace:
    return star.workspace(spark, sf_dir)


#: Resolutions and document edges in SQL, for queries that start from them.
_RES = """used AS (SELECT DISTINCT doc_id, to_ref AS doc_ref FROM relationship WHERE to_kind = 'external'),
res AS (SELECT e.doc_id, e.pos, e.doc_ref, e.uri, coalesce(a.doc_id, b.doc_id, c.target) AS target, CASE WHEN a.doc_id IS NOT NULL THEN 'checksum' WHEN b.doc_id IS NOT NULL THEN 'namespace' WHEN c.target IS NOT NULL THEN 'manual' END AS method, u.doc_ref IS NOT NULL AS structural
 FROM ext_ref e LEFT JOIN document a ON e.sum = a.sha1 LEFT JOIN document b ON e.uri = b.namespace LEFT JOIN binding c ON c.doc_id = e.doc_id AND c.doc_ref = e.doc_ref LEFT JOIN used u ON u.doc_id = e.doc_id AND u.doc_ref = e.doc_ref),
edge AS (SELECT DISTINCT doc_id AS src, target AS dst, method FROM res WHERE target IS NOT NULL AND target <> doc_id),
root AS (SELECT doc_id, ord FROM document WHERE doc_id NOT IN (SELECT dst FROM edge))"""


def _graph_sql(body: str) -> str:
    base = sql("", "document", "ext_ref", "pk", "relationship", "binding").rstrip()
    return f"{base},\n{_RES}\n{body}"


_LEVEL = """, step(doc_id, level) AS (SELECT doc_id, 0 FROM root UNION SELECT e.dst, s.level + 1 FROM step s JOIN edge e ON e.src = s.doc_id WHERE s.level < 10),
lvl AS (SELECT d.doc_id, coalesce(min(level), 0)::BIGINT AS level FROM document d LEFT JOIN step USING (doc_id) GROUP BY d.doc_id)"""


# Identity and conflicts


@query("package_keys", sql("SELECT doc_id, spdx_id, key FROM element", "pk", "element"))
def package_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.keyed_packages(_ws(spark, sf_dir)).select("doc_id", "spdx_id", "key")


@query("conflict_versions", sql("SELECT key, version, count(*) AS n FROM element GROUP BY key, version", "pk", "element"))
def conflict_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.version_counts(_ws(spark, sf_dir)).select("key", "version", "n")


_CONFLICTS = """v AS (SELECT key, version, count(*) AS n FROM element GROUP BY key, version),
first AS (SELECT key, arg_min(name, suppkey * 1000000000 + pos) AS name FROM element GROUP BY key)"""


@query("conflicts", _with(("pk", "element"), _CONFLICTS, "SELECT key, any_value(name) AS name, count(*) AS n_versions, sum(n)::BIGINT AS total, string_agg(version, '|' ORDER BY version::INT) AS versions FROM v JOIN first USING (key) GROUP BY key HAVING count(*) > 1"))
def version_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.version_conflicts(_ws(spark, sf_dir)).withColumn("versions", F.array_join("versions", "|"))


@query("conflict_occurrences", _with(("pk", "element"), "c AS (SELECT key FROM element GROUP BY key HAVING count(DISTINCT version) > 1)", "SELECT key, version, doc_id, spdx_id FROM element SEMI JOIN c USING (key)"))
def conflict_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.conflict_occurrences(_ws(spark, sf_dir))


@query("purl_parts", _with(("pk", "element"), "", "SELECT DISTINCT purl, regexp_extract(purl, '@([^@/]*)$', 1) AS version, regexp_replace(purl, '@[^@/]*$', '') AS identity FROM element WHERE purl IS NOT NULL"))
def purl_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ws(spark, sf_dir).element.where("purl is not null").select("purl").distinct()
    return rows.select("purl", identity.purl_version(F.col("purl")).alias("version"), identity.purl_identity(F.col("purl")).alias("identity"))


@query("purl_match_key", _with(("pk", "element"), "", "SELECT DISTINCT purl, 'generic/' || lower(split_part(purl, '/', 2)) || '/' || split_part(split_part(purl, '/', 3), '@', 1) AS id, split_part(purl, '@', 2) AS version FROM element WHERE purl IS NOT NULL"))
def purl_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ws(spark, sf_dir).element.where("purl is not null").select("purl").distinct()
    return rows.select("purl", identity.purl_match_key(F.col("purl")).alias("k")).select("purl", "k.id", "k.version")


@query("cpe_match_key", """SELECT p_partkey, 'cpe|a:' || lower(replace(p_brand, '#', '_')) || ':' || lower(replace(p_name, ' ', ':')) AS id, CASE WHEN p_partkey % 3 <> 0 THEN p_size::VARCHAR END AS version FROM part WHERE p_partkey % 5 <> 4""")
def cpe_match_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.replace("p_name", F.lit(" "), F.lit("\\:"))
    cpe = F.concat(F.lit("cpe:2.3:"), F.when(F.col("p_partkey") % 5 == 4, "*").otherwise("a"), F.lit(":"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit(":"), name, F.lit(":"), F.when(F.col("p_partkey") % 3 == 0, "*").otherwise(F.col("p_size").cast("string")), F.lit(":*:*"))
    return part.select("p_partkey", identity.cpe_match_key(cpe).alias("k")).where("k is not null").select("p_partkey", "k.id", "k.version")


@query("checksum_problems", """SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'unknown algorithm' WHEN doc_id % 4 = 2 THEN 'not hexadecimal' WHEN doc_id % 4 = 3 THEN 'wrong length' END AS problem FROM documents""")
def checksum_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 4
    value = F.when(k == 2, F.concat(F.lit("x"), F.sha1("text"))).when(k == 3, F.md5("text")).otherwise(F.sha1("text"))
    return d.select("doc_id", identity.checksum_problem(F.when(k == 1, "SHA-7").otherwise("sha-1"), value).alias("problem"))


@query("url_scheme_filter", r"""SELECT page_id, regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') AS absolute, NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') OR regexp_matches(u, '^https?:') AS fetchable, regexp_matches(u, '(?i)\.(spdx|json|ya?ml)([?#]|$)') AS sbom_like
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url || '/x.SPDX' WHEN 2 THEN 'ocm://' || page_id || '.yaml?v=1' ELSE 'files/' || page_id || '.yml' END AS u FROM pages)""")
def url_scheme_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "pages"), F.col("page_id") % 4
    own = F.col("page_id").cast("string")
    u = F.when(k == 0, F.col("url")).when(k == 1, F.concat("url", F.lit("/x.SPDX"))).when(k == 2, F.concat(F.lit("ocm://"), own, F.lit(".yaml?v=1"))).otherwise(F.concat(F.lit("files/"), own, F.lit(".yml")))
    return p.select("page_id", identity.is_absolute_uri(u).alias("absolute"), identity.is_fetchable(u).alias("fetchable"), identity.is_sbom_like(u).alias("sbom_like"))


# Search and inventory


@query("inventory_all", _with(("pk", "element", "document"), "", "SELECT e.doc_id, d.name AS doc_name, e.spdx_id, e.name, e.version, e.purl, e.supplier, e.purpose, e.license FROM element e JOIN document d USING (doc_id)"))
def inventory_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.inventory(_ws(spark, sf_dir)).select("doc_id", "doc_name", "spdx_id", "name", "version", "purl", "supplier", "purpose", "license")


def _score(q: str) -> str:
    spread = ".*".join(q)
    base = f"CASE WHEN lower(name) = '{q}' THEN 1000 WHEN starts_with(lower(name), '{q}') THEN 800 WHEN contains(lower(name), '{q}') THEN 600 WHEN contains(blob, '{q}') THEN 400 WHEN regexp_matches(lower(name), '{spread}') THEN 100 ELSE 0 END"
    return f"SELECT doc_id, spdx_id, ((base * 1000 - least(length(name), 200)) / 1000.0)::DECIMAL(10,3) AS score FROM (SELECT *, {base} AS base FROM (SELECT *, lower(name || ' ' || version || ' ' || coalesce(purl, '') || ' ' || spdx_id) AS blob FROM element)) WHERE base > 0"


@query("search_scores", _with(("pk", "element"), "", _score("brand")))
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_ws(spark, sf_dir), " Brand ", limit=None).select("doc_id", "spdx_id", "score")


@query("search_subsequence", _with(("pk", "element"), "", _score("red")))
def search_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_ws(spark, sf_dir), "red", limit=None).select("doc_id", "spdx_id", "score")


@query("inventory_search", _with(("pk", "element", "document"), f"s AS ({_score('brand')})", """SELECT doc_id, spdx_id, score, total FROM (SELECT s.doc_id, s.spdx_id, s.score, count(*) OVER () AS total, row_number() OVER (ORDER BY s.score DESC, d.ord, e.pos) AS k
 FROM s JOIN element e ON e.doc_id = s.doc_id AND e.spdx_id = s.spdx_id JOIN document d ON d.doc_id = s.doc_id WHERE e.license = 'MIT') WHERE k <= 500"""))
def inventory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top 500 is the feature: a search shows that many hits and the number of all."""
    return search.search(_ws(spark, sf_dir), "brand", licenses=["MIT"], kinds=["package"]).select("doc_id", "spdx_id", "score", "total")


@query("inventory_sorted", _with(("pk", "element", "document"), "", "SELECT doc_id, spdx_id, version, row_number() OVER (ORDER BY version::INT, ord, pos) AS place FROM element e JOIN document d USING (doc_id)"))
def inventory_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.placed(search.inventory(_ws(spark, sf_dir)), "version").select("doc_id", "spdx_id", "version", "place")


@query("inventory_sorted_names", _with(("pk", "element", "document"), "", "SELECT doc_id, spdx_id, e.name, row_number() OVER (ORDER BY lower(e.name) DESC, ord, pos) AS place FROM element e JOIN document d USING (doc_id)"))
def inventory_sorted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.placed(search.inventory(_ws(spark, sf_dir)), "name", descending=True).select("doc_id", "spdx_id", "name", "place")


@query("inventory_csv", _with(("pk", "element", "document"), "", """SELECT doc_id, spdx_id, array_to_string(list_transform([name, version, license, supplier, purpose, purl, spdx_id, 'package', doc_name], lambda c: CASE WHEN regexp_matches(coalesce(c, ''), '[",\\n\\r;]') THEN '"' || replace(c, '"', '""') || '"' ELSE coalesce(c, '') END), ',') AS line
 FROM (SELECT e.*, d.name AS doc_name FROM element e JOIN document d USING (doc_id))"""))
def inventory_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.csv_lines(search.inventory(_ws(spark, sf_dir))).select("doc_id", "spdx_id", "line")


@query("facet_purpose", _with(("pk", "element"), "", "SELECT purpose AS value, count(*) AS n FROM element GROUP BY purpose"))
def facet_purpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet_counts(_ws(spark, sf_dir), "purpose")


@query("facet_purpose_top6", _with(("pk", "element"), "", "SELECT purpose AS value, count(*) AS n FROM element GROUP BY purpose ORDER BY n DESC, value LIMIT 6"))
def facet_purpose_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six values are the feature."""
    return search.top_facet(_ws(spark, sf_dir), "purpose")


@query("facet_license_top6", _with(("pk", "element"), "", "SELECT license AS value, count(*) AS n FROM element WHERE license IS NOT NULL GROUP BY license ORDER BY n DESC, value LIMIT 6"))
def facet_license_top6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_facet(_ws(spark, sf_dir), "license")


# References and the document graph


@query("resolution", _graph_sql("SELECT doc_id, pos, doc_ref, CASE WHEN target IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, target AS target_doc_id, method, structural FROM res"))
def resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolutions(_ws(spark, sf_dir)).drop("uri")


@query("suggestions", _graph_sql(", want AS (SELECT doc_id, doc_ref, list_distinct(list_filter(string_split_regex(lower(regexp_replace(replace(doc_ref, 'DocumentRef-', ''), '[-_ ]v?\\d[\\w.]*$', '')), '[^a-z0-9]+'), lambda x: x <> '')) AS w FROM res WHERE target IS NULL AND structural),\nhit AS (SELECT w.doc_id, w.doc_ref, arg_min(d.doc_id, d.ord) AS suggestion_doc_id, 'looks like ' || arg_min(d.name, d.ord) AS reason FROM want w JOIN document d ON d.doc_id <> w.doc_id AND list_has_all(string_split_regex(lower(d.name), '[^a-z0-9]+'), w.w) GROUP BY w.doc_id, w.doc_ref)\nSELECT * FROM hit").replace("\n, want", ",\nwant"))
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return resolve.suggestions(ws, resolve.resolutions(ws))


@query("roots", _graph_sql("SELECT doc_id, ord FROM root"))
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return graph.roots(ws, resolve.document_edges(resolve.resolutions(ws)))


@query("children_docs", _graph_sql("SELECT doc_id, ord FROM document WHERE doc_id IN (SELECT dst FROM edge)"))
def children_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return graph.child_documents(ws, resolve.document_edges(resolve.resolutions(ws)))


@query("reachable", _graph_sql(", r(doc_id) AS (SELECT 'r1' UNION SELECT e.dst FROM r JOIN edge e ON e.src = r.doc_id) SELECT doc_id FROM r").replace("\n, r(", ",\nr("))
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return graph.reachable(ws.document.where("doc_id = 'r1'"), graph.graph_of(ws)[1]).select("doc_id")


@query("doc_levels", _graph_sql(f"{_LEVEL} SELECT doc_id, level, doc_id IN (SELECT doc_id FROM root) AS is_root FROM lvl").replace("\n, step", ",\nstep"))
def doc_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return graph.levels(ws, graph.graph_of(ws)[1])


@query("doc_edges", _graph_sql(f"{_LEVEL} SELECT src, dst, method FROM edge WHERE src IN (SELECT doc_id FROM step)").replace("\n, step", ",\nstep"))
def doc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return graph.map_edges(ws, graph.graph_of(ws)[1])


@query("doc_stubs", _graph_sql(f"{_LEVEL} SELECT r.doc_id, r.doc_ref, level + 1 AS level FROM res r JOIN lvl USING (doc_id) WHERE target IS NULL AND structural").replace("\n, step", ",\nstep"))
def doc_stubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    resolved, edges = graph.graph_of(ws)
    return graph.stubs(resolved, graph.levels(ws, edges))


@query("spanning_tree", _graph_sql(f"{_LEVEL} SELECT dst AS doc_id, arg_min(src, d.ord) AS parent FROM edge JOIN lvl a ON a.doc_id = src JOIN lvl b ON b.doc_id = dst JOIN document d ON d.doc_id = src WHERE b.level = a.level + 1 GROUP BY dst").replace("\n, step", ",\nstep"))
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    edges = graph.graph_of(ws)[1]
    return graph.spanning_parents(edges, graph.levels(ws, edges), ws)


#: Three levels, so the one pass of barycenters is three windows.
_LANES = f"""{_LEVEL},
item AS (SELECT 'd:' || doc_id AS key, 'doc' AS kind, doc_id, NULL::VARCHAR AS doc_ref, level, 0 AS s, ord, 0 AS pos FROM lvl JOIN document USING (doc_id)
 UNION ALL SELECT 's:' || r.doc_id || ':' || r.doc_ref, 'stub', r.doc_id, r.doc_ref, level + 1, 1, ord, r.pos FROM res r JOIN lvl USING (doc_id) JOIN document USING (doc_id) WHERE target IS NULL AND structural),
idx AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY s, ord, pos) - 1 AS i FROM item),
par AS (SELECT 'd:' || dst AS key, 'd:' || src AS up FROM edge UNION ALL SELECT key, 'd:' || doc_id FROM item WHERE kind = 'stub'),
l0 AS (SELECT key, i AS lane FROM idx WHERE level = 0),
l1 AS (SELECT key, row_number() OVER (ORDER BY coalesce(c, i), i) - 1 AS lane FROM (SELECT x.key, x.i, avg(l0.lane) AS c FROM idx x LEFT JOIN par USING (key) LEFT JOIN l0 ON l0.key = par.up WHERE x.level = 1 GROUP BY ALL)),
l2 AS (SELECT key, row_number() OVER (ORDER BY coalesce(c, i), i) - 1 AS lane FROM (SELECT x.key, x.i, avg(l1.lane) AS c FROM idx x LEFT JOIN par USING (key) LEFT JOIN l1 ON l1.key = par.up WHERE x.level = 2 GROUP BY ALL)),
l3 AS (SELECT key, row_number() OVER (ORDER BY coalesce(c, i), i) - 1 AS lane FROM (SELECT x.key, x.i, avg(l2.lane) AS c FROM idx x LEFT JOIN par USING (key) LEFT JOIN l2 ON l2.key = par.up WHERE x.level = 3 GROUP BY ALL))
SELECT key, kind, doc_id, doc_ref, level::BIGINT AS level, lane::BIGINT AS lane FROM item JOIN (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) USING (key)"""


@query("doc_lanes", _graph_sql(_LANES).replace("\n, step", ",\nstep"))
def doc_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return graph.lanes(ws, graph.graph_of(ws)[0]).withColumn("lane", F.col("lane").cast("long"))


@query("fetch_candidates", _graph_sql("SELECT uri AS url, arg_min(doc_ref, (ord, pos)) AS doc_ref, arg_min(doc_id, (ord, pos)) AS doc_id, arg_min(structural, (ord, pos)) AS structural FROM res JOIN document USING (doc_id) WHERE target IS NULL AND regexp_matches(res.uri, '^https?:') AND (structural OR ends_with(res.uri, '.json')) GROUP BY uri"))
def fetch_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return graph.fetch_candidates(ws, resolve.resolutions(ws))


@query("removal_orphans", _graph_sql(""", asked AS (SELECT 'n' || n_nationkey AS doc_id FROM nation WHERE n_nationkey % 5 = 0),
kept(doc_id) AS (SELECT doc_id FROM root WHERE doc_id NOT IN (SELECT doc_id FROM asked) UNION SELECT dst FROM kept JOIN edge ON src = kept.doc_id WHERE dst NOT IN (SELECT doc_id FROM asked)),
dragged(doc_id) AS (SELECT doc_id FROM asked UNION SELECT dst FROM dragged JOIN edge ON src = dragged.doc_id)
SELECT doc_id, 'requested' AS kind FROM asked UNION ALL SELECT doc_id, 'orphaned' FROM dragged WHERE doc_id NOT IN (SELECT doc_id FROM asked) AND doc_id NOT IN (SELECT doc_id FROM kept)""").replace("\n, asked", ",\nasked"))
def removal_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    asked = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("doc_id"))
    return graph.removal_plan(ws, graph.graph_of(ws)[1], asked)


@query("remaining_documents", _graph_sql("SELECT doc_id, name FROM document WHERE NOT (doc_id[1] = 'n' AND doc_id[2:]::INT % 5 = 0)"))
def remaining_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    gone = table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("doc_id"))
    return workspace.remove_documents(ws, gone).document.select("doc_id", "name")


@query("informational_refs", _graph_sql("SELECT doc_id, doc_ref, uri FROM res WHERE NOT structural"))
def informational_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.informational_refs(_ws(spark, sf_dir)).select("doc_id", "doc_ref", "uri")


@query("structural_refs", _graph_sql("SELECT doc_id, doc_ref FROM used"))
def structural_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.used_refs(_ws(spark, sf_dir))


_TOPS = """below AS (SELECT doc_id, to_id AS spdx_id FROM relationship WHERE type IN ('CONTAINS', 'DEPENDS_ON') AND to_kind = 'local' UNION SELECT doc_id, from_id FROM relationship WHERE type IN ('DEPENDENCY_OF', 'CONTAINED_BY')),
free AS (SELECT doc_id, spdx_id, pos, min(pos) OVER (PARTITION BY doc_id) AS least, NOT EXISTS (SELECT 1 FROM below b WHERE b.doc_id = e.doc_id AND b.spdx_id = e.spdx_id) AS free FROM element e),
tops AS (SELECT doc_id, root AS spdx_id FROM document WHERE root IS NOT NULL UNION ALL SELECT doc_id, spdx_id FROM (SELECT *, bool_or(free) OVER (PARTITION BY doc_id) AS any_free FROM free) JOIN document d USING (doc_id) WHERE d.root IS NULL AND (free OR (NOT any_free AND pos = least)))"""


def _tree_sql(body: str) -> str:
    base = sql("", "document", "ext_ref", "pk", "element", "relationship", "binding").rstrip()
    return f"{base},\n{_RES},\n{_TOPS}{body}"


@query("doc_root_elements", _tree_sql("\nSELECT doc_id, spdx_id FROM tops"))
def doc_root_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.root_elements(_ws(spark, sf_dir)).select("doc_id", "spdx_id")


_CHILD = """,
near AS (SELECT doc_id, type, rel_index, CASE WHEN type IN ('CONTAINED_BY', 'DEPENDENCY_OF') THEN to_id ELSE from_id END AS parent_id, CASE WHEN type IN ('CONTAINED_BY', 'DEPENDENCY_OF') THEN 'local' ELSE to_kind END AS kind, to_ref AS ref, CASE WHEN type IN ('CONTAINED_BY', 'DEPENDENCY_OF') THEN from_id ELSE to_id END AS id FROM relationship),
child AS (SELECT n.doc_id, parent_id, n.doc_id AS child_doc, id AS child_id, type, NULL::VARCHAR AS placeholder_ref FROM near n SEMI JOIN element e ON e.doc_id = n.doc_id AND e.spdx_id = n.id WHERE kind = 'local' AND id <> parent_id
 UNION ALL SELECT n.doc_id, parent_id, t.doc_id, t.spdx_id, type, NULL FROM near n JOIN res r ON r.doc_id = n.doc_id AND r.doc_ref = n.ref JOIN tops t ON t.doc_id = r.target WHERE kind = 'external'
 UNION ALL SELECT n.doc_id, parent_id, NULL, NULL, type, ref FROM near n LEFT JOIN res r ON r.doc_id = n.doc_id AND r.doc_ref = n.ref WHERE kind = 'external' AND r.target IS NULL)"""


@query("child_edges", _tree_sql(f"{_CHILD}\nSELECT * FROM child"))
def child_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return graph.child_edges(ws, resolve.resolutions(ws)).select("doc_id", "parent_id", "child_doc", "child_id", "type", "placeholder_ref")


@query("subtree", _tree_sql(f"{_CHILD},\nsub(doc_id, spdx_id) AS (SELECT doc_id, spdx_id FROM element WHERE pos < 40 UNION SELECT child_doc, child_id FROM sub JOIN child c ON c.doc_id = sub.doc_id AND c.parent_id = sub.spdx_id WHERE child_id IS NOT NULL)\nSELECT doc_id, spdx_id FROM sub"))
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements at or below the first parts of all documents."""
    ws = _ws(spark, sf_dir)
    return graph.subtree_of(ws, ws.element.where("pos < 40"), limit=None).select("doc_id", "spdx_id")


@query("subtree_of_document", _tree_sql(f"{_CHILD},\nsub(doc_id, spdx_id) AS (SELECT 'n1', 'SPDXRef-DOCUMENT' UNION SELECT child_doc, child_id FROM sub JOIN child c ON c.doc_id = sub.doc_id AND c.parent_id = sub.spdx_id WHERE child_id IS NOT NULL)\nSELECT doc_id, spdx_id FROM sub"))
def subtree_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All below one nation, through the boundaries of its suppliers' documents; other documents' edges aren't made."""
    ws = _ws(spark, sf_dir)
    return graph.subtree_of(ws, ws.document.where("doc_id = 'n1'"), limit=None).select("doc_id", "spdx_id")


@query("inventory_view", _tree_sql(f"""{_CHILD},
sub(doc_id, spdx_id) AS (SELECT doc_id, spdx_id FROM element WHERE pos < 40 UNION SELECT child_doc, child_id FROM sub JOIN child c ON c.doc_id = sub.doc_id AND c.parent_id = sub.spdx_id WHERE child_id IS NOT NULL)
SELECT doc_id, spdx_id, e.name FROM element e SEMI JOIN sub USING (doc_id, spdx_id) WHERE doc_id IN ('s1', 's2', 's3', 's5') AND purpose LIKE '%BRASS'"""))
def inventory_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of four documents and some purposes, within what lies below the first parts."""
    ws = _ws(spark, sf_dir)
    below = graph.subtree_of(ws, ws.element.where("pos < 40"), limit=None)
    purposes = [r.p_type for r in table(spark, sf_dir, "part").where("p_type like '%BRASS'").select("p_type").distinct().collect()]  # a vocabulary of 150
    files_too = ws.with_tables(element=ws.element.unionByName(ws.element.withColumns({"kind": F.lit("file"), "spdx_id": F.concat(F.lit("F"), "spdx_id")})))
    return search.view(files_too, within=below, documents=["s1", "s2", "s3", "s5"], purposes=purposes).select("doc_id", "spdx_id", "name")


@query("dangling_ends", _tree_sql("\nSELECT r.doc_id, rel_index, side, spdx_id FROM (SELECT doc_id, rel_index, 'from' AS side, from_id AS spdx_id FROM relationship UNION ALL SELECT doc_id, rel_index, 'to', to_id FROM relationship WHERE to_kind = 'local') r WHERE spdx_id <> 'SPDXRef-DOCUMENT' AND NOT EXISTS (SELECT 1 FROM element e WHERE e.doc_id = r.doc_id AND e.spdx_id = r.spdx_id)"))
def dangling_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.dangling_ends(_ws(spark, sf_dir))


# Diff

_SIDES = """a AS (SELECT key, list_sort(list(DISTINCT version)) AS v, list_sort(list(DISTINCT alg || ':' || digest) FILTER (alg IS NOT NULL)) AS d, count(*) AS n, arg_min(name, suppkey * 1000000000 + pos) AS name FROM element WHERE suppkey % 4 < 2 GROUP BY key),
b AS (SELECT key, list_sort(list(DISTINCT version)) AS v, list_sort(list(DISTINCT alg || ':' || digest) FILTER (alg IS NOT NULL)) AS d, count(*) AS n, arg_min(name, suppkey * 1000000000 + pos) AS name FROM element WHERE suppkey % 4 >= 2 GROUP BY key),
diff AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.name, b.name) AS name, a.v <> b.v AS dv, coalesce(a.d <> b.d, false) AS dd, a.n IS NULL AS no_a, b.n IS NULL AS no_b FROM a FULL JOIN b ON a.key = b.key),
entry AS (SELECT key, name, CASE WHEN no_a THEN 'added' WHEN no_b THEN 'removed' WHEN dv OR dd THEN 'changed' ELSE 'unchanged' END AS change, CASE WHEN NOT no_a AND NOT no_b AND (dv OR dd) THEN concat_ws('+', CASE WHEN dv THEN 'version' END, CASE WHEN dd THEN 'digest' END) END AS reasons FROM diff)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers whose key is 0 or 1 modulo 4 against the others."""
    ws = _ws(spark, sf_dir)
    side = lambda test: conflicts.cascade_side(ws, table(spark, sf_dir, "supplier").where(test).select(F.concat(F.lit("s"), "s_suppkey").alias("doc_id")))
    return conflicts.diff(side("s_suppkey % 4 < 2"), side("s_suppkey % 4 >= 2"))


@query("diff_entries", _with(("pk", "element"), _SIDES, "SELECT * FROM entry"))
def diff_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).select("key", "name", "change", F.array_join("reasons", "+").alias("reasons"))


@query("diff_summary", _with(("pk", "element"), _SIDES, "SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'unchanged') AS unchanged FROM entry"))
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conflicts.diff_summary(_diff(spark, sf_dir))


@query("diff_digest_only", _with(("pk", "element"), _SIDES, "SELECT key, name FROM entry WHERE reasons = 'digest'"))
def diff_digest_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).where(F.col("reasons") == F.array(F.lit("digest"))).select("key", "name")


# Quality and profiles

_PACKAGES = "p AS (SELECT doc_id, count(*) AS total, count(version) AS with_version, count(*) FILTER (supplier <> 'NOASSERTION') AS with_supplier, count(purl) AS with_unique_id, count(alg) AS with_checksum, count(license) AS with_license FROM element GROUP BY doc_id)"
_ISSUES = "dang AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, from_id AS spdx_id FROM relationship UNION ALL SELECT doc_id, to_id FROM relationship WHERE to_kind = 'local') r WHERE spdx_id <> 'SPDXRef-DOCUMENT' AND NOT EXISTS (SELECT 1 FROM element e WHERE e.doc_id = r.doc_id AND e.spdx_id = r.spdx_id) GROUP BY doc_id),\nopen AS (SELECT doc_id, count(*) AS n FROM res WHERE target IS NULL AND structural GROUP BY doc_id)"


@query("quality_report", _tree_sql(f""",\n{_PACKAGES},\n{_ISSUES}
SELECT d.doc_id, true AS has_namespace, created IS NOT NULL AS has_created, len(creators) > 0 AS has_creators, d.doc_id IN (SELECT doc_id FROM relationship) AS has_relationships, coalesce(total, 0) AS total, coalesce(with_version, 0) AS with_version, coalesce(with_supplier, 0) AS with_supplier, coalesce(with_unique_id, 0) AS with_unique_id,
 coalesce(with_checksum, 0) AS with_checksum, coalesce(with_license, 0) AS with_license, coalesce(dang.n, 0) AS dangling_local_refs, coalesce(open.n, 0) AS unresolved_structural_refs, 0::BIGINT AS duplicate_spdx_ids
 FROM document d LEFT JOIN p USING (doc_id) LEFT JOIN dang USING (doc_id) LEFT JOIN open USING (doc_id)"""))
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return quality.report(ws, resolve.resolutions(ws))


@query("workspace_stats", _tree_sql("\nSELECT (SELECT count(*) FROM document) AS documents, (SELECT count(*) FROM element) AS packages, 0::BIGINT AS files, (SELECT count(*) FROM res WHERE target IS NULL AND structural) AS unresolved, 0::BIGINT AS errors, 0::BIGINT AS warnings, 0::BIGINT AS infos"))
def workspace_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = _ws(spark, sf_dir)
    return quality.workspace_stats(ws, resolve.resolutions(ws))


def _profile_sql(booleans: list[tuple[str, str]], covers: list[tuple[str, str, str]]) -> str:
    """Checks in SQL: (id, test over document) and (id, test over element, threshold or NULL)."""
    parts = [f"SELECT doc_id, '{i}' AS id, coalesce({test}, false) AS pass, NULL::BIGINT AS satisfied, NULL::BIGINT AS total, NULL::BIGINT AS percent FROM document" for i, test in booleans]
    for i, test, threshold in covers:
        n = f"(SELECT doc_id, count(*) FILTER (coalesce({test}, false)) AS s, count(*) AS t FROM element GROUP BY doc_id)"
        passed = "true" if threshold == "NULL" else f"coalesce(s, 0) * 100 >= {threshold} * coalesce(t, 0)"
        parts.append(f"SELECT doc_id, '{i}', {passed}, coalesce(s, 0), coalesce(t, 0), CASE WHEN coalesce(t, 0) = 0 THEN 100 ELSE (200 * s + t) // (2 * t) END FROM document LEFT JOIN {n} USING (doc_id)")
    return _tree_sql("\n" + "\nUNION ALL ".join(parts))


_RELATED = "doc_id IN (SELECT doc_id FROM relationship)"
_KNOWN_SUPPLIER = "supplier NOT IN ('NOASSERTION', 'NONE')"


def _evaluated(spark: SparkSession, sf_dir: str, p: profile.Profile, now: str | None = None) -> DataFrame:
    return profile.evaluate(_ws(spark, sf_dir), p, now).select("doc_id", "id", "pass", "satisfied", "total", "percent")


@query("profile_ntia", _profile_sql([("document-field-0", "len(creators) > 0"), ("document-field-1", "created IS NOT NULL"), ("document-field-2", "true"), ("relationships-3", _RELATED)], [("package-coverage-4", "true", "NULL"), ("package-coverage-5", _KNOWN_SUPPLIER, "NULL"), ("package-coverage-6", "purl IS NOT NULL", "NULL"), ("package-coverage-7", "alg IS NOT NULL", "NULL"), ("package-coverage-8", "license IS NOT NULL", "NULL")]))
def profile_ntia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, profile.NTIA)


@query("profile_cisa", _profile_sql([("document-field-0", "len(creators) = 2"), ("document-field-1", "created IS NOT NULL"), ("tool", "len(creators) > 0"), ("relationships-3", _RELATED)], [("package-coverage-4", "originator IS NOT NULL", "NULL"), ("package-coverage-5", "true", "NULL"), ("package-coverage-6", "purl IS NOT NULL", "NULL"), ("package-coverage-7", "alg IS NOT NULL", "NULL"), ("package-coverage-8", "license IS NOT NULL", "NULL")]))
def profile_cisa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, profile.CISA)


@query("profile_bsi", _profile_sql([("format-baseline", "false"), ("document-field-0", "false"), ("document-field-1", "created IS NOT NULL"), ("relationships-2", _RELATED)], [("package-coverage-3", "true", "100"), ("package-coverage-4", _KNOWN_SUPPLIER, "100"), ("package-coverage-5", "license IS NOT NULL", "100"), ("package-coverage-6", "false", "100"), ("package-coverage-7", "purl IS NOT NULL", "NULL")]))
def profile_bsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, profile.BSI)


_GATES = profile.Profile("gates", (
    profile.Check("created-recency", max_age_days=120), profile.Check("relationships", min_count=5), profile.Check("document-field", field="dataLicense", values=("CC0-1.0",)),
    profile.Check("package-coverage", field="purpose", pattern="E$", threshold=50), profile.Check("package-coverage", field="checksum", algorithms=("sha-256",), threshold=30), profile.Check("package-coverage", field="downloadLocation", threshold=80),
))


@query("profile_custom_gates", _profile_sql([("created-recency-0", "epoch(TIMESTAMP '2024-09-01') - epoch(created::TIMESTAMP) <= 120 * 86400"), ("relationships-1", "(SELECT count(*) FROM relationship r WHERE r.doc_id = document.doc_id) >= 5"), ("document-field-2", "data_license = 'CC0-1.0'")], [("package-coverage-3", "ends_with(purpose, 'E')", "50"), ("package-coverage-4", "alg = 'SHA256'", "30"), ("package-coverage-5", "download_location <> 'NOASSERTION'", "80")]))
def profile_custom_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, _GATES, "2024-09-01T00:00:00Z")


@query("profile_delivery", _profile_sql([("document-field-0", "true"), ("document-field-1", "len(creators) > 0"), ("document-field-2", "created IS NOT NULL"), ("relationships-3", _RELATED)], [("package-coverage-4", "true", "100"), ("package-coverage-5", "alg IS NOT NULL", "NULL"), ("package-coverage-6", "download_location <> 'NOASSERTION'", "NULL"), ("package-coverage-7", "purl IS NOT NULL", "NULL")]))
def profile_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluated(spark, sf_dir, profile.select(None, "ocm"))


@query("profile_values", _tree_sql("""\nSELECT doc_id, 'document-field-0' AS id, 'Document creators' AS label, CASE WHEN len(creators) > 0 THEN array_to_string(creators, ' · ') ELSE 'missing' END AS actual, NULL::DOUBLE AS threshold FROM document
UNION ALL SELECT doc_id, 'document-field-1', 'Document created', coalesce(created, 'missing'), NULL FROM document
UNION ALL SELECT doc_id, 'relationships-2', 'Relationships', (SELECT count(*) FROM relationship r WHERE r.doc_id = document.doc_id)::VARCHAR, NULL FROM document
UNION ALL SELECT doc_id, 'long', 'A long text', namespace || ' ' || repeat('x', 119 - length(namespace) - 3) || CASE WHEN doc_id[1] = 's' THEN '...' ELSE 'xxx' END, NULL FROM document
UNION ALL SELECT doc_id, 'package-coverage-4', 'Packages with version', NULL, 90 FROM document"""))
def profile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, shown values and thresholds; a text of over 120 characters is cut."""
    ws = _ws(spark, sf_dir)
    size = F.when(F.col("doc_id").startswith("s"), 130).otherwise(120)
    long = ws.document.withColumn("comment", F.rpad(F.concat("namespace", F.lit(" ")), size, F.lit("x")))
    checks = (profile.Check("document-field", field="creators"), profile.Check("document-field", field="created"), profile.Check("relationships"), profile.Check("document-field", id="long", label="A long text", field="comment"), profile.Check("package-coverage", field="version", threshold=90))
    return profile.evaluate(ws.with_tables(document=long), profile.Profile("values", checks)).select("doc_id", "id", "label", "actual", "threshold")


@query("profile_baselines", _with(("document",), "", "SELECT doc_id, ord % 5 IN (0, 2, 3) AS pass, ['SPDX-3.0.1', 'CycloneDX-1.5', 'CycloneDX-1.6', 'CycloneDX-2.0', 'SPDX-2.3'][ord % 5 + 1] AS actual FROM document"))
def profile_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of five formats against a profile that asks for two of them."""
    ws, k = _ws(spark, sf_dir), (F.col("ord") % 5).cast("int")
    models, versions = ["spdx-3", "cyclonedx", "cyclonedx", "cyclonedx", "spdx-2"], ["SPDX-3.0.1", "CycloneDX-1.5", "CycloneDX-1.6", "CycloneDX-2.0", "SPDX-2.3"]
    mixed = ws.document.withColumns({"model": F.get(F.lit(models), k), "version": F.get(F.lit(versions), k)})
    return profile.evaluate(ws.with_tables(document=mixed), profile.BSI).where("id = 'format-baseline'").select("doc_id", "pass", "actual")


@query("profile_tallies", _profile_sql([("a", "created IS NOT NULL"), ("b", "len(creators) = 2"), ("c", "len(creators) > 0"), ("d", _RELATED)], []).replace("\nSELECT doc_id, 'a'", ",\nchecks AS (SELECT doc_id, 'a'", 1) + ")\nSELECT doc_id, count(*) FILTER (pass) AS gated_passed, count(*) FILTER (NOT pass) AS gated_failed, 5::BIGINT AS informational FROM checks GROUP BY doc_id")
def profile_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.tallies(profile.evaluate(_ws(spark, sf_dir), profile.CISA))


# Vulnerability statements

_VEX = """keyed AS (SELECT doc_id, spdx_id, 'generic/' || lower(split_part(purl, '/', 2)) || '/' || split_part(split_part(purl, '/', 3), '@', 1) AS id, version FROM element WHERE purl IS NOT NULL),
hit AS (SELECT DISTINCT k.doc_id, k.spdx_id, c.ord, c.vulnerability, c.status, c.stamp FROM keyed k JOIN candidate c ON c.id = k.id AND (c.version IS NULL OR c.version = k.version)),
found AS (SELECT doc_id, spdx_id, vulnerability, status, ord AS cand_ord, n - 1 AS superseded FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, spdx_id, vulnerability) AS n, row_number() OVER (PARTITION BY doc_id, spdx_id, vulnerability ORDER BY stamp DESC NULLS LAST, ord DESC) AS k FROM hit) WHERE k = 1),
ranked AS (SELECT *, list_position(['affected', 'under_investigation', 'fixed', 'not_affected'], status) AS rank FROM found),
worst AS (SELECT doc_id, spdx_id, arg_min(status, rank) AS worst, string_agg(vulnerability || ' (' || status || ')', '; ' ORDER BY rank, vulnerability) AS cells FROM ranked GROUP BY doc_id, spdx_id)"""
_VEX_VIEWS = ("pk", "element", "document", "candidate")


def _stated(spark: SparkSession, sf_dir: str) -> tuple[Workspace, DataFrame]:
    """The workspace and its statements."""
    return _ws(spark, sf_dir), star.vex_candidates(spark, sf_dir)


def _overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, stated = _stated(spark, sf_dir)
    return vex.overlay(ws, search.inventory(search.few_documents(ws)), stated)


@query("vex_findings", _with(_VEX_VIEWS, _VEX, "SELECT doc_id, spdx_id, vulnerability, status, cand_ord FROM found"))
def vex_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vex.findings(*_stated(spark, sf_dir)).drop("superseded")


@query("vex_superseded", _with(_VEX_VIEWS, _VEX, "SELECT vulnerability, count(*) AS findings, sum(superseded)::BIGINT AS superseded FROM found GROUP BY vulnerability"))
def vex_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vex.superseded(*_stated(spark, sf_dir))


@query("vex_worst", _with(_VEX_VIEWS, _VEX, "SELECT * FROM worst"))
def vex_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vex.worst(*_stated(spark, sf_dir)).drop("findings")


@query("vex_finding_order", _with(_VEX_VIEWS, _VEX, "SELECT doc_id, spdx_id, vulnerability, row_number() OVER (PARTITION BY doc_id, spdx_id ORDER BY rank, vulnerability)::INT AS place FROM ranked"))
def vex_finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vex.ordered_findings(vex.stated(*_stated(spark, sf_dir))).select("doc_id", "spdx_id", "vulnerability", "place")


@query("vex_coverage", _with(_VEX_VIEWS, _VEX, "SELECT count(*) AS total, count(w.worst) AS covered, count(*) FILTER (w.worst IS NULL AND purl IS NOT NULL) AS uncovered, count(*) FILTER (w.worst IS NULL AND purl IS NULL) AS unmatchable FROM element LEFT JOIN worst w USING (doc_id, spdx_id)"))
def vex_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws, rows = _stated(spark, sf_dir)
    return vex.coverage(ws, vex.stated(ws, rows))


@query("vex_inventory_join", _with(_VEX_VIEWS, _VEX, "SELECT e.doc_id, d.name AS doc_name, spdx_id, e.name, w.worst AS vex_status, w.cells AS vex_vulnerabilities FROM element e JOIN document d USING (doc_id) JOIN worst w USING (doc_id, spdx_id) WHERE w.worst IN ('affected', 'fixed')"))
def vex_inventory_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vex.with_status(_overlaid(spark, sf_dir), ["affected", "fixed"]).select("doc_id", "doc_name", "spdx_id", "name", "vex_status", "vex_vulnerabilities")


@query("vex_sorted", _with(_VEX_VIEWS, _VEX, "SELECT e.doc_id, spdx_id, row_number() OVER (ORDER BY coalesce(list_position(['affected', 'under_investigation', 'fixed', 'not_affected'], w.worst), 5), lower(e.name), d.ord, e.pos) AS place FROM element e JOIN document d USING (doc_id) LEFT JOIN worst w USING (doc_id, spdx_id)"))
def vex_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _overlaid(spark, sf_dir).select("doc_id", "spdx_id", "name", "ord", "pos", "vex_status")
    return vex.placed_by_status(rows).select("doc_id", "spdx_id", "place")


_JSON_CELL = "CASE WHEN {0} IS NOT NULL THEN '\"{1}\":' || to_json({0})::VARCHAR END"
_JSON_CELLS = ", ".join(_JSON_CELL.format(c, n) for c, n in {"e.name": "name", "version": "version", "license": "license", "supplier": "supplier", "purpose": "purpose", "purl": "purl", "spdx_id": "spdxId", "'package'": "kind", "d.name": "document", "e.doc_id": "documentId", "w.worst": "vexStatus"}.items())


@query("inventory_json", _with(_VEX_VIEWS, _VEX + """,
each AS (SELECT doc_id, spdx_id, string_agg('{"vulnerability":"' || vulnerability || '","status":"' || status || '"}', ',' ORDER BY rank, vulnerability) AS l FROM ranked GROUP BY ALL)""", f"""SELECT e.doc_id, spdx_id, '{{' || concat_ws(',', {_JSON_CELLS}, CASE WHEN l IS NOT NULL THEN '"vexFindings":[' || l || ']' END) || '}}' AS json
 FROM element e JOIN document d USING (doc_id) LEFT JOIN worst w USING (doc_id, spdx_id) LEFT JOIN each USING (doc_id, spdx_id)"""))
def inventory_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.json_rows(_overlaid(spark, sf_dir)).select("doc_id", "spdx_id", "json")


# Delivered files

_CHECKED = """checked AS (SELECT 'f-' || source AS doc_id, 'F' || doc_id AS spdx_id, './texts/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 11 = 4 THEN 'missing' WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'unverifiable' WHEN doc_id % 10 = 3 THEN 'mismatch' ELSE 'match' END AS verdict,
 CASE WHEN doc_id % 11 <> 4 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 THEN 'SHA256' END AS algorithm, CASE WHEN doc_id % 11 <> 4 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 THEN sha256(coalesce(text, '')) END AS declared FROM documents)"""


@query("acceptance_files", f"WITH {_CHECKED} SELECT * FROM checked")
def acceptance_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance.check(star.file_elements(spark, sf_dir), star.delivered_files(spark, sf_dir)).select("doc_id", "spdx_id", "path", "verdict", "algorithm", "declared")


@query("acceptance_extra", "SELECT '/extra/' || doc_id || '.txt' AS path, octet_length(encode(coalesce(text, ''))) + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 25 = 0")
def acceptance_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance.extra(star.file_elements(spark, sf_dir), star.delivered_files(spark, sf_dir))


@query("acceptance_summary", f"WITH {_CHECKED} SELECT count(*) FILTER (verdict = 'match') AS match, count(*) FILTER (verdict = 'mismatch') AS mismatch, count(*) FILTER (verdict = 'missing') AS missing, count(*) FILTER (verdict = 'unverifiable') AS unverifiable, count(*) AS total, (SELECT count(*) FROM documents WHERE doc_id % 25 = 0) AS extra FROM checked")
def acceptance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, delivered = star.file_elements(spark, sf_dir), star.delivered_files(spark, sf_dir)
    return acceptance.summary(acceptance.check(files, delivered), acceptance.extra(files, delivered))


@query("delivery_algorithms", "SELECT unnest(['SHA1', 'SHA256', 'BLAKE3']) AS algorithm")
def delivery_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acceptance.delivery_algorithms(star.file_elements(spark, sf_dir))


# Batches


@query("batch_dedupe_sha1", "SELECT min(doc_id) AS ord, sha1(coalesce(text, '')) AS sha1 FROM documents GROUP BY coalesce(text, '')")
def batch_dedupe_sha1(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.sha1(F.coalesce("text", F.lit(""))).alias("sha1"))
    return workspace.new_by_content(batch.where("false"), batch).select("ord", "sha1")


@query("namespace_collision", "SELECT doc_id AS ord, lang AS old_id, CASE WHEN lang = 'en' OR row_number() OVER (PARTITION BY lang ORDER BY doc_id) > 1 THEN lang || '~dup-' || sha1(coalesce(text, ''))[1:8] ELSE lang END AS doc_id FROM documents")
def namespace_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named by language only, into a workspace that has `en`."""
    batch = table(spark, sf_dir, "documents").select(F.col("lang").alias("doc_id"), F.col("doc_id").alias("ord"), F.sha1(F.coalesce("text", F.lit(""))).alias("sha1"))
    return workspace.renamed_ids(spark.createDataFrame([("en",)], "doc_id string"), batch).select("ord", "old_id", "doc_id")


# Files written and read back


def _parsed(spark: SparkSession, sf_dir: str, write: Callable[[Workspace], DataFrame], wanted: T.StructType = files.ROW) -> DataFrame:
    """Rows of parsed files, one a document of the workspace."""
    return files.scan(write(_ws(spark, sf_dir)).select("path", "content"), wanted)


#: What _elements() takes of a parsed file.
_ELEMENT_FIELDS = files.fields(document=["name"], elements=["spdx_id", "name", "version", "purl", "supplier"])


def _elements(rows: DataFrame) -> DataFrame:
    e = rows.select(F.col("document.name").alias("doc_name"), F.explode("elements").alias("e")).select("doc_name", "e.*")
    return e.select("doc_name", "spdx_id", "name", "version", "purl", "supplier")


_BACK = "SELECT d.name AS doc_name, spdx_id, e.name, version, purl, supplier FROM element e JOIN document d USING (doc_id)"


@query("spdx_json_roundtrip", _with(("pk", "element", "document"), "", _BACK))
def spdx_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_parsed(spark, sf_dir, export.spdx_json))


@query("tagvalue_roundtrip", _with(("pk", "element", "document"), "", _BACK))
def tagvalue_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_parsed(spark, sf_dir, export.tag_value))


@query("cyclonedx_roundtrip", _with(("pk", "element", "document"), "", _BACK))
def cyclonedx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_parsed(spark, sf_dir, export.cyclonedx)).where("spdx_id <> 'document'")


@query("relationships_roundtrip", _with(("pk", "relationship", "document"), "", "SELECT d.name AS doc_name, type, from_id, to_kind, to_ref, CASE WHEN to_kind = 'external' THEN coalesce(to_id, 'SPDXRef-DOCUMENT') ELSE to_id END AS to_id FROM relationship r JOIN document d USING (doc_id) UNION ALL SELECT name, 'DESCRIBES', 'SPDXRef-DOCUMENT', 'local', NULL, root FROM document WHERE root IS NOT NULL"))
def relationships_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir, export.spdx_json)
    return rows.select(F.col("document.name").alias("doc_name"), F.explode("relationships").alias("r")).select("doc_name", "r.type", "r.from_id", "r.to_kind", "r.to_ref", "r.to_id")


@query("lint_spdx2", _with(("pk", "element", "document"), "", """SELECT name AS doc_name, 'SPDX2_SCHEMA_BAD_DATA_LICENSE' AS code FROM document WHERE data_license <> 'CC0-1.0'
UNION ALL SELECT DISTINCT d.name, 'SPDX2_SCHEMA_BAD_PACKAGE_PURPOSE' FROM element e JOIN document d USING (doc_id) WHERE purpose NOT IN ('APPLICATION', 'ARCHIVE', 'CONTAINER', 'DEVICE', 'FILE', 'FIRMWARE', 'FRAMEWORK', 'INSTALL', 'LIBRARY', 'OPERATING_SYSTEM', 'OTHER', 'SOURCE')
UNION ALL SELECT DISTINCT d.name, 'SPDX2_SCHEMA_BAD_SPDXID' FROM element e JOIN document d USING (doc_id)"""))
def lint_spdx2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir, export.spdx_json)
    return rows.select(F.col("document.name").alias("doc_name"), F.explode("diagnostics").alias("d")).where("d.code like '%\\_SCHEMA\\_%'").select("doc_name", "d.code")


@query("unknown_docrefs", _with(("pk", "relationship", "document"), "", "SELECT DISTINCT d.name AS doc_name FROM relationship r JOIN document d USING (doc_id) WHERE to_ref = 'DocumentRef-unknown'"))
def unknown_docrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir, export.spdx_json)
    return rows.where(F.exists("diagnostics", lambda d: d["code"] == "REL_UNKNOWN_DOCREF")).select(F.col("document.name").alias("doc_name"))


@query("spdx_yaml_roundtrip", _with(("pk", "element", "document"), "", _BACK))
def spdx_yaml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_parsed(spark, sf_dir, export.spdx_yaml, _ELEMENT_FIELDS))


@query("archive_roundtrip", _with(("pk", "element", "document"), "", _BACK))
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_parsed(spark, sf_dir, lambda ws: export.archived(export.tag_value(ws))))


@query("spdx3_roundtrip", _with(("pk", "element", "document"), "", "SELECT d.name AS doc_name, namespace || '#' || spdx_id AS spdx_id, e.name, version, purl, CASE WHEN supplier NOT IN ('NOASSERTION', 'NONE') THEN 'Organization: ' || supplier ELSE 'urn:org:' || supplier END AS supplier FROM element e JOIN document d USING (doc_id)"))
def spdx3_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_parsed(spark, sf_dir, export.spdx3))


@query("spdx3_relationships", _with(("pk", "relationship", "document"), "", """SELECT d.name AS doc_name, type, namespace || '#' || from_id AS from_id, namespace || '#' || to_id AS to_id FROM relationship r JOIN document d USING (doc_id) WHERE to_kind = 'local'
 UNION ALL SELECT name, 'DESCRIBES', namespace, namespace || '#' || root FROM document WHERE root IS NOT NULL"""))
def spdx3_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir, export.spdx3)
    return rows.select(F.col("document.name").alias("doc_name"), F.explode("relationships").alias("r")).select("doc_name", "r.type", "r.from_id", "r.to_id")


@query("descriptor_roundtrip", _with(("pk", "element", "document"), "", """SELECT 'example.org/td/' || doc_id AS doc_name, e.name, version, 'pkg:oci/' || lower(spdx_id) || '@' || version || '?repository_url=example.org/' || lower(spdx_id) AS purl, 'Organization: ' || d.name AS supplier FROM element e JOIN document d USING (doc_id)
 UNION ALL SELECT 'example.org/td/' || doc_id, 'example.org/td/' || doc_id, '1.0.0', NULL, 'Organization: ' || name FROM document"""))
def descriptor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_parsed(spark, sf_dir, export.descriptor)).drop("spdx_id")


@query("descriptor_references", _with(("ext_ref",), "", "SELECT 'example.org/td/' || doc_id AS doc_name, doc_ref, 'ocm://example.org/td/' || regexp_extract(uri, '([^:/]+)$', 1) || '/1.0.0' AS uri FROM (SELECT doc_id, uri, 'DocumentRef-' || regexp_replace(doc_ref, '[^A-Za-z0-9.-]', '-', 'g') AS doc_ref FROM ext_ref)"))
def descriptor_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir, export.descriptor)
    return rows.select(F.col("document.name").alias("doc_name"), F.explode("ext_refs").alias("r")).select("doc_name", "r.doc_ref", "r.uri")


def _facts(spark: SparkSession, sf_dir: str, write: Callable[[Workspace], DataFrame]) -> DataFrame:
    d = _parsed(spark, sf_dir, write).select("document.*")
    return d.select("name", "namespace", "spdx_id", "version", "created", F.array_join("creators", "|").alias("creators"), "data_license", F.array_join("describes", "|").alias("describes"))


_FACTS = _with(("document",), "", "SELECT name, namespace, 'SPDXRef-DOCUMENT' AS spdx_id, 'SPDX-2.3' AS version, created, array_to_string(creators, '|') AS creators, data_license, coalesce(root, '') AS describes FROM document")


@query("document_facts_json", _FACTS)
def document_facts_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, export.spdx_json)


@query("document_facts_tags", _FACTS)
def document_facts_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir, export.tag_value)


_DETAILS = _with(("pk", "element", "document"), "", "SELECT d.name AS doc_name, spdx_id, originator, download_location, license_concluded, license_declared, purpose, alg || ':' || digest AS sums, 'PACKAGE-MANAGER purl ' || purl AS refs FROM element e JOIN document d USING (doc_id)")


def _details(spark: SparkSession, sf_dir: str, write: Callable[[Workspace], DataFrame]) -> DataFrame:
    e = _parsed(spark, sf_dir, write).select(F.col("document.name").alias("doc_name"), F.explode("elements").alias("e")).select("doc_name", "e.*")
    sums = F.array_join(F.transform("checksums", lambda c: F.concat(c["algorithm"], F.lit(":"), c["value"])), "|")
    refs = F.array_join(F.transform("external_refs", lambda r: F.concat_ws(" ", r["category"], r["type"], r["locator"])), "|")
    return e.select("doc_name", "spdx_id", "originator", "download_location", "license_concluded", "license_declared", "purpose", sums.alias("sums"), refs.alias("refs"))


@query("element_details_json", _DETAILS)
def element_details_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir, export.spdx_json)


@query("element_details_tags", _DETAILS)
def element_details_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _details(spark, sf_dir, export.tag_value)


_REFS = _with(("ext_ref", "document"), "", "SELECT d.name AS doc_name, doc_ref, uri, CASE WHEN sum IS NOT NULL THEN 'SHA1' END AS checksum_alg, sum AS checksum_value FROM ext_ref JOIN document d USING (doc_id)")


def _refs_back(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("document.name").alias("doc_name"), F.explode("ext_refs").alias("r")).select("doc_name", "r.doc_ref", "r.uri", "r.checksum_alg", "r.checksum_value")


@query("ext_refs_json", _REFS)
def ext_refs_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs_back(_parsed(spark, sf_dir, export.spdx_json))


@query("ext_refs_tags", _REFS)
def ext_refs_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs_back(_parsed(spark, sf_dir, export.tag_value))


@query("cyclonedx_dependencies", _with(("pk", "element", "relationship", "document"), "", """SELECT DISTINCT d.name AS doc_name, from_id, to_id FROM relationship r JOIN document d USING (doc_id) SEMI JOIN element a ON a.doc_id = r.doc_id AND a.spdx_id = r.from_id SEMI JOIN element b ON b.doc_id = r.doc_id AND b.spdx_id = r.to_id WHERE type IN ('CONTAINS', 'DEPENDS_ON') AND to_kind = 'local'"""))
def cyclonedx_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir, export.cyclonedx)
    return rows.select(F.col("document.name").alias("doc_name"), F.explode("relationships").alias("r")).where("r.type = 'DEPENDS_ON'").select("doc_name", "r.from_id", "r.to_id")


def _repeated(ws: Workspace) -> DataFrame:
    """Files in which every seventh part's package is written once more under its identifier."""
    again = ws.element.where("pos % 7 = 0").withColumns({"pos": F.col("pos") + 1_000_000_000, "name": F.concat("name", F.lit(" again"))})
    return export.spdx_json(ws.with_tables(element=ws.element.unionByName(again)))


@query("dedupe_spdxid", _with(("pk", "element", "document"), "", _BACK))
def dedupe_spdxid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(_parsed(spark, sf_dir, _repeated))


@query("repeated_spdxids", _with(("pk", "element", "document"), "", "SELECT d.name AS doc_name, count(*) || ' elements repeat an identifier; the first of each is kept' AS message FROM element e JOIN document d USING (doc_id) WHERE pos % 7 = 0 GROUP BY d.name"))
def repeated_spdxids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parsed(spark, sf_dir, _repeated)
    return rows.select(F.col("document.name").alias("doc_name"), F.explode("diagnostics").alias("d")).where("d.code = 'DUP_SPDXID'").select("doc_name", "d.message")


def _findings(spark: SparkSession, sf_dir: str, write: Callable[[Workspace], DataFrame]) -> DataFrame:
    rows = _parsed(spark, sf_dir, write)
    return rows.select(F.col("document.name").alias("doc_name"), F.explode("diagnostics").alias("d")).where("d.code like '%\\_SCHEMA\\_%'").select("doc_name", "d.code", "d.message")


@query("lint_spdx2_messages", _with(("pk", "element", "document"), "", """SELECT d.name AS doc_name, 'SPDX2_SCHEMA_BAD_SPDXID' AS code, count(*) || ': ' || array_to_string(list(spdx_id ORDER BY pos)[1:3], ', ') || CASE WHEN count(*) > 3 THEN ', ...' ELSE '' END AS message FROM element e JOIN document d USING (doc_id) GROUP BY d.name"""))
def lint_spdx2_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, export.spdx_json).where("code like '%BAD_SPDXID'")


def _damaged_spdx3(ws: Workspace) -> DataFrame:
    """SPDX 3 files whose relationships all lose their type, and whose hashes are of an unknown algorithm."""
    text = F.replace(F.replace(F.decode("content", "utf-8"), F.lit('"relationshipType"'), F.lit('"lost"')), F.lit('"algorithm":"sha'), F.lit('"algorithm":"sho'))
    return export.spdx3(ws).withColumn("content", text.cast("binary"))


@query("lint_spdx3", _with(("pk", "element", "relationship", "document"), "", """SELECT DISTINCT d.name AS doc_name, 'SPDX3_SCHEMA_BAD_HASH' AS code FROM element JOIN document d USING (doc_id) WHERE alg IS NOT NULL
 UNION ALL SELECT DISTINCT d.name, 'SPDX3_SCHEMA_INCOMPLETE_RELATIONSHIP' FROM relationship JOIN document d USING (doc_id) WHERE to_kind = 'local'
 UNION ALL SELECT DISTINCT d.name, 'SPDX3_SCHEMA_DANGLING_REF' FROM relationship r JOIN document d USING (doc_id) WHERE to_kind = 'local' AND NOT (EXISTS (SELECT 1 FROM element e WHERE e.doc_id = r.doc_id AND e.spdx_id = r.from_id) AND EXISTS (SELECT 1 FROM element e WHERE e.doc_id = r.doc_id AND e.spdx_id = r.to_id))"""))
def lint_spdx3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, _damaged_spdx3).drop("message")


def _damaged_cyclonedx(ws: Workspace) -> DataFrame:
    text = F.replace(F.replace(F.decode("content", "utf-8"), F.lit('"type":"library"'), F.lit('"type":"toy"')), F.lit('"pkg:'), F.lit('"pgk:'))
    return export.cyclonedx(ws).withColumn("content", text.cast("binary"))


@query("lint_cyclonedx", _with(("pk", "element", "document"), "", """SELECT d.name AS doc_name, 'CDX_SCHEMA_BAD_COMPONENT_TYPE' AS code FROM element JOIN document d USING (doc_id) GROUP BY d.name
 UNION ALL SELECT d.name, 'CDX_SCHEMA_BAD_PURL' FROM element JOIN document d USING (doc_id) WHERE purl IS NOT NULL GROUP BY d.name"""))
def lint_cyclonedx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, _damaged_cyclonedx).drop("message")


def _damaged_descriptor(ws: Workspace) -> DataFrame:
    text = F.replace(F.replace(F.decode("content", "utf-8"), F.lit('"relation":"local"'), F.lit('"relation":"odd"')), F.lit('"normalisationAlgorithm":"genericBlobDigest/v1",'), F.lit(""))
    return export.descriptor(ws).withColumn("content", text.cast("binary"))


@query("lint_descriptor", _with(("pk", "element", "document"), "", """SELECT 'example.org/td/' || doc_id AS doc_name, 'OCM_SCHEMA_BAD_RELATION' AS code FROM element GROUP BY doc_id
 UNION ALL SELECT 'example.org/td/' || doc_id, 'OCM_SCHEMA_DIGEST_INCOMPLETE' FROM element WHERE alg IS NOT NULL GROUP BY doc_id
 UNION ALL SELECT DISTINCT 'example.org/td/' || doc_id, 'OCM_SCHEMA_DUPLICATE_IDENTITY' FROM (SELECT doc_id FROM element GROUP BY doc_id, name, version HAVING count(*) > 1)"""))
def lint_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, _damaged_descriptor).drop("message")


_STATED = "SELECT event_id AS ord, 'CVE-2024-' || event_id % 40 AS vulnerability, CASE event_type WHEN 'error' THEN 'affected' WHEN 'signup' THEN 'under_investigation' WHEN 'purchase' THEN 'fixed' ELSE 'not_affected' END AS status, 'pkg:generic/' || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-') || CASE WHEN event_id % 3 <> 0 THEN '@' || p_size ELSE '' END AS ref, CASE WHEN event_id % 19 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') ELSE 'no date' END AS stamp, event_id // 1000 AS f FROM events JOIN part ON user_id = p_partkey WHERE event_type <> 'click'"


def _advisories(spark: SparkSession, sf_dir: str, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Statements written as files of a thousand events each, and read back."""
    rows = star.vex_candidates(spark, sf_dir).withColumn("vex_ord", F.floor(F.col("cand_ord") / 1000))
    return statements.assembled(statements.scan(write(rows)))


@query("vex_openvex_roundtrip", f"SELECT 'urn:vex:' || f AS document, vulnerability, status, ref, stamp AS timestamp, row_number() OVER (PARTITION BY f ORDER BY ord) - 1 AS place, dense_rank() OVER (ORDER BY f) - 1 AS vex_ord FROM ({_STATED})")
def vex_openvex_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _advisories(spark, sf_dir, export.openvex)
    return rows.select("document", "vulnerability", "status", "ref", "timestamp", (F.col("cand_ord") % statements.DOCUMENT_SPAN).alias("place"), "vex_ord")


@query("vex_csaf_roundtrip", f"SELECT 'advisory-' || f AS document, vulnerability, status, ref, '2024-01-01T00:00:00Z' AS timestamp, row_number() OVER (PARTITION BY f ORDER BY ord) - 1 AS place FROM ({_STATED})")
def vex_csaf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _advisories(spark, sf_dir, export.csaf)
    return rows.select("document", "vulnerability", "status", "ref", "timestamp", (F.col("cand_ord") % statements.DOCUMENT_SPAN).alias("place"))


# Small rules


#: Expressions around a part's brand, and whether each is well formed.
_EXPRESSIONS = [
    ("{}", True), ("{} AND MIT", True), ("({} OR MIT) AND ISC", True), ("{} WITH x", True), ("DocumentRef-a:LicenseRef-{}", True), ("{}+", True), ("({}", False), ("{})", False), ("{} and MIT", False), ("{} MIT", False),
    ("{} AND", False), ("NONE OR {}", False), ("LicenseRef-{}:a", False), ("{} WITH (x)", False), ("", False), ("NOASSERTION", True),
]


@query("license_expr_errors", "SELECT p_partkey, replace(e, '{}', replace(p_brand, '#', '-')) AS expression, good FROM part JOIN (VALUES " + ", ".join(f"({i}, '{e}', {good})" for i, (e, good) in enumerate(_EXPRESSIONS)) + f") v(i, e, good) ON p_partkey % {len(_EXPRESSIONS)} = i")
def license_expr_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each expression is well formed. The grammar nests, so the SQL has the answer for each form, not the rule."""
    form = F.get(F.array(*(F.lit(e) for e, _ in _EXPRESSIONS)), (F.col("p_partkey") % len(_EXPRESSIONS)).cast("int"))
    expression = F.replace(form, F.lit("{}"), F.replace("p_brand", F.lit("#"), F.lit("-")))
    return table(spark, sf_dir, "part").select("p_partkey", expression.alias("expression"), text.license_expression_error(expression).isNull().alias("good"))


@query("format_bytes", "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (n * 20 + 1024) // 2048 // 10 || '.' || (n * 20 + 1024) // 2048 % 10 || ' KB' ELSE (n * 20 + 1048576) // 2097152 // 10 || '.' || (n * 20 + 1048576) // 2097152 % 10 || ' MB' END AS shown FROM (SELECT doc_id, n_chars * n_chars // 7 * 1024 // 512 AS n FROM documents)")
def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "n_chars * n_chars div 7 * 1024 div 512 AS n")
    return rows.select("doc_id", text.format_bytes(F.col("n")).alias("shown"))


@query("version_tags", "SELECT p_partkey, p_size || '.0.build-' || p_partkey || '+x' AS tag, p_size || '.0+' || p_partkey || '+x' AS version FROM part")
def version_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.concat(F.col("p_size").cast("string"), F.lit(".0+"), F.col("p_partkey").cast("string"), F.lit("+x"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.tag_from_version(version).alias("tag"))
    return rows.withColumn("version", text.version_from_tag(F.col("tag")))


@query("deep_links", "SELECT user_id AS id, url, row_number() OVER (PARTITION BY user_id ORDER BY p)::INT AS place FROM (SELECT user_id, 'http://e/' || event_id % 20 AS url, min(event_id) AS p FROM events WHERE event_id % 3 <> 0 GROUP BY ALL) QUALIFY place <= 8")
def deep_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 8 links of a row is the feature."""
    e = table(spark, sf_dir, "events")
    url = F.concat(F.when(F.col("event_id") % 3 == 0, "ftp://e/").otherwise("http://e/"), (F.col("event_id") % 20).cast("string"))
    rows = e.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", url.alias("u")))), lambda x: x["u"]).alias("urls"))
    return text.deep_links(rows)


@query("relationship_list", _with(("pk", "relationship"), "", "SELECT doc_id, from_id AS spdx_id, 'out' AS side, type, coalesce(to_ref || coalesce(':' || to_id, ''), to_id) AS other FROM relationship WHERE from_kind = 'local' UNION ALL SELECT doc_id, to_id, 'in', type, from_id FROM relationship WHERE to_kind = 'local'"))
def relationship_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ws(spark, sf_dir).relationship
    end = lambda s: identity.element_ref_text(F.col(f"{s}_kind"), F.col(f"{s}_ref"), F.col(f"{s}_id"))
    side = lambda own, far, name: r.where(F.col(f"{own}_kind") == "local").select("doc_id", F.col(f"{own}_id").alias("spdx_id"), F.lit(name).alias("side"), "type", end(far).alias("other"))
    return side("from", "to", "out").unionByName(side("to", "from", "in"))


@query("format_counts", r"SELECT doc_id, regexp_replace(reverse(regexp_replace(reverse((n_chars * doc_id)::VARCHAR), '(\d{3})', '\1,', 'g')), '^,', '') AS shown FROM documents")
def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.format_count(F.col("n_chars") * F.col("doc_id")).alias("shown"))


@query("registry_versions", "SELECT p_brand AS component, array_to_string(list_sort(list(p_size || '.0+' || p_partkey)), ' ') AS versions FROM part GROUP BY p_brand")
def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("component")).agg(F.collect_list(F.concat(F.col("p_size").cast("string"), F.lit(".0.build-"), F.col("p_partkey").cast("string"))).alias("tags"))
    return tags.select("component", F.array_join(text.registry_versions(F.col("tags")), " ").alias("versions"))


@query("element_ids", _with(("pk", "element", "document"), "", "SELECT namespace AS doc_id, spdx_id, namespace || '#' || spdx_id AS element_id FROM element JOIN document USING (doc_id) UNION ALL SELECT 'urn:bomweave:sha1:' || sha1, NULL, NULL FROM document"))
def element_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element ids made and split again, and the ids of documents without a namespace."""
    ws = _ws(spark, sf_dir)
    rows = ws.element.select("doc_id", "spdx_id").join(ws.document.select("doc_id", "namespace", "sha1"), "doc_id")
    made = rows.select(identity.element_id(identity.document_id(F.concat(F.lit(" "), "namespace"), F.col("sha1")), F.col("spdx_id")).alias("element_id"))
    nameless = ws.document.select(identity.document_id(F.lit(" "), F.col("sha1")).alias("doc_id"), F.lit(None).cast("string").alias("spdx_id"), F.lit(None).cast("string").alias("element_id"))
    return made.withColumn("x", identity.split_element_id(F.col("element_id"))).select("x.doc_id", "x.spdx_id", "element_id").unionByName(nameless)


# Blobs


_BLOB = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{\"id\": ' || doc_id || '}' WHEN 1 THEN '--- # ' || doc_id WHEN 2 THEN 'words ' || doc_id WHEN 3 THEN chr(1) || doc_id || ':' ELSE '[' || doc_id END AS t FROM documents"


def _blob() -> F.Column:
    own, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    return F.when(k == 0, F.concat(F.lit('{"id": '), own, F.lit("}"))).when(k == 1, F.concat(F.lit("--- # "), own)).when(k == 2, F.concat(F.lit("words "), own)).when(k == 3, F.concat(F.lit("\x01"), own, F.lit(":"))).otherwise(F.concat(F.lit("["), own))


@query("blob_kinds", f"SELECT doc_id::VARCHAR AS path, CASE doc_id % 5 WHEN 0 THEN 'json' WHEN 1 THEN 'yaml' WHEN 3 THEN 'yaml' ELSE 'text' END AS kind, octet_length(encode(t))::BIGINT AS size, t AS preview FROM ({_BLOB})")
def blob_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), _blob().cast("binary").alias("content"))
    return blobs.scan(rows).select("path", "kind", "size", "preview")


@query("blob_verdicts", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'match' WHEN 1 THEN 'match' WHEN 2 THEN 'mismatch' WHEN 3 THEN CASE WHEN doc_id % 4 = 3 THEN 'match' ELSE 'unchecked' END WHEN 4 THEN 'unchecked' END AS verdict,
 CASE doc_id % 6 WHEN 0 THEN 'match' WHEN 1 THEN CASE WHEN doc_id % 2 = 1 THEN 'unchecked' ELSE 'mismatch' END WHEN 2 THEN CASE WHEN doc_id % 4 = 0 THEN 'unchecked' ELSE 'mismatch' END WHEN 3 THEN 'unchecked' WHEN 4 THEN 'match' END AS indexed FROM documents""")
def blob_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared digests of blobs, packed or not, by normalisation, and the same where only an index is known."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 6
    stored, unpacked, manifest = F.sha2(F.concat(F.lit("s"), "doc_id"), 256), F.sha2(F.concat(F.lit("u"), "doc_id"), 256), F.sha2(F.concat(F.lit("m"), "doc_id"), 256)
    declared = F.when(k == 0, F.upper(stored)).when(k == 1, unpacked).when(k == 2, F.sha2(F.lit("other"), 256)).when(k == 3, manifest).when(k == 4, stored)
    rule = F.when(k < 3, "genericBlobDigest/v1").when(k == 3, "ociArtifactDigest/v1").otherwise("odd/v1")
    own = F.when(F.col("doc_id") % 4 == 3, manifest)
    gzipped = F.when(k == 1, F.col("doc_id") % 2 == 1).when(k == 2, F.col("doc_id") % 4 == 0).otherwise(F.lit(False))
    algorithm = F.when(k == 3, "SHA-512").otherwise("sha256")
    return d.select("doc_id", acceptance.blob_verdict(rule, declared, stored, unpacked, own).alias("verdict"), acceptance.indexed_verdict(algorithm, declared, stored, gzipped).alias("indexed"))


@query("verifiable_files", "SELECT doc_id % 13 = 0 AS odd, doc_id % 13 <> 0 AS verifiable FROM (VALUES (13), (1)) v(doc_id)")
def verifiable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = star.file_elements(spark, sf_dir)
    found = [(odd, acceptance.has_verifiable_files(every.where(f"pos % 13 {'=' if odd else '<>'} 0"))) for odd in (True, False)]
    return spark.createDataFrame(found, "odd boolean, verifiable boolean")


@query("common_folder", "SELECT 'texts' AS folder")
def common_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.file_elements(spark, sf_dir).select(identity.normalized_path(F.col("name")).alias("path"))
    return text.common_folder(rows)


# Trees


@query("tree_rows")
def tree_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that show when every root is open: what a user sees, made on the driver."""
    forest = tree.Forest(_ws(spark, sf_dir))
    rows = [(k, n.depth, n.kind, n.doc_id, n.name, n.edge) for k, n in enumerate(forest.visible([r.path for r in forest.roots]))]
    return spark.createDataFrame(rows, "place int, depth int, kind string, doc_id string, name string, edge string")


@query("reveal_paths")
def reveal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of the best 20 hits of a search and of their ancestors, in tree order; a filter shows so few."""
    ws = _ws(spark, sf_dir)
    hits = [(r.doc_id, r.spdx_id) for r in search.search(ws, "brand", limit=20).select("doc_id", "spdx_id").collect()]
    paths, _, _ = tree.Forest(ws).filtered(hits)
    return spark.createDataFrame([(k, len(p) - 1, "/".join(p)) for k, p in enumerate(paths)], "place int, depth int, path string")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_conflicts(spark, sf_dir)

