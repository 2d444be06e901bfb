"""A cascade of files through the whole engine: intake, resolution, graph, conflicts, diff, quality, tree, stream."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from bomweave.functions import identity
from bomweave.model import Workspace
from bomweave.operators import acceptance, conflicts, graph, profile, quality, resolve, search, tree, vex, workspace
from bomweave.sources import files, star
from bomweave.streaming import ingest


def package(name, version, **more):
    return {"SPDXID": f"SPDXRef-{name}", "name": name, "versionInfo": version, "downloadLocation": "NOASSERTION", "licenseConcluded": "MIT", "externalRefs": [{"referenceCategory": "PACKAGE-MANAGER", "referenceType": "purl", "referenceLocator": f"pkg:generic/yard/{name}@{version}"}], **more}


def relation(a, kind, b):
    return {"spdxElementId": a, "relationshipType": kind, "relatedSpdxElement": b}


def sbom(name, packages, relations, refs=(), describes=()):
    return {
        "spdxVersion": "SPDX-2.3", "dataLicense": "CC0-1.0", "SPDXID": "SPDXRef-DOCUMENT", "name": name, "documentNamespace": f"https://example.org/{name}", "creationInfo": {"created": "2024-01-02T03:04:05Z", "creators": ["Tool: t"]},
        "documentDescribes": list(describes), "packages": packages, "relationships": relations, "externalDocumentRefs": [{"externalDocumentId": r, "spdxDocument": u, **({"checksum": {"algorithm": "SHA1", "checksumValue": c}} if c else {})} for r, u, c in refs],
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """root leads to mid by checksum, mid to leaf by namespace; mid's reference to the desk has a wrong checksum."""
    out = tmp_path_factory.mktemp("cascade")
    leaf = sbom("keel-base", [package("ropelib", "12.4"), package("tarlib", "0.7"), package("cleat", "2.2")], [relation("SPDXRef-ropelib", "DEPENDS_ON", "SPDXRef-tarlib"), relation("SPDXRef-tarlib", "CONTAINS", "SPDXRef-cleat")])
    mid = sbom("loom-suite", [package("weaver", "1.0"), package("ropelib", "13.1")], [relation("SPDXRef-weaver", "CONTAINS", "SPDXRef-ropelib"), relation("SPDXRef-weaver", "DEPENDS_ON", "DocumentRef-keel:SPDXRef-DOCUMENT"), relation("SPDXRef-weaver", "DEPENDS_ON", "DocumentRef-lantern-7.4:SPDXRef-x")],
               [("DocumentRef-keel", "https://example.org/keel-base", None), ("DocumentRef-lantern-7.4", "https://example.org/elsewhere.spdx.json", "0" * 40), ("DocumentRef-survey", "https://example.org/survey.pdf", None)], ["SPDXRef-weaver"])
    text = json.dumps(mid)
    root = sbom("harbor", [package("harbor", "31")], [relation("SPDXRef-harbor", "CONTAINS", "DocumentRef-loom:SPDXRef-DOCUMENT")], [("DocumentRef-loom", "https://example.org/moved", hashlib.sha1(text.encode()).hexdigest())], ["SPDXRef-harbor"])
    desk = sbom("lantern-desk", [package("lantern", "7.4")], [])
    for name, value in (("a-desk.spdx.json", json.dumps(desk)), ("b-root.spdx.json", json.dumps(root)), ("c-mid.spdx.json", text), ("d-leaf.spdx.json", json.dumps(leaf)), ("e-copy.spdx.json", text), ("notes.txt", "hello")):
        (out / name).write_text(value)
    return str(out)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return files.read_rows(spark, folder)


@pytest.fixture(scope="module")
def ws(rows):
    return files.to_workspace(rows)


ID = "https://example.org/{}".format


def test_intake(ws, rows):
    assert [r.name for r in ws.document.orderBy("ord").collect()] == ["lantern-desk", "harbor", "loom-suite", "keel-base"]
    assert [tuple(r) for r in files.failures(rows).select("file_name", "code").collect()] == [("notes.txt", "UNRECOGNIZED_FORMAT")]


def test_profiles_are_sifted(spark, folder, tmp_path):
    """A profile in a folder is no failed document; files that end otherwise are left alone."""
    profile_ = {"schema": "yard-profile/v2", "name": "p", "checks": [{"type": "document-field", "field": "name"}]}
    (tmp_path / "p.json").write_text(json.dumps(profile_))
    (tmp_path / "q.json").write_text(json.dumps({**profile_, "checks": []}))
    (tmp_path / "z.txt").write_text("words")
    (tmp_path / "a.spdx.json").write_text(json.dumps(sbom("one", [package("a", "1")], [])))
    assert [r.name for r in files.read_workspace(spark, str(tmp_path)).document.collect()] == ["one"]
    assert files.failures(files.read_rows(spark, str(tmp_path), files.EXTENSIONS)).count() == 0
    from bomweave.sources.statements import read_profiles

    (_, good, none), (_, bad, wrong) = read_profiles(spark, str(tmp_path))
    assert good.name == "p" and not none and bad is None and wrong


def test_resolution(ws):
    resolved = {r.doc_ref: r for r in resolve.resolutions(ws).collect()}
    assert (resolved["DocumentRef-loom"].method, resolved["DocumentRef-keel"].method) == ("checksum", "namespace")
    desk, survey = resolved["DocumentRef-lantern-7.4"], resolved["DocumentRef-survey"]
    assert (desk.status, desk.structural, survey.structural) == ("unresolved", True, False)
    assert [tuple(r) for r in resolve.suggestions(ws, resolve.resolutions(ws)).collect()] == [(ID("loom-suite"), "DocumentRef-lantern-7.4", ID("lantern-desk"), "looks like lantern-desk")]
    bound = workspace.bind(ws, ID("loom-suite"), "DocumentRef-lantern-7.4", ID("lantern-desk"))
    assert resolve.resolutions(bound).where("method = 'manual'").count() == 1
    assert resolve.resolutions(workspace.bind(bound, ID("loom-suite"), "DocumentRef-lantern-7.4", None)).where("method = 'manual'").count() == 0


def test_document_graph(ws):
    resolved, edges = graph.graph_of(ws)
    assert {(r.doc_id, r.level, r.is_root) for r in graph.levels(ws, edges).collect()} == {(ID("lantern-desk"), 0, True), (ID("harbor"), 0, True), (ID("loom-suite"), 1, False), (ID("keel-base"), 2, False)}
    lanes = {r.key: (r.level, r.lane) for r in graph.lanes(ws, resolved).collect()}
    assert len(lanes) == 5 and sorted(lane for level, lane in lanes.values() if level == 2) == [0, 1]
    assert [r.url for r in graph.fetch_candidates(ws, resolved).collect()] == ["https://example.org/elsewhere.spdx.json"]
    assert graph.reachable(ws.document.where("name = 'harbor'"), edges).count() == 3
    plan = {(r.doc_id, r.kind) for r in graph.removal_plan(ws, edges, ws.document.where("name = 'loom-suite'")).collect()}
    assert plan == {(ID("loom-suite"), "requested"), (ID("keel-base"), "orphaned")}


def test_inventory_and_conflicts(ws):
    rows = search.inventory(ws)
    assert [r.name for r in search.sort_inventory(rows, "name").collect()] == ["cleat", "harbor", "lantern", "ropelib", "ropelib", "tarlib", "weaver"]
    hits = search.search(ws, "ROPELIB 12").collect()
    assert [(r.version, r.total) for r in hits] == [("12.4", 1)]
    assert [r.name for r in search.search(ws, "rplb").collect()] == ["ropelib", "ropelib"]
    group = conflicts.version_conflicts(ws).collect()
    assert [(r.key, r.versions, r.total) for r in group] == [("purl:pkg:generic/yard/ropelib", ["12.4", "13.1"], 2)]
    csv = search.to_csv(rows.orderBy("ord", "pos"))
    assert csv.startswith("name,version,license") and csv.endswith("\r\n") and len(json.loads(search.to_json(rows))) == 7


def test_diff(ws):
    side = lambda name: conflicts.cascade_side(ws, ws.document.where(F.col("name") == name))
    found = conflicts.diff(side("loom-suite"), side("keel-base"))
    assert {(r.name, r.change) for r in found.collect()} == {("weaver", "removed"), ("tarlib", "added"), ("cleat", "added"), ("ropelib", "changed")}
    assert "ropelib 13.1 → 12.4" in conflicts.diff_markdown(found, "loom-suite", "keel-base")


def test_quality_and_profile(ws):
    resolved = resolve.resolutions(ws)
    report = {r.doc_id: r for r in quality.report(ws, resolved).collect()}
    assert (report[ID("loom-suite")].unresolved_structural_refs, report[ID("loom-suite")].dangling_local_refs, report[ID("loom-suite")].with_version) == (1, 0, 2)
    results = profile.evaluate(ws, profile.NTIA)
    assert "| Packages with version | 2/2 | 100 % |" in profile.markdown(results, profile.NTIA, ID("loom-suite"), "loom-suite")
    assert quality.workspace_stats(ws, resolved).first().packages == 7


def test_tree(ws):
    forest = tree.Forest(ws)
    release = forest.roots[1]
    everything, capped = forest.subtree_paths(release)
    assert not capped and forest.subtree_paths(release, 1)[1]
    names = [(n.kind, n.name) for n in forest.visible(everything)]
    assert ("element", "SPDXRef-ropelib") in names and ("placeholder", "DocumentRef-lantern-7.4") in names and ("placeholder", "DocumentRef-survey") in names
    path = forest.reveal(ID("keel-base"), "SPDXRef-tarlib")
    assert path and path[0] == f"d:{ID('harbor')}" and path[-1] == f"e:{ID('keel-base')}#SPDXRef-tarlib" and len(path) == 5
    paths, shown, total = forest.filtered([(ID("keel-base"), "SPDXRef-tarlib"), ("none", "x")])
    assert (shown, total) == (1, 2) and path in paths
    assert tree.pruned(everything, {ID("loom-suite")}) != everything
    start = ws.document.where("name = 'harbor'").select("doc_id", F.lit("SPDXRef-harbor").alias("spdx_id"))
    assert graph.subtree(start, graph.child_edges(ws, resolve.resolutions(ws))).count() == 6


def test_cycle(spark):
    doc = files.parse_text(json.dumps(sbom("c", [package("a", "1"), package("b", "1")], [relation("SPDXRef-a", "CONTAINS", "SPDXRef-b"), relation("SPDXRef-b", "CONTAINS", "SPDXRef-a")], (), ["SPDXRef-a"])), "c").row("c", "00", 1, 0)
    ws = files.to_workspace(spark.createDataFrame([doc], files.ROW))
    forest = tree.Forest(ws)
    everything, _ = forest.subtree_paths(forest.roots[0])
    assert [(n.kind, n.name) for n in forest.visible(everything)] == [("document", None), ("element", "SPDXRef-a"), ("element", "SPDXRef-b"), ("cycle", "SPDXRef-a")]
    assert graph.subtree(ws.document.select("doc_id", F.lit("SPDXRef-a").alias("spdx_id")), graph.child_edges(ws, resolve.resolutions(ws))).count() == 2


def test_statements(ws, spark):
    rows = [(0, "CVE-1", "affected", "pkg:Generic/Yard/ropelib@12.4", "2024-01-01T00:00:00Z"), (1, "CVE-1", "fixed", "pkg:generic/yard/ropelib", "2023-01-01T00:00:00Z"), (2, "CVE-1", "not_affected", "pkg:generic/yard/ropelib", "never"), (3, "CVE-2", "fixed", "pkg:generic/yard/tarlib@9", None)]
    found = vex.findings(ws, spark.createDataFrame(rows, "cand_ord long, vulnerability string, status string, ref string, timestamp string"))
    assert {(r.spdx_id, r.status, r.superseded) for r in found.collect()} == {("SPDXRef-ropelib", "affected", 2), ("SPDXRef-ropelib", "fixed", 1)}
    cover = vex.coverage(ws, found).first()
    assert (cover.total, cover.covered, cover.uncovered, cover.unmatchable) == (7, 2, 5, 0)


def test_removal_and_second_batch(ws):
    less = workspace.remove_documents(ws, ws.document.where("name = 'keel-base'"))
    assert less.document.count() == 3 and resolve.resolutions(less).where("status = 'resolved'").count() == 1
    again = workspace.add_documents(less, ws)
    assert again.document.count() == 4 and again.element.count() == ws.element.count()


def test_stream_equals_batch(spark, folder, ws, tmp_path):
    ingest.start(spark, folder, str(tmp_path / "parses"), str(tmp_path / "check")).awaitTermination(120)
    own = ingest.workspace(spark, str(tmp_path / "parses"))
    for name in ("document", "element", "relationship", "ext_ref"):
        assert sorted(map(repr, getattr(own, name).collect())) == sorted(map(repr, getattr(ws, name).collect()))


def test_delivery(spark):
    sums = lambda b: [("SHA1", hashlib.sha1(b).hexdigest()), ("sha-256", hashlib.sha256(b).hexdigest())]
    elements = spark.createDataFrame([("d", str(i), "file", n, c) for i, (n, c) in enumerate([("./a", sums(b"a")), ("./b", sums(b"b")), ("c", sums(b"c")), ("dir/d", None), ("e", [("MD2", "0")])])], "doc_id string, spdx_id string, kind string, name string, checksums array<struct<algorithm:string,value:string>>")
    delivered = spark.createDataFrame([("/a", 1, bytearray(b"a")), ("b", 1, bytearray(b"x")), ("dir\\d", 1, bytearray(b"d")), ("e", 1, bytearray(b"e")), ("zz", 1, bytearray(b"z"))], "path string, length long, content binary")
    algorithms = sorted(r.algorithm for r in acceptance.delivery_algorithms(elements).collect())
    hashed = acceptance.hash_files(delivered, algorithms)
    checked = acceptance.check(elements, hashed)
    assert {r.path: r.verdict for r in checked.collect()} == {"./a": "match", "./b": "mismatch", "c": "missing", "dir/d": "unverifiable", "e": "unverifiable"}
    assert acceptance.summary(checked, acceptance.extra(elements, hashed)).first().extra == 1 and acceptance.has_verifiable_files(elements)


@pytest.mark.parametrize(("purl", "want"), [("pkg:NPM/%40Scope/Name@1.0?x#y", ("npm/@scope/Name", "1.0")), ("pkg:npm/@angular/core", ("npm/@angular/core", None)), ("pkg:npm//a/", ("npm//a", None)), ("pkg:", None), ("npm/a", None), ("pkg:deb/a@1%2B2+3", ("deb//a", "1+2+3")), ("pkg:x/a@%zz", ("x//a", "%zz"))])
def test_purl_keys(spark, purl, want):
    k = spark.createDataFrame([(purl,)], "p string").select(identity.purl_match_key(F.col("p")).alias("k")).first().k
    assert (k and tuple(k)) == want


@pytest.mark.parametrize(("cpe", "want"), [("cpe:2.3:a:V\\:x:Prod:1.0:*", ("cpe|a:v:x:prod", "1.0")), ("cpe:/o:v:p", ("cpe|o:v:p", None)), ("cpe:2.3:a:v:*:1", None), ("cpe:2.3:z:v:p:1", None), ("cpe:2.3:a:v:p:-", ("cpe|a:v:p", None)), ("cpe:/a:v%20w:p:2", ("cpe|a:v w:p", "2")), ("other", None)])
def test_cpe_keys(spark, cpe, want):
    k = spark.createDataFrame([(cpe,)], "p string").select(identity.cpe_match_key(F.col("p")).alias("k")).first().k
    assert (k and tuple(k)) == want


def test_small_expressions(spark):
    row = spark.createDataFrame([("pkg:a/b@c/d", "pkg:a/b@1?q", "a#b#c", "DocumentRef-X:SPDXRef-a", "NONE", "1.10.0", "1.9.0-r2", "./.\\a")], "a string, b string, c string, d string, e string, v string, w string, p string")
    got = row.select(
        identity.purl_version(F.col("a")), identity.purl_version(F.col("b")), identity.purl_identity(F.col("b")), identity.split_element_id(F.col("c"))["spdx_id"], identity.element_ref(F.col("d"))["id"], identity.element_ref(F.col("e"))["kind"],
        identity.natural_key(F.col("v")) > identity.natural_key(F.col("w")), identity.normalized_path(F.col("p")),
    ).first()
    assert tuple(got) == (None, "1", "pkg:a/b", "b#c", "SPDXRef-a", "special", True, "./a")


def test_statements_from_files(spark, ws, tmp_path):
    from bomweave.sources.statements import read_statements, route

    vexed = lambda status, at, own="v1": json.dumps({"@context": "https://openvex.dev/ns/v0.2.0", "@id": own, "timestamp": at, "statements": [{"vulnerability": {"name": "CVE-7"}, "products": [{"@id": "pkg:generic/yard/ropelib"}], "status": status}]})
    csaf = {"document": {"csaf_version": "2.0", "tracking": {"id": "A", "current_release_date": "2025-01-01T00:00:00Z"}}, "product_tree": {"full_product_names": [{"product_id": "p", "product_identification_helper": {"purl": "pkg:generic/yard/ropelib@12.4"}}]}, "vulnerabilities": [{"cve": "CVE-7", "product_status": {"known_affected": ["p"]}}]}
    for name, value in (("1.json", vexed("affected", "2020-01-01T00:00:00Z")), ("2.json", vexed("fixed", "2024-01-01T00:00:00Z")), ("3.json", json.dumps(csaf)), ("4.txt", "other")):
        (tmp_path / name).write_text(value)
    found = vex.findings(ws, read_statements(spark, str(tmp_path)))
    assert {(r.doc_id, r.status, r.superseded) for r in found.collect()} == {(ID("keel-base"), "affected", 1), (ID("loom-suite"), "fixed", 0)}
    assert [route(x.encode()) for x in (vexed("fixed", "x"), json.dumps(csaf), "words", json.dumps({"schema": "a-profile/v1"}))] == ["openvex", "csaf", "document", "profile"]


def test_statements_meet_keys_once(spark):
    """Elements of one source share what holds for them: the join to elements brings a row an element, and findings are not grouped again."""
    refs = "array<struct<category:string,type:string,locator:string>>"
    cpe = lambda *locators: [("SECURITY", "cpe23Type", x) for x in locators]
    one, two = "cpe:2.3:a:v:p:1:*", "cpe:2.3:a:v:p:2:*"
    rows = [("d", f"e{i}", "pkg:generic/a@1", None) for i in range(20)] + [("d", "c", "pkg:generic/a@1", cpe(one, two)), ("d", "none", None, None), ("d", "odd", "not a purl", []), ("d", "only", None, cpe(two, two))]
    elements = spark.createDataFrame(rows, f"doc_id string, spdx_id string, purl string, external_refs {refs}").withColumn("kind", F.lit("package"))
    own = Workspace.empty(spark).with_tables(element=elements)
    stated = [(0, "V1", "fixed", "pkg:generic/a", "2024-01-01T00:00:00Z"), (1, "V1", "affected", "pkg:generic/a@1", "2023-01-01T00:00:00Z"), (2, "V2", "affected", one, None), (3, "V2", "fixed", two, None), (4, "V1", "odd", "pkg:generic/a", "2025-01-01T00:00:00Z"), (5, "V3", "fixed", None, None)]
    statements = spark.createDataFrame(stated, "cand_ord long, vulnerability string, status string, ref string, timestamp string")
    found = sorted(tuple(r) for r in vex.findings(own, statements).collect())
    assert found == sorted([*(("d", f"e{i}", "V1", "fixed", 0, 1) for i in range(20)), ("d", "c", "V1", "fixed", 0, 1), ("d", "c", "V2", "fixed", 3, 1), ("d", "only", "V2", "fixed", 3, 0)])
    laid = {r.spdx_id: (r.vex_status, r.vex_vulnerabilities) for r in vex.overlay(own, elements, statements).collect()}
    assert laid["none"] == laid["odd"] == ("", "") and laid["c"] == ("fixed", "V1 (fixed); V2 (fixed)") and len(laid) == 24
    assert vex.by_source(own, statements).count() == 3


def _stated_twice(spark):
    """40 elements of four sources, one of them with a package URL and two CPEs, and statements of equal and unreadable times."""
    refs = "array<struct<category:string,type:string,locator:string>>"
    cpes = [("SECURITY", "cpe23Type", f"cpe:2.3:a:v:p:{x}:*") for x in (1, 2)]
    rows = [("d", f"a{i}", f"pkg:generic/a@{i % 3}", None) for i in range(30)] + [("d", f"c{i}", "pkg:generic/a@1", cpes) for i in range(10)]
    own = Workspace.empty(spark).with_tables(element=spark.createDataFrame(rows, f"doc_id string, spdx_id string, purl string, external_refs {refs}"))
    at = [None, "no date", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", "2023-01-01T00:00:00Z"]
    said = ["pkg:generic/a", "pkg:generic/a@1", "pkg:generic/a@1?arch=x", "cpe:2.3:a:v:p:2:*", "cpe:2.3:a:v:p", "pkg:generic/b"]
    stated = [(i, f"V{i % 7}", vex.STATUSES[i * i % 4], said[i % 6], at[i % 5]) for i in range(200)]
    return own, spark.createDataFrame(stated, "cand_ord long, vulnerability string, status string, ref string, timestamp string"), stated


def test_superseded_by_source(spark):
    """Findings are counted by source: no element meets its findings, and none is made a row for it."""
    own, statements, _ = _stated_twice(spark)
    counted = vex.superseded(own, statements)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Scan ") == 2  # elements and statements, once each
    want = vex.findings(own, statements).groupBy("vulnerability").agg(F.count("*"), F.sum("superseded"))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect())) and want.count() == 7


def test_few_documents_go_to_every_task(spark, ws, monkeypatch):
    """Elements aren't dealt out by document to meet its name, unless documents are many; rows are the same."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda: search.inventory(search.few_documents(ws)).select("doc_id", "spdx_id", "doc_name")
        few = plan()
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(search, "FEW_DOCUMENTS", 1)
        many = plan()
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_statements_meet_sources_as_lists(spark):
    """What holds is found within lists: no row a source and vulnerability is dealt out; results are those of a plain walk."""
    own, statements, rows = _stated_twice(spark)
    found = vex.findings(own, statements)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert any("_purl" in x for x in dealt) and not any("_purl" in x and "vulnerability" in x for x in dealt)
    fits = lambda ref, source: ref in ("pkg:generic/a", f"pkg:generic/a@{source[0]}", f"pkg:generic/a@{source[0]}?arch=x") or source == "1c" and ref.startswith("cpe:2.3:a:v:p")
    want = []
    for name, source in [(f"a{i}", str(i % 3)) for i in range(30)] + [(f"c{i}", "1c") for i in range(10)]:
        for v in {r[1] for r in rows}:
            own_rows = sorted(((r[4] or "").startswith("20") and r[4] or "", r[0], r[2]) for r in rows if r[1] == v and fits(r[3], source))
            want += [("d", name, v, own_rows[-1][2], own_rows[-1][1], len(own_rows) - 1)] if own_rows else []
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_finding_order_from_lists(spark):
    """Places are those in the list of a source: by rank, then vulnerability, and no row a vulnerability is dealt out for them."""
    own, statements, _ = _stated_twice(spark)
    placed = vex.ordered_findings(vex.stated(own, statements))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert not any("_purl" in x and "vulnerability" in x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    by: dict[str, list] = {}
    for r in placed.collect():
        by.setdefault(r.spdx_id, []).append((vex.STATUSES.index(r.status), r.vulnerability, r.place))
    assert len(by) == 40 and all([x[2] for x in sorted(rows)] == list(range(1, len(rows) + 1)) for rows in by.values())


def test_lines_are_dealt_out_once(spark, small, monkeypatch):
    """A supplier's packages are found where lines meet their part, and few suppliers go to every task; rows are the same with many."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = star.elements(spark, small)
        dealt = [x for x in few._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
        assert sum("l_partkey" in x for x in dealt) == 1 and not any("suppkey" in x for x in dealt)
        monkeypatch.setattr(star, "FEW_DOCUMENTS", 1)
        many = star.elements(spark, small)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        cells = ["doc_id", "pos", "purl", "license_concluded", "external_refs"]
        assert sorted(map(str, few.select(*cells).collect())) == sorted(map(str, many.select(*cells).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lists_of_sources_stay_where_they_are(spark):
    """Elements go to where the lists of their sources were made: the lists aren't dealt out again; elements without a source go."""
    own, statements, _ = _stated_twice(spark)
    bare = own.element.limit(1).selectExpr("doc_id", "'bare' AS spdx_id", "CAST(NULL AS STRING) AS purl", "CAST(NULL AS array<struct<category:string,type:string,locator:string>>) AS external_refs")
    own = own.with_tables(element=own.element.unionByName(bare))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = vex.ordered_findings(vex.stated(own, statements))
        dealt = [x for x in placed._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(_purl" in x]
        assert len(dealt) == 3 and not any("_salt" in x for x in dealt)  # sources, their lists, elements
        assert {r.spdx_id for r in placed.collect()} == {f"a{i}" for i in range(30)} | {f"c{i}" for i in range(10)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
