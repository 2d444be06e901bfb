"""Parsers on small documents of our own, without Spark."""

from __future__ import annotations

import gzip
import hashlib
import json

import pytest

from bomweave.functions import signature
from bomweave.operators import profile
from bomweave.sources import advisories, archives, files, lint

JSON = {
    "spdxVersion": "SPDX-2.3", "dataLicense": "CC0-1.0", "SPDXID": "SPDXRef-DOCUMENT", "name": "tiny", "documentNamespace": "https://example.org/tiny", "creationInfo": {"created": "2024-01-02T03:04:05Z", "creators": ["Tool: make-1"]},
    "documentDescribes": ["SPDXRef-app"],
    "packages": [{"SPDXID": "SPDXRef-app", "name": "app", "versionInfo": "1.0", "downloadLocation": "NOASSERTION", "licenseConcluded": "MIT"}, {"SPDXID": "SPDXRef-lib", "name": "lib", "versionInfo": "2.0", "downloadLocation": "NOASSERTION", "checksums": [{"algorithm": "SHA1", "checksumValue": "AB" * 20}]}],
    "relationships": [{"spdxElementId": "SPDXRef-app", "relationshipType": "CONTAINS", "relatedSpdxElement": "SPDXRef-lib"}],
}
TAGS = """SPDXVersion: SPDX-2.3
DataLicense: CC0-1.0
SPDXID: SPDXRef-DOCUMENT
DocumentName: tiny
DocumentNamespace: https://example.org/tiny
Creator: Tool: make-1
Created: 2024-01-02T03:04:05Z
Relationship: SPDXRef-DOCUMENT DESCRIBES SPDXRef-app
PackageName: app
SPDXID: SPDXRef-app
PackageVersion: 1.0
PackageDownloadLocation: NOASSERTION
PackageLicenseConcluded: MIT
PackageName: lib
SPDXID: SPDXRef-lib
PackageVersion: 2.0
PackageDownloadLocation: NOASSERTION
PackageChecksum: SHA1: {sum}
Relationship: SPDXRef-app CONTAINS SPDXRef-lib
""".format(sum="AB" * 20)


def codes(parsed):
    return [d["code"] for d in parsed.diagnostics]


def parse(value, name="x.json"):
    return files.parse_text(value if isinstance(value, str) else json.dumps(value), name)


def brief(p):
    keep = ("spdx_id", "kind", "name", "version", "license_concluded", "checksums")
    return {k: p.document.get(k) for k in ("name", "namespace", "created", "creators", "describes", "spdx_id", "version")}, [{k: e.get(k) for k in keep} for e in p.elements], sorted((r["from_id"], r["type"], r["to_id"]) for r in p.relationships)


def test_three_forms_of_one_document():
    yaml = pytest.importorskip("yaml")
    a, b, c = parse(JSON), parse(TAGS), parse(yaml.safe_dump(JSON))
    assert brief(a) == brief(b) == brief(c)
    assert a.document["describes"] == ["SPDXRef-app"] and codes(a) == codes(b) == codes(c) == []
    assert ("SPDXRef-DOCUMENT", "DESCRIBES", "SPDXRef-app") in brief(a)[2]


def test_spdx_fallbacks_and_repeated_ids():
    p = parse({**JSON, "documentDescribes": [], "packages": [{"name": "n", "externalRefs": [{"referenceCategory": "PACKAGE-MANAGER", "referenceType": "purl", "referenceLocator": "pkg:deb/yard/n@7:0.12~b4?arch=x#sub"}]}] + JSON["packages"][1:] * 2, "relationships": [], "files": [{"fileName": "./a", "SPDXID": "SPDXRef-lib"}]})
    assert p.elements[0]["version"] == "7:0.12~b4" and p.elements[0]["spdx_id"].endswith("anonymous-1")
    assert len(p.elements) == 2 and next(d for d in p.diagnostics if d["code"] == "DUP_SPDXID")["message"].startswith("2 ")
    assert "JSON_MISSING_SPDXID" in codes(p) and p.document["describes"] == []


def test_tag_value_quirks():
    p = parse(
        "SPDXVersion: SPDX-2.3\nSPDXID: SPDXRef-DOCUMENT\nExternalDocumentRef: DocumentRef-A https://a SHA1:" + "ab" * 20 + "\nExternalDocumentRef: DocumentRef-B https://b SHA1: " + "cd" * 20 + "\nExternalDocumentRef: DocumentRef-C https://c\n"
        "ExternalDocumentRef: broken\nthis is no tag\nPackageName: a\nSPDXID: SPDXRef-a\nPackageDescription: <text>two\nRelationship: not one\nlines</text>\nPackageChecksum: MD5 zz\nSnippetSPDXID: SPDXRef-s\nPackageVersion: hidden\n"
        "Relationship: SPDXRef-a DEPENDS-ON DocumentRef-Z:SPDXRef-q\nRelationshipComment: why\nRelationship: SPDXRef-a CONTAINS NOASSERTION\nPackageName: b\nPackageComment: <text>never ends\n"
    )
    assert [r["checksum_value"] for r in p.ext_refs] == ["ab" * 20, "cd" * 20, None]
    assert p.elements[0]["description"] == "two\nRelationship: not one\nlines" and p.elements[0].get("version") is None and p.elements[1]["spdx_id"].endswith("anonymous-1")
    first = p.relationships[0]
    assert (first["type"], first["to_kind"], first["to_ref"], first["to_id"], first["comment"]) == ("DEPENDS_ON", "external", "DocumentRef-Z", "SPDXRef-q", "why")
    assert {"EXTREF_NO_CHECKSUM", "EXTREF_MALFORMED", "TV_MALFORMED_LINE", "TV_BAD_CHECKSUM", "TV_BLOCKS_SKIPPED", "TV_MISSING_SPDXID", "TV_UNTERMINATED_TEXT", "REL_UNKNOWN_DOCREF", "DOC_NO_NAMESPACE"} <= set(codes(p))


def test_spdx3():
    graph = [
        {"type": "CreationInfo", "@id": "_:c", "specVersion": "3.0.1", "created": "2024-01-01T00:00:00Z", "createdBy": ["urn:x#org"], "createdUsing": ["urn:x#tool"]},
        {"type": "Organization", "spdxId": "urn:x#org", "name": "Acme", "creationInfo": "_:c"}, {"type": "Tool", "spdxId": "urn:x#tool", "name": "t", "creationInfo": "_:c"},
        {"type": "SpdxDocument", "spdxId": "urn:x", "name": "doc", "creationInfo": "_:c", "rootElement": ["urn:x#a"], "import": [{"externalSpdxId": "urn:y#q", "verifiedUsing": [{"algorithm": "sha256", "hashValue": "00" * 32}, {"algorithm": "sha1", "hashValue": "AA" * 20}]}]},
        {"type": "software_Package", "spdxId": "urn:x#a", "name": "a", "software_packageVersion": "1", "suppliedBy": "urn:x#org", "creationInfo": "_:c", "software_primaryPurpose": "operatingSystem", "externalIdentifier": [{"externalIdentifierType": "packageUrl", "identifier": "pkg:npm/a@1"}]},
        {"type": "software_File", "spdxId": "urn:x#f", "name": "f", "creationInfo": "_:c"}, {"type": "security_Vulnerability", "spdxId": "urn:x#v", "creationInfo": "_:c"},
        {"type": "simplelicensing_LicenseExpression", "spdxId": "urn:x#l", "simplelicensing_licenseExpression": "MIT", "creationInfo": "_:c"},
        {"type": "Relationship", "spdxId": "urn:x#r1", "from": "urn:x#a", "to": ["urn:x#l"], "relationshipType": "hasDeclaredLicense", "creationInfo": "_:c"},
        {"type": "Relationship", "spdxId": "urn:x#r2", "from": "urn:x#a", "to": ["urn:x#f", "urn:y#q"], "relationshipType": "dependsOn", "creationInfo": "_:c"},
    ]
    p = parse({"@context": "https://spdx.org/rdf/3.0.1/spdx-context.jsonld", "@graph": graph})
    a = p.elements[0]
    assert (a["supplier"], a["purl"], a["license_declared"], a["purpose"]) == ("Organization: Acme", "pkg:npm/a@1", "MIT", "OPERATING_SYSTEM")
    assert p.document["creators"] == ["Organization: Acme", "Tool: t"] and p.document["version"] == "SPDX-3.0.1" and p.document["describes"] == ["urn:x#a"]
    assert p.ext_refs == [{"doc_ref": "DocumentRef-import1", "uri": "urn:y", "checksum_alg": "SHA1", "checksum_value": "aa" * 20}]
    assert [(r["type"], r["to_kind"]) for r in p.relationships] == [("DEPENDS_ON", "local"), ("DEPENDS_ON", "external"), ("DESCRIBES", "local")]
    assert codes(p) == ["SPDX3_ELEMENTS_SKIPPED"]
    assert codes(parse({"@context": "https://spdx.org/rdf/3.0.1/x", "@graph": []})) == ["SPDX3_NO_GRAPH"]


def test_cyclonedx():
    p = parse({
        "bomFormat": "CycloneDX", "specVersion": "1.6", "serialNumber": "urn:uuid:3E671687-395B-41F5-A30F-A58921A69B79", "version": 2,
        "metadata": {"timestamp": "t", "tools": [{"name": "gen", "version": "1"}], "authors": [{"name": "Ann"}], "component": {"type": "application", "name": "app", "bom-ref": "app"}},
        "components": [
            {"type": "library", "name": "a", "bom-ref": "x", "licenses": [{"license": {"id": "MIT"}}, {"license": {"id": "BSD-3-Clause"}}], "components": [{"type": "file", "name": "f"}]}, {"type": "library", "name": "b", "bom-ref": "x", "cpe": "cpe:2.3:a:v:b:1"}, {"type": "library"},
            {"type": "library", "name": "c", "externalReferences": [{"type": "bom", "url": "urn:cdx:AA/1#q%20r"}]},
        ],
        "dependencies": [{"ref": "app", "dependsOn": ["x", "nowhere", "urn:cdx:aa/1"]}],
    })
    assert p.document["namespace"] == "urn:cdx:3e671687-395b-41f5-a30f-a58921a69b79/2" and p.document["creators"] == ["Tool: gen-1", "Person: Ann"]
    assert [e["spdx_id"] for e in p.elements] == ["app", "x", "SPDXRef-f", "x-2", "SPDXRef-c"] and p.elements[1]["license_declared"] == "MIT AND BSD-3-Clause"
    edges = [(r["from_id"], r["type"], r["to_ref"] or "", r["to_id"]) for r in p.relationships]
    assert ("x", "CONTAINS", "", "SPDXRef-f") in edges and ("SPDXRef-c", "DEPENDS_ON", "DocumentRef-cdx1", "q r") in edges and ("app", "DEPENDS_ON", "DocumentRef-cdx1", None) in edges
    assert len(p.ext_refs) == 1 and p.document["describes"] == ["app"]
    assert {"CDX_COMPONENT_MALFORMED", "CDX_DEPENDENCIES_UNMAPPED", "CDX_SCHEMA_DUPLICATE_BOM_REF"} == set(codes(p))
    deep = {"type": "library", "name": "n"}
    for _ in range(70):
        deep = {"type": "library", "name": "n", "components": [deep]}
    assert "CDX_NESTING_CAPPED" in codes(parse({"bomFormat": "CycloneDX", "specVersion": "1.6", "components": [deep]}))


DESCRIPTOR = {
    "meta": {"schemaVersion": "v2"},
    "component": {
        "name": "example.org/app", "version": "1.0.0", "provider": "acme", "repositoryContexts": [], "sources": [], "componentReferences": [{"name": "lib", "componentName": "example.org/lib", "version": "2.0.0"}],
        "resources": [
            {"name": "image", "version": "1.0.0", "type": "ociImage", "relation": "external", "access": {"type": "ociArtifact", "imageReference": "r.example.org:5000/x/app:1.2@sha256:abc"}},
            {"name": "bom", "version": "1.0.0", "type": "spdx", "relation": "local", "access": {"type": "localBlob", "localReference": "sha256.1"}},
        ],
    },
}


def test_descriptor():
    p = parse(DESCRIPTOR)
    assert [e["spdx_id"] for e in p.elements] == ["SPDXRef-component", "SPDXRef-resource-image", "SPDXRef-resource-bom"]
    assert p.elements[1]["purl"] == "pkg:oci/app@sha256:abc?repository_url=r.example.org:5000/x/app" and p.elements[2]["supplier"] == "Organization: acme"
    assert p.ext_refs[0]["uri"] == "ocm://example.org/lib/2.0.0" and p.document["namespace"] == "ocm://example.org/app/1.0.0" and codes(p) == []
    newer = {"apiVersion": "ocm.software/v3alpha1", "kind": "ComponentVersion", "metadata": {"name": "example.org/app", "version": "1.0.0", "provider": {"name": "acme"}}, "spec": {"resources": DESCRIPTOR["component"]["resources"], "references": DESCRIPTOR["component"]["componentReferences"]}}
    q = parse(newer)
    assert [e["spdx_id"] for e in q.elements] == [e["spdx_id"] for e in p.elements] and codes(q) == ["OCM_V3ALPHA1"]
    assert codes(parse({"meta": {"schemaVersion": "v2"}, "component": {"version": "1"}})) == ["OCM_CD_MALFORMED"]


@pytest.mark.parametrize(("source", "code"), [("plain words", "UNRECOGNIZED_FORMAT"), ("{broken", "JSON_INVALID"), ("[]", "JSON_NOT_OBJECT"), ({"SchemaVersion": 2, "ArtifactName": "x"}, "TRIVY_NATIVE_NOT_SUPPORTED"), ({"a": 1}, "JSON_NOT_SPDX"), ({"spdxVersion": "SPDX-1.2"}, "SPDX_UNSUPPORTED_VERSION"), ({"schema": "bomweave-profile/v1"}, "BOMWEAVE_PROFILE")])
def test_refused(source, code):
    p = parse(source)
    assert p.failed and codes(p) == [code]


def test_broken_escape_fails_the_file():
    bad = {**JSON, "packages": [{"SPDXID": "SPDXRef-a", "name": "a", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:x/a@%ff"}]}]}
    rows = [*files.parse_file("a.json", json.dumps(bad).encode())]
    assert [r["failed"] for r in rows] == [True] and rows[0]["diagnostics"][0]["code"] == "PARSE_CRASH"


def found_by(rule, *given):
    from bomweave.sources.record import Parsed

    out = Parsed()
    rule(*given, out)
    return {d["code"].partition("_SCHEMA_")[2]: d["message"] for d in out.diagnostics}


def test_lint_spdx2():
    package = {
        "SPDXID": "bad id", "name": "a", "primaryPackagePurpose": "TOY", "checksums": [{"algorithm": "SHA1", "checksumValue": "xyz"}], "licenseConcluded": "MIT and BSD",
        "packageVerificationCode": {"packageVerificationCodeValue": "1"}, "externalRefs": [{"referenceType": "PURL", "referenceLocator": "a"}],
    }
    likes = {"spdxElementId": "a", "relationshipType": "LIKES", "relatedSpdxElement": "b"}
    broken = {"spdxVersion": "SPDX-9", "dataLicense": "MIT", "documentNamespace": "no uri#x", "creationInfo": {"created": "yesterday", "creators": ["Acme"]}, "packages": [package] * 5, "relationships": [likes, likes]}
    found = found_by(lint.spdx2, broken)
    assert found == {
        "BAD_VERSION": "1: SPDX-9", "BAD_DATA_LICENSE": "1: MIT", "BAD_NAMESPACE": "1: no uri#x", "BAD_CREATED": "1: yesterday", "BAD_CREATOR": "1: Acme", "BAD_SPDXID": "5: bad id, bad id, bad id, ...",
        "MISSING_DOWNLOAD_LOCATION": "5: a, a, a, ...", "BAD_PACKAGE_PURPOSE": "5: a (TOY), a (TOY), a (TOY), ...", "BAD_CHECKSUM": "5: a: not hexadecimal, a: not hexadecimal, a: not hexadecimal, ...",
        "BAD_LICENSE_EXPRESSION": "5: " + ", ".join(["a: operator and in lower case"] * 3) + ", ...", "BAD_VERIFICATION_CODE": "5: a, a, a, ...", "BAD_PURL_REF": "5: a (a), a (a), a (a), ...", "UNKNOWN_RELATIONSHIP": "1: LIKES",
    }
    good = {"name": "a", "downloadLocation": "NONE", "checksums": [{"algorithm": "SHA1"}, {"checksumValue": "x"}, {"algorithm": " sha-1 ", "checksumValue": "AB" * 20}], "packageVerificationCode": {"packageVerificationCodeValue": "AB" * 20}}
    assert found_by(lint.spdx2, {}) == found_by(lint.spdx2, {"packages": [good], "files": [{"licenseDeclared": "(("}], "relationships": [{"relationshipType": "depends-on"}]}) == {}
    assert [*found_by(lint.spdx2, {"SPDXID": "x", "packages": [{"downloadLocation": " ", "primaryPackagePurpose": "OPERATING-SYSTEM"}]})] == ["BAD_SPDXID", "MISSING_DOWNLOAD_LOCATION", "BAD_PACKAGE_PURPOSE"]
    tags = parse("SPDXVersion: SPDX-2.3\nDocumentNamespace: urn:x\nPackageName: p\nPackageDownloadLocation: NONE\nFileName: f\nSPDXID: f\n")
    assert [d["message"] for d in tags.diagnostics if "_SCHEMA_" in d["code"]] == ["1: f"]


def test_lint_spdx3():
    made = {"type": "CreationInfo", "@id": "_:c", "specVersion": "3.0.1"}
    tie = {"type": "Relationship", "spdxId": "urn:r", "creationInfo": "_:c", "from": "urn:gone", "to": [{"spdxId": "urn:lost"}, "urn:lost", "_:b"]}
    broken = [{"@id": "x"}, {"type": "CreationInfo"}, {"type": "software_Package", "spdxId": "urn:p", "verifiedUsing": [{"algorithm": "sha1", "hashValue": "q"}]}, tie]
    assert found_by(lint.spdx3, broken) == {
        "MISSING_TYPE": "1: x", "BAD_SPDXID": "1: x", "MISSING_CREATION_INFO": "1: urn:p", "BAD_HASH": "1: urn:p: not hexadecimal", "INCOMPLETE_RELATIONSHIP": "1: urn:r", "DANGLING_REF": "2: urn:gone, urn:lost", "BAD_SPEC_VERSION": "1: None",
    }
    document = {"type": "SpdxDocument", "spdxId": "urn:d", "creationInfo": "_:c", "import": [{"externalSpdxId": "urn:far"}]}
    clean = [made, document, {"type": "Odd", "verifiedUsing": [{"algorithm": "q"}]}, {"@type": "Hash"}, tie | {"relationshipType": "contains", "from": "urn:d", "to": "urn:far"}, {"type": "x_OddRelationship", "from": "urn:gone"}]
    assert found_by(lint.spdx3, clean) == {}
    assert [*found_by(lint.spdx3, [tie | {"relationshipType": "contains", "from": "urn:r", "to": None}])] == []


def test_lint_cyclonedx():
    toy = {"bom-ref": "a", "name": "t", "type": "toy", "purl": "x", "hashes": [{"alg": "MD5", "content": "1"}], "licenses": [{"expression": "("}, {"license": {"id": "MIT", "name": "m"}}]}
    assert found_by(lint.cyclonedx, {"specVersion": "9", "serialNumber": "x", "version": 1.5}, [toy, {"bom-ref": "a"}, {"bom-ref": "a"}]) == {
        "UNKNOWN_SPEC_VERSION": "1: 9", "BAD_SERIAL_NUMBER": "1: x", "BAD_VERSION": "1: 1.5", "BAD_COMPONENT_TYPE": "1: t (toy)", "BAD_HASH": "1: t: wrong length", "BAD_PURL": "1: t (x)",
        "BAD_LICENSE_EXPRESSION": "2: t: a license is missing at the end, t: a license of both id and name", "DUPLICATE_BOM_REF": "1: a",
    }
    assert found_by(lint.cyclonedx, {}, [{}, {}, {"hashes": [{"alg": "odd"}, {"content": "odd"}], "licenses": [{"license": {"id": "MIT"}}, {"expression": "MIT"}]}]) == found_by(lint.cyclonedx, {"version": 2.0}, []) == {}


def test_lint_descriptor():
    r = {"name": "r", "version": "one", "relation": "odd", "access": {}, "digest": {"value": "1"}, "labels": [1, {"value": 1}]}
    assert found_by(lint.descriptor, {"name": "Bad", "version": "x", "creationTime": "now", "resources": [r, r, r], "sources": [{"name": "s", "relation": "odd"}], "labels": [{}]}) == {
        "MISSING_FIELD": "1: provider", "BAD_NAME": "1: Bad", "BAD_VERSION": "4: x, r, r, ...", "BAD_TIMESTAMP": "1: now", "BAD_RELATION": "4: r, r, r, ...", "ACCESS_MISSING_TYPE": "3: r, r, r", "DIGEST_INCOMPLETE": "3: r, r, r",
        "DUPLICATE_IDENTITY": "1: resources: r", "LABEL_MALFORMED": "7: " + ", ".join(["a label without a name"] * 3) + ", ...",
    }
    both = [{"name": "r", "version": "1.0", "labels": [{"name": "l"}]}, {"name": "r", "version": "2.0"}, {"name": "r", "version": "2.0", "extraIdentity": {"os": "x"}}, {}, {}]
    for made in ("2024-01-02", "2024-01-02T03:04:05+02:00", "2024", "Tue, 02 Jan 2024 03:04:05 GMT"):
        assert found_by(lint.descriptor, {"name": "example.org/a", "version": "v1.2-rc.1", "provider": {"name": "p"}, "creationTime": made, "resources": both, "componentReferences": [{"name": "c", "version": "any", "relation": "odd"}]}) == {}
    assert found_by(lint.descriptor, {"name": "example.org/a", "version": "01.2", "provider": {"labels": [{"name": "l"}]}}) == {}


@pytest.mark.parametrize(("expression", "good"), [("MIT", True), ("(MIT OR Apache-2.0) AND GPL-2.0+ WITH Classpath-exception-2.0", True), ("NONE", True), ("MIT AND NONE", False), ("MIT and BSD", False), ("MIT BSD", False), ("(MIT", False), ("MIT)", False), ("MIT AND", False), ("DocumentRef-x:LicenseRef-y", True), ("DocumentRef-x", False), ("", False), ("WITH x", False), ("(MIT OR ISC) WITH x", True), ("GPL-2.0++", True), ("MIT WITH (x)", False), ("()", False), (" NONE ", True), ("LicenseRef-a+", False), ("a:b", False), ("MIT (ISC)", False), ("MIT WITH x WITH y", True)])
def test_license_expressions(expression, good):
    assert (lint.license_error(expression) is None) == good


def test_openvex():
    d = {"@context": "https://openvex.dev/ns/v0.2.0", "@id": "v1", "timestamp": "2024-01-01T00:00:00Z", "statements": [
        {"vulnerability": {"name": "CVE-1"}, "products": [{"@id": "pkg:npm/a@1", "subcomponents": [{"identifiers": {"purl": "pkg:npm/b"}}]}, "pkg:npm/c"], "status": "fixed"},
        {"vulnerability": "CVE-2", "products": ["name only"], "status": "affected"}, {"vulnerability": "CVE-3", "status": "odd"}, {"status": "fixed"},
    ]}
    source = json.dumps(d)
    assert advisories.is_openvex(source) and not advisories.is_csaf(source)
    v = advisories.parse_openvex(source, "f")
    assert [s["refs"] for s in v["statements"]] == [[("pkg:npm/a@1", 0, -1), ("pkg:npm/b", 0, 0), ("pkg:npm/c", 1, -1)], [("name only", 0, -1)]]
    assert [n["code"] for n in v["notes"]] == ["VEX_STATEMENT_UNMATCHABLE", "VEX_UNKNOWN_STATUS", "VEX_STATEMENT_SKIPPED"]
    rows = [*advisories.candidate_rows([v])]
    assert [r["cand_ord"] for r in rows] == [0, 1, 2, 3] and [r["via_subcomponent"] for r in rows] == [False, True, False, False]


def test_csaf():
    d = {
        "document": {"csaf_version": "2.0", "publisher": {"name": "P"}, "tracking": {"id": "A-1", "version": "3", "current_release_date": "2024-02-01T00:00:00Z", "initial_release_date": "2023-01-01T00:00:00Z"}},
        "product_tree": {
            "full_product_names": [{"product_id": "p1", "name": "x", "product_identification_helper": {"purl": "pkg:npm/x@1", "cpe": "cpe:/a:v:x"}}],
            "branches": [{"branches": [{"product": {"product_id": "p2", "product_identification_helper": {"cpe": "cpe:2.3:a:v:y:2"}}}]}],
            "relationships": [{"product_reference": "p2", "full_product_name": {"product_id": "p3"}}],
        },
        "vulnerabilities": [
            {"cve": "CVE-9", "ids": [{"text": "GH-1"}], "notes": [{"category": "summary", "text": "s"}], "product_status": {"known_affected": ["p1", "p3"], "known_not_affected": ["p2"], "under_investigation": ["zz"]}, "flags": [{"label": "component_not_present", "product_ids": ["p2"]}], "remediations": [{"details": "update"}]},
            {"product_status": {"fixed": ["p1"]}},
        ],
    }
    source = json.dumps(d)
    assert advisories.is_csaf(source) and not advisories.is_csaf(json.dumps({"note": "csaf_version"}))
    v = advisories.parse_csaf(source, "f")
    assert (v["id"], v["version"], v["timestamp"], v["author"]) == ("A-1", 3, "2024-02-01T00:00:00Z", "P")
    assert [(s["status"], [r for r, *_ in s["refs"]], s["justification"]) for s in v["statements"]] == [("affected", ["pkg:npm/x@1", "cpe:2.3:a:v:y:2"], None), ("not_affected", ["cpe:2.3:a:v:y:2"], "component_not_present"), ("under_investigation", [], None)]
    assert [n["code"] for n in v["notes"]] == ["VEX_STATEMENT_UNMATCHABLE", "CSAF_VULN_SKIPPED"]


def test_archives():
    tar = archives.write_tar({"a.spdx.json": json.dumps(JSON).encode(), "p" * 150 + "/b.bin": b"\0\1", "c.txt": b"words"})
    assert [archives.sniff(x) for x in (tar, gzip.compress(tar), b"PK\x03\x04", b"a\0", b"text")] == ["tar", "gzip", "zip", "binary", "text"]
    notes = []
    assert {k: v for k, v in archives.tar_entries(tar, notes)}["p" * 150 + "/b.bin"] == b"\0\1" and notes == []
    rows = [*files.parse_file("d.tgz", gzip.compress(tar))]
    assert [(r["document"]["name"], r["failed"]) for r in rows] == [("tiny", False), (None, True)]
    with pytest.raises(archives.Unreadable, match="over 10"):
        archives.gunzip(gzip.compress(bytes(100)), 10)
    with pytest.raises(archives.Unreadable):
        archives.gunzip(gzip.compress(b"x" * 1000)[:-9])
    bad = bytearray(tar)
    bad[0] ^= 1
    assert [*files.parse_file("d.tar", bytes(bad))][0]["diagnostics"][0]["code"] == "TAR_CORRUPT"


def test_deliveries():
    yaml = pytest.importorskip("yaml")
    bom = json.dumps(JSON).encode()
    component = archives.write_tar({"component-descriptor.yaml": yaml.safe_dump(DESCRIPTOR).encode(), "blobs/sha256.1": bom})
    rows = [*files.parse_file("c.tar", component)]
    assert [r["document"]["model"] for r in rows] == ["ocm", "spdx-2"]
    assert rows[0]["ext_refs"][0]["checksum_value"] == hashlib.sha1(bom).hexdigest() == rows[1]["document"]["sha1"]
    assert ("SPDXRef-resource-bom", "DESCRIBED_BY") in [(r["from_id"], r["type"]) for r in rows[0]["relationships"]]
    digest = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    layer = yaml.safe_dump(DESCRIPTOR).encode()
    manifest = json.dumps({"layers": [{"digest": digest(layer)}]}).encode()
    ctf = archives.write_tar({"artifact-index.json": json.dumps({"artifacts": [{"repository": "r", "tag": "1", "digest": digest(manifest)}, {"repository": "gone", "tag": "1", "digest": "sha256:0"}]}).encode(), f"blobs/{digest(manifest).replace(':', '.')}": manifest, f"blobs/{digest(layer).replace(':', '.')}": layer})
    rows = [*files.parse_file("t.tar", ctf)]
    assert rows[0]["document"]["name"] == "example.org/app" and rows[-1]["diagnostics"][0]["code"] == "CTF_ARTIFACT_UNREADABLE"


def _prime(bits, seed):
    import random

    rng = random.Random(seed)
    while True:
        p = rng.getrandbits(bits) | 1 | 3 << bits - 2
        if all(p % q for q in (3, 5, 7, 11, 13, 17)) and p % 65537 != 1 and all(pow(a, p - 1, p) == 1 for a in (2, 3, 5)):
            return p


def _der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def test_signatures():
    import base64

    p, q = _prime(512, 1), _prime(512, 2)
    n, d = p * q, pow(65537, -1, (p - 1) * (q - 1))
    number = lambda x: _der(2, x.to_bytes(x.bit_length() // 8 + 1, "big"))
    rsa = _der(0x30, number(n) + number(65537))
    spki = _der(0x30, _der(0x30, _der(6, signature.RSA_OIDS[0]) + _der(5, b"")) + _der(3, b"\0" + rsa))
    pem = lambda kind, b: f"-----BEGIN {kind}-----\n{base64.b64encode(b).decode()}\n-----END {kind}-----\n"
    assert signature.rsa_key(pem("PUBLIC KEY", spki)) == signature.rsa_key(pem("RSA PUBLIC KEY", rsa)) == (n, 65537)
    component = DESCRIPTOR["component"]
    digest = hashlib.sha256(signature.normalized(component, "jsonNormalisation/v3")).digest()
    size = (n.bit_length() + 7) // 8
    tail = signature.DIGEST_INFO["sha256"] + digest
    plain = pow(int.from_bytes(b"\0\1" + b"\xff" * (size - len(tail) - 3) + b"\0" + tail, "big"), d, n).to_bytes(size, "big")

    def pss(salt):
        h = hashlib.sha256(bytes(8) + digest + salt).digest()
        block = bytes(size - len(salt) - 34) + b"\1" + salt
        masked = bytearray(a ^ b for a, b in zip(block, signature._mask(h, len(block), "sha256"), strict=True))
        masked[0] &= 0xFF >> (8 * size - n.bit_length() + 1)
        return pow(int.from_bytes(bytes(masked) + h + b"\xbc", "big"), d, n).to_bytes(size, "big")

    recorded = lambda algorithm, value, **more: {"digest": {"hashAlgorithm": "SHA-256", "normalisationAlgorithm": "jsonNormalisation/v3", "value": digest.hex(), **more}, "signature": {"algorithm": algorithm, "value": value.hex()}}
    for s in (recorded("RSASSA-PKCS1-V1_5", plain), recorded("RSASSA-PSS", pss(b"s" * 32)), recorded("RSASSA-PSS", pss(b"s" * (size - 34)))):
        assert signature.verify(component, s, pem("PUBLIC KEY", spki))["state"] == "valid"
        assert signature.verify({**component, "version": "2"}, s, pem("PUBLIC KEY", spki)) == {"state": "invalid", "digest_match": False, "reason": "the descriptor is not the one that was signed"}
    assert signature.verify(component, recorded("RSASSA-PSS", plain), pem("PUBLIC KEY", spki))["state"] == "invalid"
    assert signature.verify(component, recorded("odd", plain), pem("PUBLIC KEY", spki))["state"] == "unverifiable"
    good = pem("PUBLIC KEY", spki)
    other = pem("RSA PUBLIC KEY", _der(0x30, number(n + 2) + number(65537)))
    keys = signature.pin(signature.pin({}, " b ", other), "a", good)
    assert [*keys] == ["b", "a"] and [*signature.pin(keys, "b", good)] == ["a", "b"] and [*signature.unpin(keys, "b")] == ["a"]
    assert signature.verify_pinned(component, recorded("RSASSA-PKCS1-V1_5", plain), keys)["label"] == "a"
    assert signature.verify_pinned(component, recorded("RSASSA-PKCS1-V1_5", plain), {"b": other})["state"] == "invalid" and signature.verify_pinned(component, {}, {})["state"] == "unverifiable"
    for label, text in ((" ", good), ("x", "no key")):
        with pytest.raises(signature.BadInput):
            signature.pin(keys, label, text)
    with pytest.raises(signature.BadInput):
        signature.pin({str(i): good for i in range(16)}, "x", good)
    moved = {**component, "repositoryContexts": [{"x": 1}], "resources": [{**r, "access": {"type": "x"}, "labels": [{"name": "l", "value": 1}]} for r in component["resources"]]}
    assert signature.normalized(moved, "jsonNormalisation/v3") == signature.normalized(component, "jsonNormalisation/v3")
    with pytest.raises(signature.BadInput):
        signature.normalized({**component, "labels": [{"name": "l", "value": 1.5, "signing": True}]}, "jsonNormalisation/v3")


def test_normalized_descriptor_bytes():
    """Expected bytes are written by hand from the rule: everything but the excluded parts, keys sorted."""
    component = {
        "version": "1.0", "name": "example.org/x", "provider": "acme", "creationTime": "2024-01-02T03:04:05Z", "repositoryContexts": [{"a": 1}], "odd": {"b": 2.0, "a": []}, "empty": {}, "none": None,
        "labels": [{"name": "l", "value": {"z": 1, "a": "é"}, "signing": "true", "extra": 1}, {"name": "m", "value": 1}, {"name": "n", "value": 1, "signing": False}],
        "resources": [{"name": "r", "access": {"type": "x"}, "srcRefs": [], "labels": [], "digest": {"value": "1"}, "type": "t"}, 7],
        "componentReferences": [{"name": "c", "access": 1, "labels": [{"name": "l", "signing": True}]}],
    }
    expected = (
        '{"component":{"componentReferences":[{"access":1,"labels":[{"name":"l","signing":true}],"name":"c"}],"creationTime":"2024-01-02T03:04:05Z","empty":{},'
        '"labels":[{"name":"l","signing":"true","value":{"a":"é","z":1}}],"name":"example.org/x","none":null,"odd":{"a":[],"b":2},"provider":{"name":"acme"},'
        '"resources":[{"digest":{"value":"1"},"name":"r","type":"t"},7],"sources":[],"version":"1.0"}}'
    )
    for algorithm in ("jsonNormalisation/v2", "jsonNormalisation/v3", "jsonNormalisation/v4alpha1"):
        assert signature.normalized(component, algorithm).decode() == expected
    assert signature.normalized({"provider": {"x": 1}}, "jsonNormalisation/v3") == b'{"component":{"componentReferences":[],"provider":{"x":1},"resources":[],"sources":[]}}'
    for bad in ({"a": 0.5}, {"a": float("inf")}, {"a": [{"b": 1.25}]}):
        with pytest.raises(signature.BadInput):
            signature.normalized(bad, "jsonNormalisation/v3")
    with pytest.raises(signature.BadInput):
        signature.normalized({}, "jsonNormalisation/v1")


def test_profile_validation():
    good = {"schema": "bomweave-profile/v3", "name": "p", "requires": {"spec": "spdx-3"}, "checks": [{"type": "document-field", "field": "name", "pattern": "^a"}, {"type": "package-coverage", "field": "checksum", "algorithms": ["SHA-256"], "threshold": 50}, {"type": "created-recency", "maxAgeDays": 3}]}
    p, wrong = profile.validate(good)
    assert not wrong and p.baselines == ("spdx-3",) and len(p.checks) == 3 and profile.sniff(json.dumps(good)) and not profile.sniff("{}")
    bad = {"schema": "bomweave-profile/v1", "name": "", "requires": {"spec": "x"}, "checks": [{"type": "odd"}, {"type": "document-field", "field": "x", "pattern": "("}, {"type": "package-coverage", "field": "checksum", "algorithms": ["a"], "threshold": 101, "values": ["x"]}, {"type": "created-recency"}, {"type": "relationships", "minCount": 0}]}
    assert profile.validate(bad)[0] is None and len(profile.validate(bad)[1]) >= 9


def test_blobs_and_catalogue():
    from bomweave.sources import blobs, catalogue

    chart = gzip.compress(archives.write_tar({"app/Chart.yaml": b"name: app", "app/values.yaml": b"a: 1"}))
    kinds = [blobs.inspect(x).kind for x in (b"{}", b"a: 1\nb: 2\n", b"plain words", b"\0\1", archives.write_tar({"x": b"1"}), chart, archives.write_tar({"oci-layout": b"{}"}))]
    assert kinds == ["json", "yaml", "text", "binary", "tar", "helm-chart", "oci-artifact"]
    assert blobs.digests(gzip.compress(b"a"))["unpacked"] == hashlib.sha256(b"a").hexdigest()
    c = catalogue.read({"sources": [{"name": "s", "urls": ["a.json", "https://x/y", "ftp://x", "//x"]}, {"name": "none", "urls": ["file:///x"]}, {"urls": ["a"]}], "profiles": ["p.json", "data:x"]})
    assert c == catalogue.Catalogue((catalogue.Source("s", ("a.json", "https://x/y")),), ("p.json",))


def test_yaml_by_libyaml(monkeypatch):
    """The loader in Python is for what libyaml refuses, and both read the same."""
    yaml = pytest.importorskip("yaml")
    if not yaml.__with_libyaml__:
        pytest.skip("without libyaml")
    plain = yaml.safe_dump(JSON)
    odd = plain + '\ncomment: "\\ud83d\\ude00"\n'  # halves of a surrogate pair, which libyaml refuses
    want = [brief(parse(x)) for x in (plain, odd)]
    slow = yaml.BaseLoader
    monkeypatch.setattr(files, "_load_yaml", lambda source, _: yaml.load(source, Loader=slow))
    assert [brief(parse(x)) for x in (plain, odd)] == want and want[0] == want[1] and want[0][1]
    monkeypatch.undo()
    monkeypatch.setattr(yaml, "BaseLoader", None)  # the loader in Python takes no part
    assert brief(parse(plain)) == want[0]
