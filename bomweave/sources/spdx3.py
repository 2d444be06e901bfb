"""SPDX 3 JSON-LD: a graph of nodes that name each other."""

from __future__ import annotations

import re

from bomweave.sources import lint
from bomweave.sources.record import Parsed, record, records, text, texts

_KEPT = {"software_Package", "software_File", "ai_AIPackage", "dataset_DatasetPackage"}
_AGENTS = {"Organization", "Person", "SoftwareAgent", "Tool", "Agent"}
_PLUMBING = {"SpdxDocument", "software_Sbom", "CreationInfo", "Relationship", "LifecycleScopedRelationship"} | _AGENTS


def _sentinel(value: str | None) -> str | None:
    """NoAssertion and None individuals as the words that the other formats use."""
    if value and re.search(r"(^|[/#:])(NoAssertion|NoAssertionElement|NoAssertionLicense|expandedlicensing_NoAssertionLicense)$", value):
        return "NOASSERTION"
    if value and re.search(r"(^|[/#:])(None|NoneElement|NoneLicense|expandedlicensing_NoneLicense)$", value):
        return "NONE"
    return value


def _id(node: dict) -> str | None:
    return text(node.get("spdxId")) or text(node.get("@id"))


def _hashes(value: object) -> list[dict] | None:
    found = [{"algorithm": a.upper().replace("-", ""), "value": v.lower()} for h in records(value) if (a := text(h.get("algorithm"))) and (v := text(h.get("hashValue")))]
    return found or None


def snake(value: str) -> str:
    return re.sub("([a-z0-9])([A-Z])", r"\1_\2", value).upper()


def _imports(document: dict, out: Parsed) -> dict[str, str]:
    """Reference of each imported id; entries of one document (the id before #, else its location) are one reference."""
    refs: dict[str, dict] = {}
    for entry in records(document.get("import")):
        own = text(entry.get("externalSpdxId"))
        if not own:
            continue
        head, sign, _ = own.partition("#")
        where = text(entry.get("locationHint"))
        key = head if sign else where or own
        sums = _hashes(entry.get("verifiedUsing")) or []
        best = next((s for s in sums if s["algorithm"] == "SHA1"), sums[0] if sums else None)
        ref = refs.setdefault(key, {"uri": head if sign else where or own, "sum": None, "ids": []})
        ref["sum"] = ref["sum"] or best
        ref["ids"].append(own)
    known = {}
    for i, ref in enumerate(refs.values(), 1):
        name = f"DocumentRef-import{i}"
        out.refer(name, ref["uri"], *((ref["sum"]["algorithm"], ref["sum"]["value"]) if ref["sum"] else (None, None)))
        known |= dict.fromkeys(ref["ids"], name)
    return known


def parse_object(root: dict, file_name: str) -> Parsed:
    out, nodes = Parsed(), records(root.get("@graph"))
    if not nodes:
        return out.fail("SPDX3_NO_GRAPH", "the document has no graph")
    by_id = {i: n for n in nodes if (i := _id(n))}
    kind = lambda n: text(n.get("type")) or text(n.get("@type")) or ""
    document = next((n for n in nodes if kind(n) == "SpdxDocument"), None)
    sbom = next((n for n in nodes if kind(n) == "software_Sbom"), None)
    head = document or sbom or {}
    if document is None:
        out.note("info", "SPDX3_NO_DOCUMENT_ELEMENT", "the graph has no document element")
    made = head.get("creationInfo")
    made = record(by_id.get(made) if isinstance(made, str) else made) or next((n for n in nodes if kind(n) == "CreationInfo"), {})

    def agent(ref: object) -> str | None:
        own = text(ref)
        node = by_id.get(own or "")
        if node is None:
            return _sentinel(own)
        prefix = {"Organization": "Organization", "Person": "Person"}.get(kind(node), "Tool" if kind(node) in ("Tool", "SoftwareAgent") else "Organization")
        return f"{prefix}: {text(node.get('name')) or own}"

    creators = [c for key in ("createdBy", "createdUsing") for x in texts(made.get(key)) if (c := agent(x))]
    context = root.get("@context")
    found = re.search(r"spdx\.org/rdf/(\d+\.\d+(?:\.\d+)?)", " ".join(texts(context if isinstance(context, list) else [context])))
    spec = text(made.get("specVersion")) or (found[1] if found else "3.x")
    own_id = _id(head) or "SPDXRef-DOCUMENT"
    out.document = {
        "model": "spdx-3", "version": f"SPDX-{spec}", "serialization": "json-ld", "spdx_id": own_id, "namespace": _id(head), "name": text(head.get("name")) or file_name, "created": text(made.get("created")),
        "creators": creators, "comment": text(head.get("comment")), "data_license": _sentinel(text(head.get("dataLicense"))),
    }
    imported = _imports(head, out)
    skipped: dict[str, int] = {}
    elements: dict[str, dict] = {}
    nameless = 0
    for n in nodes:
        t = kind(n)
        if t not in _KEPT:
            if t not in _PLUMBING and not t.endswith("Relationship") and not t.startswith("simplelicensing_") and not t.startswith("expandedlicensing_"):
                skipped[t or "untyped"] = skipped.get(t or "untyped", 0) + 1
            continue
        own = _id(n)
        if not own:
            nameless += 1
            own = f"SPDXRef-bomweave-anonymous-{nameless}"
        refs = [{"category": "PACKAGE-MANAGER" if x.get("externalIdentifierType") == "packageUrl" else "SECURITY" if str(x.get("externalIdentifierType", "")).startswith("cpe") else "OTHER", "type": "purl" if x.get("externalIdentifierType") == "packageUrl" else k, "locator": v} for x in records(n.get("externalIdentifier")) if (k := text(x.get("externalIdentifierType"))) and (v := text(x.get("identifier")))]
        purl = text(n.get("software_packageUrl")) or next((r["locator"] for r in refs if r["type"] == "purl"), None)
        purpose = text(n.get("software_primaryPurpose"))
        e = {
            "spdx_id": own, "kind": "file" if t == "software_File" else "package", "name": text(n.get("name")) or own, "version": text(n.get("software_packageVersion")), "purl": purl, "supplier": agent(n.get("suppliedBy")),
            "originator": next((a for x in texts(n.get("originatedBy")) if (a := agent(x))), None), "download_location": _sentinel(text(n.get("software_downloadLocation"))), "copyright": _sentinel(text(n.get("software_copyrightText"))),
            "purpose": snake(purpose) if purpose else None, "description": text(n.get("description")) or text(n.get("summary")), "comment": text(n.get("comment")), "checksums": _hashes(n.get("verifiedUsing")), "external_refs": refs or None,
        }
        out.elements.append(e)
        elements.setdefault(own, e)
    if skipped:
        out.note("info", "SPDX3_ELEMENTS_SKIPPED", "not read: " + ", ".join(f"{t} ({n})" for t, n in sorted(skipped.items())))

    def license_text(ref: str) -> str | None:
        node = by_id.get(ref)
        if node is None:
            return _sentinel(ref)
        return text(node.get("simplelicensing_licenseExpression")) or text(node.get("name")) or ref

    end = lambda x: f"{imported[x]}:{x}" if x in imported else _sentinel(x)
    for n in nodes:
        if not kind(n).endswith("Relationship"):
            continue
        start, ends, what = text(n.get("from")), texts(n.get("to")), text(n.get("relationshipType"))
        if not start or not ends or not what:
            out.note("warning", "REL_MALFORMED", "a relationship without an end or a type")
            continue
        slot = {"hasDeclaredLicense": "license_declared", "hasConcludedLicense": "license_concluded"}.get(what)
        if slot:
            if start in elements:
                elements[start][slot] = license_text(ends[0])
            continue
        for x in ends:
            out.relate(end(start), snake(what), end(x), text(n.get("comment")))
    out.drop_repeated_ids()
    described = [r["to_id"] for r in out.relationships if r["type"] == "DESCRIBES" and r["from_id"] == own_id and r["to_kind"] == "local"]
    listed = [x for h in (document, sbom) if h for x in texts(h.get("rootElement")) if x in elements]
    out.describe([*described, *listed])
    lint.spdx3(nodes, out)
    return out
