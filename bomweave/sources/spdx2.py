"""SPDX 2.x: JSON and YAML objects, and tag-value text."""

from __future__ import annotations

import re

from bomweave.sources import lint
from bomweave.sources.record import Parsed, purl_version, record, records, text, texts

ANONYMOUS = "SPDXRef-bomweave-anonymous-"


#: Fields of an element and the keys that fill them, where those are texts.
_BASE_KEYS = {"license_concluded": "licenseConcluded", "copyright": "copyrightText", "comment": "comment"}
_PACKAGE_KEYS = _BASE_KEYS | {"version": "versionInfo", "supplier": "supplier", "originator": "originator", "download_location": "downloadLocation", "license_declared": "licenseDeclared", "purpose": "primaryPackagePurpose"}
_FIELDS = {"package": tuple(_PACKAGE_KEYS.items()), "file": tuple(_BASE_KEYS.items())}


def _checksums(value: object) -> list[dict] | None:
    if not value:
        return None
    found = [{"algorithm": a.upper(), "value": v.lower()} for c in records(value) if (a := text(c.get("algorithm"))) and (v := text(c.get("checksumValue")))]
    return found or None


def _references(value: object) -> list[dict] | None:
    if not value:
        return None
    found = [{"category": text(r.get("referenceCategory")), "type": t, "locator": v} for r in records(value) if (t := text(r.get("referenceType"))) and (v := text(r.get("referenceLocator")))]
    return found or None


def _purl(refs: list[dict] | None) -> str | None:
    return next((r["locator"] for r in refs or [] if r["type"] == "purl"), None)


def parse_object(root: dict, serialization: str, file_name: str, noted: bool = True) -> Parsed:
    """A document from its root; noted: whether findings against the specification are wanted."""
    out, info = Parsed(), record(root.get("creationInfo"))
    out.document = {
        "model": "spdx-2", "version": text(root.get("spdxVersion")) or "SPDX-2.x", "serialization": serialization, "spdx_id": text(root.get("SPDXID")) or "SPDXRef-DOCUMENT", "name": text(root.get("name")) or file_name,
        "namespace": text(root.get("documentNamespace")), "created": text(info.get("created")), "creators": texts(info.get("creators")), "comment": text(root.get("comment")), "data_license": text(root.get("dataLicense")),
    }
    if not out.document["namespace"]:
        out.note("warning", "DOC_NO_NAMESPACE", "the document has no namespace")
    for r in records(root.get("externalDocumentRefs")):
        name, uri = text(r.get("externalDocumentId")), text(r.get("spdxDocument"))
        if not name or not uri:
            out.note("warning", "EXTREF_MALFORMED", "an external document reference without id or document")
            continue
        sums = _checksums([r.get("checksum")])
        out.refer(name, uri, *((sums[0]["algorithm"], sums[0]["value"]) if sums else (None, None)))
    nameless = 0
    for kind, key in (("package", "packages"), ("file", "files")):
        for e in records(root.get(key)):
            own = text(e.get("SPDXID"))
            if not own:
                nameless += 1
                own = f"{ANONYMOUS}{nameless}"
                out.note("warning", "JSON_MISSING_SPDXID", f"a {kind} without an identifier")
            get = e.get
            element = {field: v if isinstance(v := get(k), str) and v else None for field, k in _FIELDS[kind]}
            element["spdx_id"], element["kind"], element["checksums"] = own, kind, _checksums(get("checksums"))
            out.elements.append(element)
            if kind == "file":
                element["name"] = text(get("fileName")) or own
                continue
            element["external_refs"] = refs = _references(get("externalRefs"))
            element["purl"] = purl = _purl(refs)
            element["name"], element["description"] = text(get("name")) or own, text(get("description")) or text(get("summary"))
            if purl and not element["version"]:
                element["version"] = purl_version(purl)
    if records(root.get("snippets")):
        out.note("info", "JSON_SNIPPETS_SKIPPED", f"{len(records(root['snippets']))} snippets are not read")
    for r in records(root.get("relationships")):
        get = r.get
        start, kind, end = text(get("spdxElementId")), text(get("relationshipType")), text(get("relatedSpdxElement"))
        if start and kind and end:
            out.relate(start, kind, end, text(get("comment")))
        else:
            out.note("warning", "REL_MALFORMED", "a relationship without an end or a type")
    out.drop_repeated_ids()
    out.describe(texts(root.get("documentDescribes")))
    if noted:
        out.check_references()
        lint.spdx2(root, out)
    return out


#: Tags of an element and the fields that they fill.
_ELEMENT_TAGS = {
    "PackageVersion": "version", "PackageSupplier": "supplier", "PackageOriginator": "originator", "PackageDownloadLocation": "download_location", "PackageLicenseConcluded": "license_concluded",
    "PackageLicenseDeclared": "license_declared", "PackageCopyrightText": "copyright", "PrimaryPackagePurpose": "purpose", "PackageDescription": "description", "PackageComment": "comment",
    "LicenseConcluded": "license_concluded", "FileCopyrightText": "copyright", "FileComment": "comment",
}
_DOCUMENT_TAGS = {"SPDXVersion": "version", "DataLicense": "data_license", "DocumentName": "name", "DocumentNamespace": "namespace", "Created": "created", "DocumentComment": "comment"}
_SKIPPED_BLOCKS = {"SnippetSPDXID", "LicenseID", "Annotator"}
_TAG = re.compile(r"^([A-Za-z][A-Za-z0-9]*)\s*:\s?(.*)$")
_SUM = re.compile(r"([A-Za-z0-9-]+)\s*:\s*([0-9a-fA-F]+)")


def _lines(source: str, out: Parsed):
    """(line number, tag, value) of each tag; a <text> value may take several lines."""
    lines = source.splitlines()
    at = 0
    while at < len(lines):
        number, line = at + 1, lines[at]
        at += 1
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        m = _TAG.match(bare)
        if not m:
            out.note("warning", "TV_MALFORMED_LINE", "a line that is no tag", number)
            continue
        tag, value = m[1], m[2].strip()
        if value.startswith("<text>"):
            value = value[len("<text>") :]
            while "</text>" not in value and at < len(lines):
                value += f"\n{lines[at]}"
                at += 1
            if "</text>" not in value:
                out.note("warning", "TV_UNTERMINATED_TEXT", "a text that does not end", number)
            value = value.partition("</text>")[0].strip()
        yield number, tag, value


def _external(value: str, out: Parsed, number: int) -> None:
    m = re.fullmatch(r"(\S+)\s+(\S+)(?:\s+(.+))?", value)
    if not m:
        out.note("warning", "EXTREF_MALFORMED", "an external document reference without a document", number)
        return
    if not m[1].startswith("DocumentRef-"):
        out.note("warning", "EXTREF_BAD_ID", f"{m[1]} is no document reference", number)
    checksum = _SUM.fullmatch(m[3].strip()) if m[3] else None
    if m[3] and not checksum:
        out.note("warning", "EXTREF_BAD_CHECKSUM", "a checksum that cannot be read", number)
    elif not m[3]:
        out.note("warning", "EXTREF_NO_CHECKSUM", f"{m[1]} has no checksum", number)
    out.refer(m[1], m[2], *((checksum[1].upper(), checksum[2].lower()) if checksum else (None, None)))


def parse_tag_value(source: str, file_name: str) -> Parsed:
    """One pass over the lines: a package or file begins at its name, other blocks are passed over."""
    out = Parsed()
    doc: dict = {"model": "spdx-2", "serialization": "tag-value", "creators": []}
    current: dict | None = None
    skipping, skipped, orphans, nameless = False, 0, 0, 0
    raw: dict = {"packages": [], "files": [], "relationships": [], "creationInfo": {"creators": doc["creators"]}}
    for number, tag, value in _lines(source, out):
        if tag in ("PackageName", "FileName"):
            current = {"kind": "package" if tag == "PackageName" else "file", "name": value, "line": number}
            out.elements.append(current)
            skipping = False
        elif tag in _SKIPPED_BLOCKS:
            current, skipping, skipped = None, True, skipped + 1
        elif tag == "Relationship":
            parts = value.split()
            if len(parts) == 3:
                out.relate(*parts)
                raw["relationships"].append({"relationshipType": parts[1]})
            else:
                out.note("warning", "REL_MALFORMED", "a relationship without an end or a type", number)
        elif tag == "RelationshipComment":
            if out.relationships:
                out.relationships[-1]["comment"] = value
        elif tag == "ExternalDocumentRef":
            _external(value, out, number)
        elif tag == "Creator":
            doc["creators"].append(value)
        elif tag in _DOCUMENT_TAGS:
            doc.setdefault(_DOCUMENT_TAGS[tag], value)
        elif tag == "SPDXID":
            if skipping:
                continue
            if current is None:
                if "spdx_id" in doc:
                    out.note("warning", "TV_DUP_DOC_SPDXID", "the document's identifier is repeated", number)
                else:
                    doc["spdx_id"] = value
            elif "spdx_id" in current:
                out.note("warning", "TV_DUP_ELEMENT_SPDXID", f"{current['name']} has several identifiers", number)
            else:
                current["spdx_id"] = value
        elif skipping:
            continue
        elif current is None:
            orphans += 1
        elif tag in ("PackageChecksum", "FileChecksum"):
            m = _SUM.fullmatch(value)
            if m:
                current.setdefault("checksums", []).append({"algorithm": m[1].upper(), "value": m[2].lower()})
            else:
                out.note("warning", "TV_BAD_CHECKSUM", "a checksum that cannot be read", number)
        elif tag == "ExternalRef":
            parts = value.split()
            if len(parts) == 3:
                current.setdefault("external_refs", []).append(dict(zip(("category", "type", "locator"), parts, strict=True)))
            else:
                out.note("warning", "TV_BAD_EXTERNAL_REF", "an external reference that cannot be read", number)
        elif tag in _ELEMENT_TAGS and value:
            current.setdefault(_ELEMENT_TAGS[tag], value)
    if orphans:
        out.note("info", "TV_ORPHAN_TAGS", f"{orphans} tags belong to no element")
    if skipped:
        out.note("info", "TV_BLOCKS_SKIPPED", f"{skipped} blocks are not read")
    for e in out.elements:
        line = e.pop("line")
        written = e.get("spdx_id")
        if written is None:
            nameless += 1
            e["spdx_id"] = f"{ANONYMOUS}{nameless}"
            out.note("warning", "TV_MISSING_SPDXID", f"{e['name']} has no identifier", line)
        if e["kind"] == "package":
            e["purl"] = _purl(e.get("external_refs"))
            e["version"] = e.get("version") or (purl_version(e["purl"]) if e["purl"] else None)
        raw["packages" if e["kind"] == "package" else "files"].append({"SPDXID": written, "name": e["name"], "fileName": e["name"], "downloadLocation": e.get("download_location"), "primaryPackagePurpose": e.get("purpose"), "licenseConcluded": e.get("license_concluded"), "licenseDeclared": e.get("license_declared")})
    raw |= {"SPDXID": doc.get("spdx_id"), "spdxVersion": doc.get("version"), "dataLicense": doc.get("data_license"), "documentNamespace": doc.get("namespace")}
    raw["creationInfo"]["created"] = doc.get("created")
    doc.setdefault("spdx_id", "SPDXRef-DOCUMENT")
    doc.setdefault("name", file_name)
    doc.setdefault("version", "SPDX-2.x")
    if not doc.get("namespace"):
        out.note("warning", "DOC_NO_NAMESPACE", "the document has no namespace")
    out.document = doc
    out.drop_repeated_ids()
    out.describe()
    out.check_references()
    lint.spdx2(raw, out, tag_value=True)
    return out
