"""CycloneDX JSON: nested components, dependencies and links to other documents."""

from __future__ import annotations

import re
from urllib.parse import unquote

from bomweave.sources import lint
from bomweave.sources.record import Parsed, record, records, text, texts

MAX_DEPTH = 64
#: Component types and the purposes that they stand for.
PURPOSES = {
    "application": "APPLICATION", "framework": "FRAMEWORK", "library": "LIBRARY", "container": "CONTAINER", "operating-system": "OPERATING_SYSTEM", "device": "DEVICE", "firmware": "FIRMWARE", "platform": "FRAMEWORK", "file": None,
}


def _licenses(value: object, acknowledged: str) -> str | None:
    found = []
    for entry in records(value):
        inner = record(entry.get("license"))
        kind = text(entry.get("acknowledgement")) or text(inner.get("acknowledgement")) or text(entry.get("acknowledgment")) or "declared"
        name = text(entry.get("expression")) or text(inner.get("id")) or text(inner.get("name"))
        if name and kind == acknowledged:
            found.append(name)
    return " AND ".join(found) or None


def _unique(wanted: str, taken: set[str]) -> str:
    own, n = wanted, 1
    while own in taken:
        n += 1
        own = f"{wanted}-{n}"
    taken.add(own)
    return own


def parse_object(root: dict, file_name: str) -> Parsed:
    out, meta = Parsed(), record(root.get("metadata"))
    serial, version = text(root.get("serialNumber")), root.get("version")
    number = version if isinstance(version, int) and not isinstance(version, bool) else 1
    m = re.fullmatch(r"urn:uuid:(.+)", serial or "")
    main = record(meta.get("component"))
    tools = meta.get("tools")
    tool_list = records(tools) or [*records(record(tools).get("components")), *records(record(tools).get("services"))]
    creators = ["Tool: " + "-".join(x for x in (text(t.get("name")), text(t.get("version"))) if x) for t in tool_list if text(t.get("name"))]
    creators += [f"Person: {n}" + (f" ({mail})" if (mail := text(a.get("email"))) else "") for a in records(meta.get("authors")) if (n := text(a.get("name")))]
    out.document = {
        "model": "cyclonedx", "version": f"CycloneDX-{text(root.get('specVersion')) or '1.x'}", "serialization": "json", "spdx_id": "SPDXRef-DOCUMENT", "name": text(main.get("name")) or file_name,
        "namespace": f"urn:cdx:{m[1].lower()}/{number}" if m else None, "created": text(meta.get("timestamp")), "creators": creators,
    }
    taken: set[str] = set()
    by_ref: dict[str, str] = {}
    links: dict[str, str] = {}
    every: list[dict] = []
    capped = 0

    def link(urn: str) -> tuple[str, str | None]:
        """Reference and element id of a link to another document."""
        head, _, fragment = urn.partition("#")
        name = links.get(head.lower())
        if name is None:
            name = links[head.lower()] = f"DocumentRef-cdx{len(links) + 1}"
            out.refer(name, head.lower())
        return name, unquote(fragment, errors="strict") or None

    def add(component: dict, parent: str | None, depth: int) -> None:
        nonlocal capped
        every.append(component)
        name = text(component.get("name"))
        if not name:
            out.note("warning", "CDX_COMPONENT_MALFORMED", "a component without a name")
            return
        ref = text(component.get("bom-ref"))
        own = _unique(ref or "SPDXRef-" + re.sub("[^A-Za-z0-9.-]", "-", name), taken)
        if ref:
            by_ref.setdefault(ref, own)
        kind = text(component.get("type")) or ""
        external = [{"category": "OTHER", "type": t, "locator": u} for x in records(component.get("externalReferences")) if (t := text(x.get("type"))) and (u := text(x.get("url")))]
        cpe = text(component.get("cpe"))
        refs = ([{"category": "SECURITY", "type": "cpe23Type", "locator": cpe}] if cpe else []) + external
        sums = [{"algorithm": a.upper().replace("-", ""), "value": v.lower()} for h in records(component.get("hashes")) if (a := text(h.get("alg"))) and (v := text(h.get("content")))]
        out.elements.append({
            "spdx_id": own, "kind": "file" if kind == "file" else "package", "name": name, "version": text(component.get("version")), "purl": text(component.get("purl")),
            "supplier": text(record(component.get("supplier")).get("name")) or text(component.get("publisher")), "license_concluded": _licenses(component.get("licenses"), "concluded"),
            "license_declared": _licenses(component.get("licenses"), "declared"), "copyright": text(component.get("copyright")), "purpose": PURPOSES.get(kind, kind.upper().replace("-", "_") or None),
            "description": text(component.get("description")), "checksums": sums or None, "external_refs": refs or None,
        })
        if parent:
            out.relate(parent, "CONTAINS", own)
        for x in external:
            if x["type"] == "bom" and x["locator"].lower().startswith("urn:cdx:"):
                doc, fragment = link(x["locator"])
                out.relate(own, "DEPENDS_ON", f"{doc}:{fragment}" if fragment else doc)
        inner = records(component.get("components"))
        if inner and depth >= MAX_DEPTH:
            capped += len(inner)
            return
        for x in inner:
            add(x, own, depth + 1)

    if main:
        add(main, None, 1)
    top = out.elements[0]["spdx_id"] if main and out.elements else None
    for component in records(root.get("components")):
        add(component, top, 1)
    unmapped = 0
    for d in records(root.get("dependencies")):
        start = by_ref.get(text(d.get("ref")) or "")
        for x in texts(d.get("dependsOn")):
            if x.lower().startswith("urn:cdx:") and start:
                doc, fragment = link(x)
                out.relate(start, "DEPENDS_ON", f"{doc}:{fragment}" if fragment else doc)
            elif start and x in by_ref:
                out.relate(start, "DEPENDS_ON", by_ref[x])
            else:
                unmapped += 1
    if unmapped:
        out.note("info", "CDX_DEPENDENCIES_UNMAPPED", f"{unmapped} dependencies name no component")
    if capped:
        out.note("warning", "CDX_NESTING_CAPPED", f"{capped} components are nested too deep")
    out.describe([top] if top else [])
    lint.cyclonedx(root, every, out)
    return out
