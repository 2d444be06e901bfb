"""What a parser makes of one file: a document with its parts, as plain values in the shapes of bomweave.model."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import unquote

from bomweave.model import DOCUMENT, ELEMENT, EXT_REF, RELATIONSHIP

ABSENT = ("NOASSERTION", "NONE")
_DOCUMENT, _ELEMENT, _RELATIONSHIP, _EXT_REF = (tuple(n for n in schema.names if n != "doc_id") for schema in (DOCUMENT, ELEMENT, RELATIONSHIP, EXT_REF))


def text(value: object) -> str | None:
    """A non-empty string, else None: nothing is coerced."""
    return value if isinstance(value, str) and value else None


def record(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def records(value: object) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def texts(value: object) -> list[str]:
    return [x for x in value if isinstance(x, str)] if isinstance(value, list) else []


@lru_cache(1024)
def relationship_type(value: str) -> str:
    return value.strip().upper().replace("-", "_")


def reference(value: str) -> tuple[str, str | None, str | None]:
    """(kind, document reference, id) of an end of a relationship."""
    if value in ABSENT:
        return "special", None, value
    if value.startswith("DocumentRef-"):
        ref, _, own = value.partition(":")
        return "external", ref, own or None
    return "local", None, value


def purl_version(purl: str) -> str | None:
    bare = re.split("[#?]", purl, maxsplit=1)[0]
    at = bare.rfind("@")
    if at < 0 or at < bare.rfind("/") or not bare[at + 1 :]:
        return None
    return unquote(bare[at + 1 :], errors="strict")


def _full(names: tuple[str, ...], values: dict, place: str, at: int) -> dict:
    """All fields of a row in order, with its place; missing ones are None."""
    get = values.get
    out = {n: get(n) for n in names}
    out[place] = at
    return out


@dataclass
class Parsed:
    """One document. Parts keep the order of the file."""

    document: dict = field(default_factory=dict)
    elements: list[dict] = field(default_factory=list)
    relationships: list[dict] = field(default_factory=list)
    ext_refs: list[dict] = field(default_factory=list)
    diagnostics: list[dict] = field(default_factory=list)
    failed: bool = False

    def note(self, severity: str, code: str, message: str, line: int | None = None) -> None:
        self.diagnostics.append({"seq": len(self.diagnostics), "severity": severity, "code": code, "message": message, "line": line})

    def fail(self, code: str, message: str) -> Parsed:
        self.note("error", code, message)
        self.failed = True
        return self

    def relate(self, start: str, kind: str, end: str, comment: str | None = None) -> None:
        (fk, fr, fi), (tk, tr, ti) = reference(start), reference(end)
        self.relationships.append({"type": relationship_type(kind), "from_kind": fk, "from_ref": fr, "from_id": fi, "to_kind": tk, "to_ref": tr, "to_id": ti, "comment": comment})

    def refer(self, doc_ref: str, uri: str, algorithm: str | None = None, value: str | None = None) -> None:
        self.ext_refs.append({"doc_ref": doc_ref, "uri": uri, "checksum_alg": algorithm, "checksum_value": value})

    def drop_repeated_ids(self) -> None:
        """Keep the first element of each id, and say how many went."""
        seen, kept = set(), []
        for e in self.elements:
            if e["spdx_id"] not in seen:
                seen.add(e["spdx_id"])
                kept.append(e)
        gone = len(self.elements) - len(kept)
        if gone:
            self.note("info", "DUP_SPDXID", f"{gone} elements repeat an identifier; the first of each is kept")
        self.elements = kept

    def describe(self, listed: Iterable[str] = ()) -> None:
        """Set what the document describes; every such element gets a DESCRIBES relationship if it has none."""
        own = self.document["spdx_id"]
        found = [r["to_id"] for r in self.relationships if r["type"] == "DESCRIBES" and r["from_kind"] == "local" and r["from_id"] == own and r["to_kind"] == "local"]
        covered = set(found)
        found += [r["from_id"] for r in self.relationships if r["type"] == "DESCRIBED_BY" and r["from_kind"] == "local" and r["to_kind"] == "local" and r["to_id"] == own]
        covered |= set(found)
        found += listed
        self.document["describes"] = list(dict.fromkeys(found))
        for spdx_id in self.document["describes"]:
            if spdx_id not in covered:
                self.relate(own, "DESCRIBES", spdx_id)

    def check_references(self) -> None:
        """One note for references to documents that are used but not declared."""
        declared = {r["doc_ref"] for r in self.ext_refs}
        used = dict.fromkeys(ref for r in self.relationships for kind, ref in ((r["from_kind"], r["from_ref"]), (r["to_kind"], r["to_ref"])) if kind == "external")
        unknown = [u for u in used if u not in declared]
        if unknown:
            self.note("warning", "REL_UNKNOWN_DOCREF", f"{len(unknown)} document references are not declared: {', '.join(unknown[:3])}")

    def row(self, file_name: str, sha1: str, size: int, order: int, parts: Iterable[str] | None = None) -> dict:
        """The document as one nested row; missing fields are None. parts: the lists that are wanted, else all; in those they may be left out."""
        document = _full(_DOCUMENT, self.document, "ord", order) | {"sha1": sha1, "file_name": file_name}
        document["creators"], document["describes"] = document["creators"] or [], document["describes"] or []
        namespace = (document["namespace"] or "").strip()
        out = {"doc_id": namespace or f"urn:bomweave:sha1:{sha1}", "size": size, "failed": self.failed, "document": document}
        for name, names, place, rows in (("elements", _ELEMENT, "pos", self.elements), ("relationships", _RELATIONSHIP, "rel_index", self.relationships), ("ext_refs", _EXT_REF, "pos", self.ext_refs)):
            if parts is None:
                out[name] = [_full(names, r, place, i) for i, r in enumerate(rows)]
            elif name in parts:
                out[name] = rows
                for i, r in enumerate(rows):
                    r[place] = i
        out["diagnostics"] = self.diagnostics
        return out
