"""Component descriptors: the v2 shape, and v3alpha1 brought into it."""

from __future__ import annotations

import re

from bomweave.sources import lint
from bomweave.sources.record import Parsed, record, records, text

#: Access types that are read, without hyphens and versions.
ACCESS_TYPES = {"localblob", "localfilesystemblob", "ociartifact", "ociimage", "ociregistry", "github", "git"}


def as_v2(root: dict) -> tuple[dict, str]:
    """The component in the v2 shape, and the label of the format."""
    if "apiVersion" in root:
        meta, spec = record(root.get("metadata")), record(root.get("spec"))
        provider = meta.get("provider")
        out = {
            "name": meta.get("name"), "version": meta.get("version"), "provider": provider, "labels": meta.get("labels"), "creationTime": meta.get("creationTime"),
            "repositoryContexts": root.get("repositoryContexts"), "resources": spec.get("resources"), "sources": spec.get("sources"), "componentReferences": spec.get("references"),
        }
        return out, "OCM-CD/v3alpha1"
    return record(root.get("component")), "OCM-CD/v2"


def image_purl(image: str, version: str | None) -> str:
    """A package URL of an image: its digest, else its tag, else the artifact's version."""
    bare, _, digest = image.partition("@")
    slash, colon = bare.rfind("/"), bare.rfind(":")
    tag = bare[colon + 1 :] if colon > slash else None
    repository = bare[:colon] if colon > slash else bare
    mark = digest or tag or version
    return f"pkg:oci/{repository.rpartition('/')[2].lower()}{f'@{mark}' if mark else ''}?repository_url={repository}"


def _identity(role: str, name: str) -> str:
    return f"SPDXRef-{role}-" + re.sub("[^A-Za-z0-9.-]", "-", name)


def parse_object(root: dict, serialization: str, file_name: str, blobs: dict[str, str] | None = None) -> Parsed:
    """blobs: SHA-1 of the documents among the local blobs, by their reference."""
    out = Parsed()
    component, label = as_v2(root)
    name, version = text(component.get("name")), text(component.get("version"))
    if not name or not version:
        return out.fail("OCM_CD_MALFORMED", "a component descriptor without name or version")
    provider = text(component.get("provider")) or text(record(component.get("provider")).get("name"))
    if label.endswith("v3alpha1"):
        out.note("info", "OCM_V3ALPHA1", "read as a version 3 descriptor")
    created = text(component.get("creationTime")) or next((text(x.get("value")) for x in records(component.get("labels")) if str(x.get("name", "")).endswith("creationTime")), None)
    out.document = {"model": "ocm", "version": label, "serialization": serialization, "spdx_id": "SPDXRef-DOCUMENT", "name": name, "namespace": f"ocm://{name}/{version}", "created": created, "creators": [f"Organization: {provider}"] if provider else []}
    out.elements.append({"spdx_id": "SPDXRef-component", "kind": "package", "name": name, "version": version, "purpose": "APPLICATION", "supplier": f"Organization: {provider}" if provider else None})
    taken = {"SPDXRef-component"}

    def own_id(role: str, wanted: str) -> str:
        own, n = _identity(role, wanted), 1
        while own in taken:
            n += 1
            own = f"{_identity(role, wanted)}-{n}"
        taken.add(own)
        return own

    unread = unverified = 0
    for role, key in (("resource", "resources"), ("source", "sources")):
        for a in records(component.get(key)):
            own_name = text(a.get("name"))
            if not own_name:
                out.note("warning", "OCM_RESOURCE_MALFORMED", f"a {role} without a name")
                continue
            access, digest = record(a.get("access")), record(a.get("digest"))
            kind = re.sub(r"[-_]|/v\d.*", "", str(access.get("type", "")).lower())
            if access and kind not in ACCESS_TYPES:
                unread += 1
            image = text(access.get("imageReference"))
            local = text(access.get("localReference"))
            where = image or text(access.get("url")) or text(access.get("repoUrl")) or local or text(access.get("filename"))
            full = all(text(digest.get(k)) for k in ("hashAlgorithm", "normalisationAlgorithm", "value"))
            unverified += full
            own = own_id(role, own_name)
            extra = {k: v for k, v in record(a.get("extraIdentity")).items() if isinstance(v, str)}
            out.elements.append({
                "spdx_id": own, "kind": "package", "name": own_name, "version": text(a.get("version")), "purl": image_purl(image, text(a.get("version"))) if image else None,
                "supplier": f"Organization: {provider}" if provider and a.get("relation") == "local" else None, "download_location": where, "purpose": "SOURCE" if role == "source" else text(a.get("type")),
                "checksums": [{"algorithm": digest["hashAlgorithm"].upper().replace("-", ""), "value": digest["value"].lower()}] if full else None, "extra_identity": extra or None,
            })
            out.relate("SPDXRef-component", "CONTAINS", own)
            if local and blobs and local in blobs:
                ref = f"DocumentRef-sbom-{len(out.ext_refs) + 1}"
                out.refer(ref, local, "SHA1", blobs[local])
                out.relate(own, "DESCRIBED_BY", ref)
    for r in records(component.get("componentReferences")):
        there, v = text(r.get("componentName")), text(r.get("version"))
        if not there or not v:
            out.note("warning", "OCM_REF_MALFORMED", "a component reference without name or version")
            continue
        ref = "DocumentRef-" + re.sub("[^A-Za-z0-9.-]", "-", text(r.get("name")) or there)
        taken_refs = {x["doc_ref"] for x in out.ext_refs}
        n, wanted = 1, ref
        while ref in taken_refs:
            n += 1
            ref = f"{wanted}-{n}"
        out.refer(ref, f"ocm://{there}/{v}")
        out.relate("SPDXRef-component", "DEPENDS_ON", ref)
    if unread:
        out.note("info", "OCM_ACCESS_UNSUPPORTED", f"{unread} artifacts have an access that is not read")
    if unverified:
        out.note("info", "OCM_DIGESTS_NOT_VERIFIED", f"{unverified} digests are recorded, not verified")
    out.describe(["SPDXRef-component"])
    lint.descriptor(component, out)
    return out
