"""Containers: what kind of file bytes are, gunzip and tar with bounds, and the documents inside a delivery."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

#: Bounds of what is unpacked.
MAX_GUNZIP, MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, MAX_DOCUMENT = 2 << 30, 10_000, 64 << 20, 512 << 20, 512 << 20
DESCRIPTORS = ("component-descriptor.yaml", "component-descriptor.json")


class Unreadable(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def sniff(data: bytes) -> str:
    """gzip, zip, tar, binary or text, by content only."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:4] == b"PK\x03\x04":
        return "zip"
    if data[257:262] == b"ustar":
        return "tar"
    return "binary" if b"\0" in data[:8192] else "text"


def gunzip(data: bytes, limit: int = MAX_GUNZIP) -> bytes:
    """The unpacked bytes; more than limit of them, or broken ones, are refused."""
    out, total = [], 0
    try:
        while data:
            z = zlib.decompressobj(31)
            while True:
                part = z.decompress(data, min(1 << 20, limit - total + 1))
                total += len(part)
                if total > limit:
                    raise Unreadable("GZIP_TOO_LARGE", f"over {limit} bytes when unpacked")
                out.append(part)
                data = z.unconsumed_tail
                if z.eof:
                    data = z.unused_data
                    break
                if not data and not part:
                    raise Unreadable("GZIP_INVALID", "the archive ends early")
    except zlib.error as e:
        raise Unreadable("GZIP_INVALID", str(e)) from None
    return b"".join(out)


def _octal(field: bytes) -> int:
    return int(field.strip(b"\0 ") or b"0", 8)


def tar_entries(data: bytes, notes: list[dict]) -> Iterator[tuple[str, bytes | None]]:
    """(path, content) of each regular file; content is None for one beyond the bounds. Links and folders are passed over."""
    note = lambda severity, code, message: notes.append({"severity": severity, "code": code, "message": message})
    at, count, total, path, indexed, skipped = 0, 0, 0, None, 0, 0
    while at + 512 <= len(data):
        head = data[at : at + 512]
        if not head.strip(b"\0"):
            break
        try:
            size, recorded = _octal(head[124:136]), _octal(head[148:156])
        except ValueError:
            if count:
                note("warning", "TAR_SIZE_UNSUPPORTED", "an entry's size cannot be read")
                break
            raise Unreadable("TAR_CORRUPT", "the first entry cannot be read") from None
        if sum(head[:148]) + 8 * 32 + sum(head[156:]) != recorded:
            if not count:
                raise Unreadable("TAR_CORRUPT", "the first entry's checksum is wrong")
            note("warning", "TAR_BAD_CHECKSUM", "an entry's checksum is wrong; the rest is not read")
            break
        start = at + 512
        if start + size > len(data):
            note("warning", "TAR_TRUNCATED", "the archive ends inside an entry")
            break
        at = start + (size + 511) // 512 * 512
        kind, body = head[156:157], data[start : start + size]
        if kind == b"x":
            rest = body
            while rest:
                length, _, _ = rest.partition(b" ")
                if not length.isdigit() or not int(length):
                    break
                key, _, value = rest[len(length) + 1 : int(length) - 1].partition(b"=")
                if key == b"path":
                    path = value.decode("utf-8", "replace")
                rest = rest[int(length) :]
            continue
        if kind == b"L":
            path = body.rstrip(b"\0").decode("utf-8", "replace")
            continue
        prefix, own = head[345:500].rstrip(b"\0").decode("utf-8", "replace"), head[:100].split(b"\0")[0].decode("utf-8", "replace")
        name, path = path or (f"{prefix}/{own}" if prefix else own), None
        if kind not in (b"0", b"\0"):
            skipped += kind != b"5"
            continue
        count += 1
        if count > MAX_ENTRIES:
            note("warning", "ARCHIVE_LIMIT_EXCEEDED", f"only the first {MAX_ENTRIES} entries are read")
            break
        total += size
        keep = size <= MAX_ENTRY and total <= MAX_TOTAL
        indexed += not keep
        yield name.removeprefix("./"), body if keep else None
    if indexed:
        note("info", "ARCHIVE_BLOBS_INDEXED", f"{indexed} entries are listed, not read")
    if skipped:
        note("info", "TAR_ENTRY_SKIPPED", f"{skipped} links or special entries")


def write_tar(files: dict[str, bytes]) -> bytes:
    """The same bytes for the same files: sorted, without times; long names as extended headers."""

    def head(name: bytes, size: int, kind: bytes) -> bytes:
        out = bytearray(name.ljust(100, b"\0") + b"0000644\0" + b"0000000\0" * 2 + b"%011o\0" % size + b"00000000000\0" + b" " * 8 + kind + b"\0" * 100 + b"ustar\x0000" + b"\0" * 247)
        out[148:156] = b"%06o\0 " % sum(out)
        return bytes(out)

    pad = lambda b: b + b"\0" * (-len(b) % 512)
    out = []
    for name, body in sorted(files.items()):
        own = name.encode()
        if len(own) > 100:
            line = b" path=" + own + b"\n"
            n = len(line) + 1
            while len(str(n)) + len(line) != n:
                n = len(str(n)) + len(line)
            extended = str(n).encode() + line
            out += [head(b"pax", len(extended), b"x"), pad(extended)]
        out += [head(own[:100], len(body), b"0"), pad(body)]
    return b"".join([*out, b"\0" * 1024])


def _blob(entries: dict[str, bytes | None], digest: str) -> bytes | None:
    return entries.get("blobs/" + digest.replace(":", "."))


def delivery_documents(data: bytes, notes: list[dict]) -> Iterator[tuple[str, bytes, dict[str, bytes]]]:
    """(name, bytes, local blobs) of the documents in a delivery.

    A transport archive lists artifacts whose descriptor layer and local blobs are entries named by digest; a component archive
    has the descriptor and its blobs; of anything else every text entry counts.
    """
    kind = sniff(data)
    if kind == "gzip":
        data = gunzip(data)
        if sniff(data) != "tar":
            raise Unreadable("GZIP_NOT_TAR", "a packed file that is no archive")
    entries = dict(tar_entries(data, notes))
    index = entries.get("artifact-index.json")
    if index is not None:
        try:
            listed = json.loads(index).get("artifacts", [])
        except (ValueError, AttributeError):
            notes.append({"severity": "warning", "code": "CTF_INDEX_INVALID", "message": "the list of artifacts cannot be read"})
            listed = []
        for a in listed:
            name = f"{a.get('repository', '')}:{a.get('tag', '')}"
            blob = _blob(entries, str(a.get("digest", "")))
            try:
                if blob is not None and sniff(blob) in ("gzip", "tar"):
                    inner = dict(tar_entries(gunzip(blob) if sniff(blob) == "gzip" else blob, notes))
                    manifest = json.loads(inner[next(x for x in inner if x.startswith("artifact-descriptor") or x.endswith("manifest.json"))] or b"")
                else:
                    inner, manifest = entries, json.loads(blob or b"")
                layers = [_blob(inner, str(layer.get("digest", ""))) for layer in manifest.get("layers", [])]
                local = {str(layer.get("digest", "")): body for layer, body in zip(manifest.get("layers", []), layers, strict=True) if body is not None}
                first = layers[0] if layers else None
                if first is not None and sniff(first) in ("gzip", "tar"):
                    packed = dict(tar_entries(gunzip(first) if sniff(first) == "gzip" else first, notes))
                    first = next((packed[x] for x in DESCRIPTORS if packed.get(x)), None)
                if first is None:
                    raise ValueError("no descriptor")
                yield name, first, local
            except (ValueError, StopIteration, KeyError, AttributeError, TypeError):
                notes.append({"severity": "warning", "code": "CTF_ARTIFACT_UNREADABLE", "message": f"{name} cannot be read"})
        return
    own = next((x for x in DESCRIPTORS if entries.get(x)), None)
    if own:
        yield own, entries[own] or b"", {x.rpartition("/")[2]: b for x, b in entries.items() if x.startswith("blobs/") and b is not None}
        return
    found = False
    for name, body in entries.items():
        if body and sniff(body) == "text":
            found = True
            yield name, body, {}
    if not found:
        raise Unreadable("ARCHIVE_NO_DOCUMENTS", "no document is in the archive")


def sha1_hex(data: bytes) -> str:
    return hashlib.sha1(data).hexdigest()
