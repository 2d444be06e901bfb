"""What a delivered blob is, with a bounded preview, and whether its digest is the declared one."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from bomweave.sources import archives

#: Bytes of a preview and of a binary's head, files that a listing shows.
PREVIEW, HEAD, LISTED = 64 << 10, 256, 500


@dataclass
class Blob:
    kind: str
    size: int
    preview: str | None = None
    files: list[str] = field(default_factory=list)
    more_files: int = 0


def _json(source: str) -> bool:
    try:
        json.loads(source)
    except ValueError:
        return False
    return True


def inspect(data: bytes) -> Blob:
    """text, json, yaml, binary, tar, helm-chart or oci-artifact; archives list their files, packed ones are unpacked."""
    kind = archives.sniff(data)
    plain = data
    if kind == "gzip":
        try:
            plain = archives.gunzip(data)
        except archives.Unreadable:
            return Blob("binary", len(data), data[:HEAD].hex())
        kind = archives.sniff(plain)
    if kind == "tar":
        names = [n for n, _ in archives.tar_entries(plain, [])]
        folders = {n.split("/")[0] for n in names if n.count("/") == 1 and n.endswith("/Chart.yaml")}
        what = "helm-chart" if folders else "oci-artifact" if {"oci-layout", "artifact-descriptor.json", "index.json"} & {*names} else "tar"
        return Blob(what, len(data), files=names[:LISTED], more_files=max(0, len(names) - LISTED))
    if kind != "text":
        return Blob("binary", len(data), plain[:HEAD].hex())
    source = plain.decode("utf-8", "replace")
    if source.lstrip()[:1] in ("{", "[") and _json(source):
        what = "json"
    else:
        first = next((x for x in source.splitlines() if x.strip() and not x.startswith("#")), "")
        what = "yaml" if first.startswith("---") or ":" in first and not first.startswith(" ") and "{" not in first else "text"
    return Blob(what, len(data), source[:PREVIEW])


def scan(files: DataFrame) -> DataFrame:
    """path, kind, size, preview, files and more_files of each file (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("preview", pa.string()), ("files", pa.list_(pa.string())), ("more_files", pa.int64())])
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": path.as_py(), **asdict(inspect(data.as_py()))}], schema)

    return files.select("path", "content").mapInArrow(run, "path string, kind string, size long, preview string, files array<string>, more_files long")


def digests(data: bytes, manifest: bytes | None = None) -> dict[str, str | None]:
    """SHA-256 of a blob as stored, unpacked (if packed) and of its manifest, for acceptance.blob_verdict()."""
    unpacked = None
    if archives.sniff(data) == "gzip":
        try:
            unpacked = hashlib.sha256(archives.gunzip(data)).hexdigest()
        except archives.Unreadable:
            unpacked = None
    return {"stored": hashlib.sha256(data).hexdigest(), "unpacked": unpacked, "manifest": hashlib.sha256(manifest).hexdigest() if manifest is not None else None}
