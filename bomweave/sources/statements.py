"""Vulnerability statements from files, as the candidates that bomweave.operators.vex lays over packages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bomweave.operators.order import numbered
from bomweave.operators.profile import MAX_BYTES, Profile, sniff, validate
from bomweave.sources import archives
from bomweave.sources.advisories import is_csaf, is_openvex, parse_csaf, parse_openvex
from bomweave.storage import materialize

_TEXTS = ("path", "id", "format", "author", "timestamp", "vulnerability", "status", "justification", "impact", "action", "ref", "stated")
ROW = T.StructType([T.StructField(n, T.StringType()) for n in _TEXTS] + [T.StructField("version", T.LongType()), T.StructField("place", T.LongType()), T.StructField("via_subcomponent", T.BooleanType())])
#: Candidates of one document, at most; their order is the document's and then their own.
DOCUMENT_SPAN = 1 << 32


def route(data: bytes) -> str:
    """Where a file goes before it is parsed: profile, openvex, csaf, or document for everything else."""
    if archives.sniff(data) != "text":
        return "document"
    source = data.decode("utf-8", "replace")
    return "profile" if sniff(source) else "openvex" if is_openvex(source) else "csaf" if is_csaf(source) else "document"


def rows_of(path: str, data: bytes) -> Iterator[dict]:
    """A row a candidate of an advisory; one without ref where it states nothing, so that it still replaces an earlier one."""
    kind = route(data)
    if kind not in ("openvex", "csaf"):
        return
    name = path.rpartition("/")[2]
    d = (parse_openvex if kind == "openvex" else parse_csaf)(data.decode("utf-8", "replace"), name)
    head = {"path": path, "version": d["version"], **{k: d[k] for k in ("id", "format", "author", "timestamp")}}
    found = [{**head, **{k: s[k] for k in ("vulnerability", "status", "justification", "impact", "action")}, "stated": s["timestamp"], "ref": ref, "via_subcomponent": sub >= 0} for s in d["statements"] for ref, _, sub in s["refs"]]
    yield from ({**r, "place": k} for k, r in enumerate(found or [head]))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """(vex_ord, cand_ord, document, vulnerability, status, justification, ref, via_subcomponent, timestamp) of all advisories below path.

    Documents are ordered by path; one that has the id of an earlier one replaces it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return assembled(scan(files))


def scan(files: DataFrame) -> DataFrame:
    """Rows (ROW) of the advisories among files (path, content), each read in the task that has it."""
    schema = to_arrow_schema(ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                own = [*rows_of(p.as_py(), data.as_py())]
                if own:
                    yield pa.RecordBatch.from_pylist(own, schema)

    return files.select("path", "content").mapInArrow(run, ROW)


def read_profiles(spark: SparkSession, path: str) -> list[tuple[str, Profile | None, list[str]]]:
    """(path, profile, what is wrong with it) of the profiles below path, in order of path: small files, read on the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where((F.col("length") <= MAX_BYTES) & F.col("content").cast("string").contains("-profile/v")).select("path", "content")
    texts = ((r.path, bytes(r.content).decode("utf-8", "replace")) for r in small.orderBy("path").collect())
    return [(p, *validate(json.loads(t))) for p, t in texts if sniff(t)]


def assembled(rows: DataFrame) -> DataFrame:
    """What read_statements() gives, from rows of scan()."""
    rows = materialize(rows, "statements")
    last = rows.groupBy("id").agg(F.max("path").alias("path"))
    ranked = numbered(last, "path", name="vex_ord")
    kept = rows.join(ranked, ["id", "path"]).where("ref is not null")
    return kept.select("vex_ord", (F.col("vex_ord") * DOCUMENT_SPAN + F.col("place")).alias("cand_ord"), F.col("id").alias("document"), "vulnerability", "status", "justification", "ref", "via_subcomponent", F.col("stated").alias("timestamp"))
