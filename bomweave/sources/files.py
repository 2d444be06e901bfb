"""Files into a workspace: each is recognized and parsed by itself, in one narrow map over binary files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bomweave.model import BINDING, DIAGNOSTIC, DOCUMENT, ELEMENT, EXT_REF, RELATIONSHIP, Workspace
from bomweave.operators.profile import sniff as is_profile
from bomweave.sources import archives, cyclonedx, descriptor, spdx2, spdx3
from bomweave.sources.advisories import is_csaf, is_openvex
from bomweave.sources.record import Parsed, record, text, texts
from bomweave.storage import materialize

#: How the names of documents and deliveries end.
EXTENSIONS = "*.{spdx,json,yaml,yml,rdf,tar,tgz,gz,ctf}"
#: Bytes of a batch on its way to a Python worker, where the session doesn't say: files may be long.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _part(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != "doc_id"])


ROW = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("size", T.LongType()), T.StructField("failed", T.BooleanType()), T.StructField("document", _part(DOCUMENT)),
    T.StructField("elements", T.ArrayType(_part(ELEMENT))), T.StructField("relationships", T.ArrayType(_part(RELATIONSHIP))), T.StructField("ext_refs", T.ArrayType(_part(EXT_REF))),
    T.StructField("diagnostics", T.ArrayType(_part(DIAGNOSTIC))),
])


def classify(root: object, form: str) -> str:
    """The format of a parsed object, or the code of the reason why it is none."""
    if not isinstance(root, dict):
        return f"{form}_NOT_OBJECT"
    context = root.get("@context")
    if any("spdx.org/rdf/3." in c for c in texts(context if isinstance(context, list) else [context])):
        return "spdx3"
    version = text(root.get("spdxVersion"))
    if version:
        return "spdx2" if version.startswith("SPDX-2") else "SPDX_UNSUPPORTED_VERSION"
    if text(record(root.get("meta")).get("schemaVersion")) and isinstance(root.get("component"), dict):
        return "descriptor"
    if str(root.get("apiVersion", "")).startswith("ocm.software/v3alpha") and root.get("kind") == "ComponentVersion":
        return "descriptor"
    if re.search(r"-profile/v\d+$", str(root.get("schema", ""))):
        return "BOMWEAVE_PROFILE"
    if root.get("bomFormat") == "CycloneDX":
        return "cyclonedx"
    if "SchemaVersion" in root and "ArtifactName" in root:
        return "TRIVY_NATIVE_NOT_SUPPORTED"
    return f"{form}_NOT_SPDX"


def parse_text(source: str, file_name: str, blobs: dict[str, str] | None = None, noted: bool = True) -> Parsed:
    """A document from its text, recognized by content; what can't be read gives a document that failed, with the reason.

    noted: whether findings of an SPDX 2.x object against its specification are wanted.
    """
    bare = source.lstrip("﻿ \t\r\n")
    form, root = "", None
    if bare[:1] in ("{", "["):
        form = "JSON"
        try:
            root = json.loads(bare)
        except ValueError as e:
            return Parsed().fail("JSON_INVALID", str(e))
    elif re.search(r"^\s*SPDXVersion\s*:", source[:65_536], re.M):
        return spdx2.parse_tag_value(source, file_name)
    elif re.search(r"^\s*['\"]?(spdxVersion|bomFormat|apiVersion|meta)['\"]?\s*:", source[:65_536], re.M):
        form = "YAML"
        try:
            import yaml
        except ImportError:
            return Parsed().fail("YAML_SUPPORT_UNAVAILABLE", "no YAML parser is installed")
        try:
            spdx = "spdxVersion" in source[:65_536]
            root = (json_lines(source) if spdx else None) or _load_yaml(source, "BaseLoader" if spdx else "SafeLoader")
        except yaml.YAMLError as e:
            return Parsed().fail("YAML_INVALID", str(e))
    else:
        return Parsed().fail("UNRECOGNIZED_FORMAT", "no known format")
    kind = classify(root, form)
    if kind == "spdx2":
        return spdx2.parse_object(root, form.lower(), file_name, noted)
    if kind == "spdx3":
        return spdx3.parse_object(root, file_name)
    if kind == "cyclonedx":
        return cyclonedx.parse_object(root, file_name)
    if kind == "descriptor":
        return descriptor.parse_object(root, form.lower(), file_name, blobs)
    return Parsed().fail(kind, "not a document of a known format")


_LINE = re.compile(r"([A-Za-z][A-Za-z0-9]{0,99}): (.+)")
_CONSTANT = re.compile(r"[\[:, ](?:true|false|null)\b")
_LISTED = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=str)


def json_lines(source: str) -> dict | None:
    """What BaseLoader makes of a YAML text whose lines are keys with JSON values, read as JSON; None for any other text.

    Scalars are texts to that loader. So what JSON may read otherwise is refused: a true, false or null (within a text too, where it
    looks like one), and characters that YAML folds or refuses.
    """
    root = {}
    for line in source.rstrip("\n").split("\n"):
        m = _LINE.fullmatch(line)
        if not m or ("\t" in line or "\r" in line or "\x7f" in line if line.isascii() else not line.isprintable()):
            return None
        value = m[2]
        if any(x in value for x in ("true", "false", "null")) and _CONSTANT.search(f" {value}"):
            return None
        try:
            root[m[1]] = _LISTED.decode(value)
        except (ValueError, RecursionError):
            return None
    return root


def _load_yaml(source: str, loader: str) -> object:
    """A YAML text by libyaml, where it is there; what that refuses (such as halves of surrogate pairs) is left to the loader in Python."""
    import yaml

    fast = getattr(yaml, f"C{loader}", None)
    if fast:
        try:
            return yaml.load(source, Loader=fast)
        except (yaml.YAMLError, UnicodeError):
            pass
    return yaml.load(source, Loader=getattr(yaml, loader))


def _safely(source: bytes, name: str, blobs: dict[str, str] | None = None, noted: bool = True) -> Parsed:
    try:
        return parse_text(source.decode("utf-8", "replace"), name, blobs, noted)
    except Exception as e:  # a file that breaks its parser is one failed document, not a failed job
        return Parsed().fail("PARSE_CRASH", f"{type(e).__name__}: {e}")


def parse_file(name: str, data: bytes, parts: Iterable[str] | None = None) -> Iterator[dict]:
    """The rows (ROW, without an order) of one file: several for a delivery, none for an advisory or a profile.

    parts: the lists of ROW that are wanted, else all.
    """
    kind = archives.sniff(data)
    noted = parts is None or "diagnostics" in parts
    row = lambda p, n, b: p.row(n, archives.sha1_hex(b), len(b), 0, parts)
    if kind in ("zip", "binary"):
        yield row(Parsed().fail("ARCHIVE_ZIP_NOT_SUPPORTED" if kind == "zip" else "UNRECOGNIZED_BINARY", "not a text"), name, data)
        return
    if kind == "text":
        source = data.decode("utf-8", "replace")
        if not is_openvex(source) and not is_csaf(source) and not is_profile(source):
            yield row(_safely(data, name, noted=noted), name, data)
        return
    notes: list[dict] = []
    try:
        for n, body, local in archives.delivery_documents(data, notes):
            documents = {ref: b for ref, b in local.items() if archives.sniff(b) == "text" and not _safely(b, ref).failed}
            parsed = _safely(body, n, {ref: archives.sha1_hex(b) for ref, b in documents.items()}, noted)
            yield row(parsed, n, body)
            for ref, b in documents.items():
                yield row(_safely(b, ref, noted=noted), f"{n}/{ref}", b)
    except archives.Unreadable as e:
        notes.append({"severity": "error", "code": e.code, "message": str(e)})
    if notes:
        own = Parsed()
        for x in notes:
            own.note(**x)
        own.failed = True
        yield row(own, name, data)


def fields(**wanted: list[str]) -> T.StructType:
    """ROW with these columns, and of each these fields alone."""
    inner = lambda kind, names: T.ArrayType(inner(kind.elementType, names)) if isinstance(kind, T.ArrayType) else T.StructType([kind[n] for n in names])
    return T.StructType([T.StructField(c, inner(ROW[c].dataType, names)) for c, names in wanted.items()])


def scan(files: DataFrame, wanted: T.StructType = ROW) -> DataFrame:
    """Rows (ROW, or those of its fields that are wanted) of files as the binaryFile source reads them (path, content); order follows the path.

    Each file is parsed in the task that reads it. Several documents of one file are ordered by their place in it. Files are always
    read whole, but lists that aren't wanted are neither made into rows nor sent.
    """
    schema, parts = to_arrow_schema(wanted), wanted.names
    conf = files.sparkSession.conf
    if conf.get(_BYTES, None) is None:
        conf.set(_BYTES, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(*(batch.column(i) for i in (0, 1)), strict=True):
                rows = []
                for k, r in enumerate(parse_file(path.as_py().rpartition("/")[2], data.as_py(), parts)):
                    r["document"]["ord"] = k
                    r["document"]["file_name"] = r["document"]["file_name"] or path.as_py()
                    rows.append(r)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(run, wanted)


def read_rows(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """scan() of all files below a path, written once so that every table of the workspace reads the same parse."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return materialize(_told_apart(scan(files)), "parsed")


def _told_apart(rows: DataFrame) -> DataFrame:
    """With a number of each row, to be written at once: equal files may lie in several folders."""
    return rows.withColumn("row", F.monotonically_increasing_id())


def to_workspace(rows: DataFrame) -> Workspace:
    """The tables of parsed rows: documents in order of file name, equal ones (by bytes) once, ids that clash renamed."""
    spark = rows.sparkSession
    # what comes first is found over names alone: whole documents are joined once, and never gathered by a frequent content or id
    rows = rows if "row" in rows.columns else materialize(_told_apart(rows), "parsed")
    names = rows.where("not failed").select("doc_id", F.col("document.sha1").alias("sha1"), F.struct("document.file_name", "document.ord", "row").alias("rank"))
    once = names.groupBy("sha1").agg(F.min(F.struct("rank", "doc_id")).alias("x")).select("sha1", "x.*")
    first = once.groupBy("doc_id").agg(F.min(F.struct("rank", "sha1")).alias("first"))
    clash = once.join(first, "doc_id").withColumn("clash", F.struct("rank", "sha1") > F.col("first"))
    named = materialize(clash.select("sha1", "rank", "clash", F.when(F.col("clash"), F.concat("doc_id", F.lit("~dup-"), F.substring("sha1", 1, 8))).otherwise(F.col("doc_id")).alias("name")), "names")
    whole = rows.join(named.withColumn("row", F.col("rank.row")), "row")
    ranked = materialize(whole.withColumn("doc_id", F.col("name")).drop("sha1", "name"), "documents")
    ords = ranked.select("doc_id", "rank").orderBy("rank").select("doc_id").withColumn("ord", F.monotonically_increasing_id())  # increases along the sort
    document = ranked.select("doc_id", "document.*").drop("ord").join(materialize(ords, "order"), "doc_id").select(*DOCUMENT.names)
    part = lambda column, schema: ranked.select("doc_id", F.explode(column).alias("x")).select("doc_id", "x.*").select(*schema.names)
    notes = part("diagnostics", DIAGNOSTIC)
    clash = ranked.where("clash").select("doc_id", F.lit(1_000_000).cast("long").alias("seq"), F.lit("warning").alias("severity"), F.lit("DOC_NAMESPACE_COLLISION").alias("code"), F.lit("another document has this namespace").alias("message"), F.lit(None).cast("long").alias("line"))
    return Workspace(document, part("elements", ELEMENT), part("relationships", RELATIONSHIP), part("ext_refs", EXT_REF), notes.unionByName(clash), spark.createDataFrame([], BINDING))


def failures(rows: DataFrame) -> DataFrame:
    """(file_name, code, message) of files that gave no document."""
    return rows.where("failed").select("document.file_name", F.explode("diagnostics").alias("d")).where("d.severity = 'error'").select("file_name", "d.code", "d.message")


def read_workspace(spark: SparkSession, path: str, pattern: str | None = EXTENSIONS) -> Workspace:
    """The workspace of all files below path whose names end as documents and deliveries do; None takes every file."""
    return to_workspace(read_rows(spark, path, pattern))
