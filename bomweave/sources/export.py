"""Documents of a workspace as files again, one row (path, content) each: SPDX JSON, YAML and tag-value, SPDX 3, CycloneDX, component
descriptors, archives of one document; and statements as OpenVEX and CSAF files.

A document's parts are gathered by its id: as many rows in a group as the file has entries, which a file has to hold anyway.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomweave.model import Workspace
from bomweave.sources.archives import write_tar


def _parts(df: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    rows = df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v")))).alias("p"))
    return rows.select("doc_id", F.transform("p", lambda x: x["v"]).alias(name))


def _packages(ws: Workspace) -> DataFrame:
    return ws.element.where("kind = 'package'")


def _struct(**columns: Column | str) -> Column:
    return F.struct(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))


def _end(side: str) -> Column:
    kind, ref, own = (F.col(f"{side}_{c}") for c in ("kind", "ref", "id"))
    return F.when(kind == "external", F.concat(ref, F.coalesce(F.concat(F.lit(":"), own), F.lit(":SPDXRef-DOCUMENT")))).otherwise(own)


def _refs() -> Column:
    return F.transform("external_refs", lambda r: F.struct(r["category"].alias("referenceCategory"), r["type"].alias("referenceType"), r["locator"].alias("referenceLocator")))


def _text(c: str) -> Column:
    """A text as JSON; null where there is none."""
    text = F.col(c)
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))


def _list(texts: str) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def _spdx2(ws: Workspace, entry: str, between: str) -> tuple[DataFrame, Column]:
    """Documents, and the entries of an SPDX root that are there, each a key and its value as JSON.

    Parts are JSON before they are gathered: a document's are joined as texts, and no nested row of all of them is made.
    """
    sums = F.transform("checksums", lambda c: F.struct(c["algorithm"].alias("algorithm"), c["value"].alias("checksumValue")))
    package = _struct(
        SPDXID="spdx_id", name="name", versionInfo="version", supplier="supplier", originator="originator", downloadLocation="download_location", licenseConcluded="license_concluded", licenseDeclared="license_declared",
        primaryPackagePurpose="purpose", checksums=sums, externalRefs=_refs(),
    )
    relation = _struct(spdxElementId=_end("from"), relationshipType="type", relatedSpdxElement=_end("to"))
    ref = _struct(externalDocumentId="doc_ref", spdxDocument="uri", checksum=F.when(F.col("checksum_value").isNotNull(), F.struct(F.col("checksum_alg").alias("algorithm"), F.col("checksum_value").alias("checksumValue"))))
    p, r, x = (_parts(df, F.to_json(value), order, name) for df, value, order, name in ((_packages(ws), package, "pos", "p"), (ws.relationship, relation, "rel_index", "r"), (ws.ext_ref, ref, "pos", "x")))
    values = {
        "spdxVersion": _text("version"), "dataLicense": _text("data_license"), "SPDXID": _text("spdx_id"), "name": _text("name"), "documentNamespace": _text("namespace"), "creationInfo": F.to_json(F.struct("created", "creators")),
        "documentDescribes": F.to_json("describes"), "packages": _list("p"), "relationships": _list("r"), "externalDocumentRefs": _list("x"),
    }
    entries = (F.concat(F.lit(entry.format(k)), v) for k, v in values.items())
    return ws.document.join(p, "doc_id", "left").join(r, "doc_id", "left").join(x, "doc_id", "left"), F.concat_ws(between, *entries)


def spdx_json(ws: Workspace) -> DataFrame:
    d, entries = _spdx2(ws, '"{}":', ",")
    return d.select("doc_id", F.concat("doc_id", F.lit(".spdx.json")).alias("path"), F.concat(F.lit("{"), entries, F.lit("}")).cast("binary").alias("content"))


def tag_value(ws: Workspace) -> DataFrame:
    line = lambda tag, c: F.when(c.isNotNull(), F.concat(F.lit(f"{tag}: "), c))
    lines = lambda *c: F.array_join(F.array_compact(F.array(*c)), "\n")
    sums = F.array_join(F.transform("checksums", lambda c: F.concat(F.lit("PackageChecksum: "), c["algorithm"], F.lit(": "), c["value"])), "\n")
    refs = F.array_join(F.transform("external_refs", lambda r: F.concat(F.lit("ExternalRef: "), F.concat_ws(" ", r["category"], r["type"], r["locator"]))), "\n")
    fields = {"PackageName": "name", "SPDXID": "spdx_id", "PackageVersion": "version", "PackageSupplier": "supplier", "PackageOriginator": "originator", "PackageDownloadLocation": "download_location", "PackageLicenseConcluded": "license_concluded", "PackageLicenseDeclared": "license_declared", "PrimaryPackagePurpose": "purpose"}
    package = lines(*(line(t, F.col(c)) for t, c in fields.items()), sums, refs)
    relation = F.concat(F.lit("Relationship: "), F.concat_ws(" ", _end("from"), "type", _end("to")))
    ref = F.concat(F.lit("ExternalDocumentRef: "), F.concat_ws(" ", "doc_ref", "uri", F.concat(F.col("checksum_alg"), F.lit(":"), F.col("checksum_value"))))
    d = ws.document.join(_parts(_packages(ws), package, "pos", "p"), "doc_id", "left").join(_parts(ws.relationship, relation, "rel_index", "r"), "doc_id", "left").join(_parts(ws.ext_ref, ref, "pos", "x"), "doc_id", "left")
    head = {"SPDXVersion": "version", "DataLicense": "data_license", "SPDXID": "spdx_id", "DocumentName": "name", "DocumentNamespace": "namespace", "Created": "created"}
    described = F.array_join(F.transform("describes", lambda x: F.concat(F.lit("Relationship: SPDXRef-DOCUMENT DESCRIBES "), x)), "\n")
    creators = F.array_join(F.transform("creators", lambda x: F.concat(F.lit("Creator: "), x)), "\n")
    text = lines(*(line(t, F.col(c)) for t, c in head.items()), creators, described, F.array_join("x", "\n"), F.array_join("p", "\n\n"), F.array_join("r", "\n"))
    return d.select("doc_id", F.concat("doc_id", F.lit(".spdx")).alias("path"), text.cast("binary").alias("content"))


def cyclonedx(ws: Workspace) -> DataFrame:
    """Packages as flat components below one for the document; relationships that contain or depend become dependencies."""
    sums = F.transform("checksums", lambda c: F.struct(c["algorithm"].alias("alg"), c["value"].alias("content")))
    component = F.struct(F.lit("library").alias("type"), F.col("spdx_id").alias("bom-ref"), "name", "version", "purl", sums.alias("hashes"), F.struct(F.col("supplier").alias("name")).alias("supplier"))
    inner = ws.relationship.where("type in ('CONTAINS', 'DEPENDS_ON') and from_kind = 'local' and to_kind = 'local'")
    needs = inner.groupBy("doc_id", F.col("from_id").alias("ref")).agg(F.array_sort(F.collect_set("to_id")).alias("dependsOn"))
    d = ws.document.join(_parts(_packages(ws), component, "pos", "components"), "doc_id", "left").join(_parts(needs, F.struct("ref", "dependsOn"), "ref", "dependencies"), "doc_id", "left")
    h = F.md5("namespace")
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    main = F.struct(F.lit("application").alias("type"), F.lit("document").alias("bom-ref"), "name")
    root = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.6").alias("specVersion"), F.concat(F.lit("urn:uuid:"), uuid).alias("serialNumber"), F.lit(1).alias("version"), F.struct(F.col("created").alias("timestamp"), main.alias("component")).alias("metadata"), "components", "dependencies")
    return d.select("doc_id", F.concat("doc_id", F.lit(".cdx.json")).alias("path"), F.to_json(root).cast("binary").alias("content"))


def spdx_yaml(ws: Workspace) -> DataFrame:
    """The JSON form's top-level keys as YAML lines, whose values are JSON (which YAML includes)."""
    d, lines = _spdx2(ws, "{}: ", "\n")
    return d.select("doc_id", F.concat("doc_id", F.lit(".spdx.yaml")).alias("path"), lines.cast("binary").alias("content"))


def spdx3(ws: Workspace) -> DataFrame:
    """SPDX 3 JSON-LD: one creation info, the document, an organization a supplier, packages and relationships."""
    iri = lambda c: F.when(c == "SPDXRef-DOCUMENT", F.col("namespace")).otherwise(F.concat("namespace", F.lit("#"), c))
    text = lambda v: F.lit(v)
    spaces = ws.document.select("doc_id", "namespace")
    sums = F.transform("checksums", lambda c: F.struct(F.lit("Hash").alias("type"), F.lower(c["algorithm"]).alias("algorithm"), c["value"].alias("hashValue")))
    package = F.to_json(_struct(
        type=text("software_Package"), spdxId=iri(F.col("spdx_id")), creationInfo=text("_:made"), name="name", software_packageVersion="version", software_packageUrl="purl", software_downloadLocation="download_location",
        software_primaryPurpose="purpose", suppliedBy=F.concat(F.lit("urn:org:"), "supplier"), verifiedUsing=sums,
    ))
    tie = F.to_json(_struct(
        type=text("Relationship"), spdxId=F.concat("namespace", F.lit("#rel-"), "rel_index"), creationInfo=text("_:made"), relationshipType=F.expr("concat(lower(substr(replace(initcap(replace(type, '_', ' ')), ' ', ''), 1, 1)), substr(replace(initcap(replace(type, '_', ' ')), ' ', ''), 2))"),
        to=F.array(iri(F.col("to_id"))), **{"from": iri(F.col("from_id"))},
    ))
    packages = _parts(_packages(ws).join(spaces, "doc_id"), package, "pos", "p")
    ties = _parts(ws.relationship.where("from_kind = 'local' and to_kind = 'local'").join(spaces, "doc_id"), tie, "rel_index", "r")
    owners = _packages(ws).where("supplier not in ('NOASSERTION', 'NONE')").select("doc_id", "supplier").distinct()
    owner = F.to_json(_struct(type=text("Organization"), spdxId=F.concat(F.lit("urn:org:"), "supplier"), creationInfo=text("_:made"), name="supplier"))
    d = ws.document.join(packages, "doc_id", "left").join(ties, "doc_id", "left").join(_parts(owners, owner, "supplier", "o"), "doc_id", "left")
    made = F.to_json(_struct(type=text("CreationInfo"), created="created", specVersion=text("3.0.1"), **{"@id": text("_:made")}))
    roots = F.transform("describes", lambda x: F.concat("namespace", F.lit("#"), x))
    head = F.to_json(_struct(type=text("SpdxDocument"), spdxId="namespace", creationInfo=text("_:made"), name="name", rootElement=roots))
    none = F.array().cast("array<string>")
    graph = F.array_join(F.concat(F.array(made, head), *(F.coalesce(c, none) for c in ("o", "p", "r"))), ",")
    content = F.concat(F.lit('{"@context":"https://spdx.org/rdf/3.0.1/spdx-context.jsonld","@graph":['), graph, F.lit("]}"))
    return d.select("doc_id", F.concat("doc_id", F.lit(".spdx3.json")).alias("path"), content.cast("binary").alias("content"))


def descriptor(ws: Workspace) -> DataFrame:
    """A component descriptor a document: its packages are resources, and resolved references to other documents component references."""
    digest = F.when(F.size("checksums") > 0, F.struct(F.get("checksums", F.lit(0))["algorithm"].alias("hashAlgorithm"), F.lit("genericBlobDigest/v1").alias("normalisationAlgorithm"), F.get("checksums", F.lit(0))["value"].alias("value")))
    image = F.struct(F.lit("ociArtifact").alias("type"), F.concat(F.lit("example.org/"), F.lower("spdx_id"), F.lit(":"), "version").alias("imageReference"))
    resource = _struct(name="name", version="version", type=F.lit("ociImage"), relation=F.lit("local"), access=image, digest=digest)
    ref = _struct(name="doc_ref", componentName=F.concat(F.lit("example.org/td/"), F.regexp_extract("uri", "([^:/]+)$", 1)), version=F.lit("1.0.0"))
    d = ws.document.join(_parts(_packages(ws), resource, "pos", "resources"), "doc_id", "left").join(_parts(ws.ext_ref, ref, "pos", "componentReferences"), "doc_id", "left")
    component = _struct(name=F.concat(F.lit("example.org/td/"), "doc_id"), version=F.lit("1.0.0"), provider="name", creationTime="created", resources="resources", componentReferences="componentReferences")
    root = F.struct(F.struct(F.lit("v2").alias("schemaVersion")).alias("meta"), component.alias("component"))
    return d.select("doc_id", F.concat("doc_id", F.lit(".cd.json")).alias("path"), F.to_json(root).cast("binary").alias("content"))


def archived(files: DataFrame) -> DataFrame:
    """Each file (path, content) as a gzipped tar that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                packed = gzip.compress(write_tar({path.as_py(): data.as_py()}), mtime=0)
                yield pa.RecordBatch.from_arrays([pa.array([f"{path.as_py()}.tgz"]), pa.array([packed], pa.binary())], ["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


def openvex(statements: DataFrame) -> DataFrame:
    """A file a document id (column vex_ord) of statements (cand_ord, vulnerability, status, ref, timestamp)."""
    statement = F.struct(F.struct(F.col("vulnerability").alias("name")).alias("vulnerability"), F.array(F.struct(F.col("ref").alias("@id"))).alias("products"), "status", "timestamp")
    rows = statements.groupBy("vex_ord").agg(F.array_sort(F.collect_list(F.struct("cand_ord", statement.alias("s")))).alias("s"))
    root = F.struct(F.lit("https://openvex.dev/ns/v0.2.0").alias("@context"), F.concat(F.lit("urn:vex:"), "vex_ord").alias("@id"), F.lit(1).alias("version"), F.transform("s", lambda x: x["s"]).alias("statements"))
    return rows.select(F.format_string("%08d.vex.json", "vex_ord").alias("path"), F.to_json(root).cast("binary").alias("content"))


def csaf(statements: DataFrame) -> DataFrame:
    """The same as CSAF advisories: a product a statement, named by its order; all of one release date."""
    buckets = {"affected": "known_affected", "not_affected": "known_not_affected", "fixed": "fixed", "under_investigation": "under_investigation"}
    own = F.col("cand_ord").cast("string")
    product = F.struct(own.alias("product_id"), F.col("ref").alias("name"), F.struct(F.col("ref").alias("purl")).alias("product_identification_helper"))
    listed = F.struct(*(F.when(F.col("status") == s, F.array(own)).alias(b) for s, b in buckets.items()))
    each = F.struct("cand_ord", product.alias("p"), F.struct(F.col("vulnerability").alias("cve"), listed.alias("product_status")).alias("v"))
    rows = statements.groupBy("vex_ord").agg(F.array_sort(F.collect_list(F.struct("cand_ord", each.alias("e")))).alias("s"))
    tracking = F.struct(F.concat(F.lit("advisory-"), "vex_ord").alias("id"), F.lit("1").alias("version"), F.lit("2024-01-01T00:00:00Z").alias("current_release_date"))
    head = F.struct(F.lit("2.0").alias("csaf_version"), F.struct(F.lit("td").alias("name")).alias("publisher"), tracking.alias("tracking"))
    root = F.struct(head.alias("document"), F.struct(F.transform("s", lambda x: x["e"]["p"]).alias("full_product_names")).alias("product_tree"), F.transform("s", lambda x: x["e"]["v"]).alias("vulnerabilities"))
    return rows.select(F.format_string("%08d.csaf.json", "vex_ord").alias("path"), F.to_json(root).cast("binary").alias("content"))
