"""Quality facts of documents, counted in one pass a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomweave.functions.identity import ABSENT, effective_license
from bomweave.model import Workspace


def dangling_ends(ws: Workspace) -> DataFrame:
    """(doc_id, rel_index, side, spdx_id): local ends without an element; the document itself is none."""
    ends = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_kind").alias("kind"), F.col(f"{s}_id").alias("spdx_id")) for s in ("from", "to"))))
    rows = ws.relationship.select("doc_id", "rel_index", ends.alias("e")).select("doc_id", "rel_index", "e.*").where("kind = 'local'")
    known = ws.element.select("doc_id", "spdx_id").unionByName(ws.document.select("doc_id", "spdx_id"))
    return rows.join(known, ["doc_id", "spdx_id"], "left_anti").select("doc_id", "rel_index", "side", "spdx_id")


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("doc_id").agg(F.count("*").alias(name))


def issues(ws: Workspace, resolved: DataFrame) -> DataFrame:
    """doc_id, dangling_local_refs, unresolved_structural_refs, duplicate_spdx_ids of every document."""
    repeated = ws.diagnostic.where("code = 'DUP_SPDXID'").groupBy("doc_id").agg(F.min_by("message", "seq").alias("m"))
    repeated = repeated.select("doc_id", F.coalesce(F.regexp_extract("m", r"^(\d+)", 1).try_cast("long"), F.lit(0)).alias("duplicate_spdx_ids"))
    out = ws.document.select("doc_id")
    for part in (_count(dangling_ends(ws), "dangling_local_refs"), _count(resolved.where("status = 'unresolved' and structural"), "unresolved_structural_refs"), repeated):
        out = out.join(part, "doc_id", "left")
    return out.na.fill(0)


def package_counts(ws: Workspace) -> DataFrame:
    """doc_id and counts of packages: in all, and with version, supplier, unique id, checksum and license."""
    some = lambda c: c.isNotNull() & (c != "")
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    facts = {
        "total": F.lit(True), "with_version": some(F.col("version")), "with_supplier": some(F.col("supplier")) & (F.col("supplier") != ABSENT[0]),
        "with_unique_id": some(F.col("purl")) | has("external_refs"), "with_checksum": has("checksums"),
        "with_license": effective_license(F.col("license_concluded"), F.col("license_declared")).isNotNull(),
    }
    return ws.element.where("kind = 'package'").groupBy("doc_id").agg(*(F.count_if(c).alias(n) for n, c in facts.items()))


def report(ws: Workspace, resolved: DataFrame) -> DataFrame:
    """Document facts, package counts and issues of every document."""
    related = ws.relationship.select("doc_id").distinct().withColumn("has_relationships", F.lit(True))
    facts = ws.document.select("doc_id", F.col("namespace").isNotNull().alias("has_namespace"), (F.coalesce("created", F.lit("")) != "").alias("has_created"), (F.coalesce(F.size("creators"), F.lit(0)) > 0).alias("has_creators"))
    joined = facts.join(related, "doc_id", "left").join(package_counts(ws), "doc_id", "left").join(issues(ws, resolved), "doc_id")
    return joined.na.fill(False, ["has_relationships"]).na.fill(0)


def workspace_stats(ws: Workspace, resolved: DataFrame) -> DataFrame:
    """One row: documents, packages, files, unresolved structural references and diagnostics by severity."""
    kinds = ws.element.agg(F.count_if(F.col("kind") == "package").alias("packages"), F.count_if(F.col("kind") == "file").alias("files"))
    notes = ws.diagnostic.agg(*(F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ("error", "warning", "info")))
    open_refs = resolved.agg(F.count_if((F.col("status") == "unresolved") & F.col("structural")).alias("unresolved"))
    return ws.document.agg(F.count("*").alias("documents")).join(kinds).join(open_refs).join(notes)  # one row each
