"""Packages in more than one version, and the difference between two cascades of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomweave.functions.identity import NO_VERSION, natural_key, package_key
from bomweave.model import Workspace


def keyed_packages(ws: Workspace) -> DataFrame:
    """Packages with their key and the order of their document."""
    docs = ws.document.select("doc_id", "ord")
    return ws.element.where("kind = 'package'").withColumn("key", package_key(F.col("name"), F.col("purl"), F.col("extra_identity"))).join(docs, "doc_id")


def version_counts(ws: Workspace) -> DataFrame:
    """(key, version, n, first): occurrences of each version of a package; first is the earliest one's (ord, pos, name)."""
    rows = keyed_packages(ws).select("key", F.coalesce("version", F.lit(NO_VERSION)).alias("version"), F.struct("ord", "pos", "name").alias("at"))
    return rows.groupBy("key", "version").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def version_conflicts(ws: Workspace) -> DataFrame:
    """(key, name, n_versions, total, versions): packages in several versions, named by their first occurrence.

    Two aggregations; occurrences shuffle as one row a version and task, so a package that is everywhere is no hot key.
    """
    groups = version_counts(ws).groupBy("key").agg(
        F.min("first").alias("first"), F.count("*").alias("n_versions"), F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct(natural_key(F.col("version")).alias("k"), "version"))).alias("v")
    )
    return groups.where("n_versions > 1").select("key", F.col("first.name").alias("name"), "n_versions", "total", F.transform("v", lambda x: x["version"]).alias("versions"))


def conflict_occurrences(ws: Workspace) -> DataFrame:
    """(key, version, doc_id, spdx_id) of every package in a conflict."""
    rows = keyed_packages(ws).withColumn("version", F.coalesce("version", F.lit(NO_VERSION)))
    return rows.join(version_conflicts(ws).select("key"), "key", "left_semi").select("key", "version", "doc_id", "spdx_id")


def cascade_side(ws: Workspace, documents: DataFrame) -> DataFrame:
    """(key, name, versions, digests, n) over the packages of documents (doc_id): sorted sets."""
    rows = keyed_packages(ws).join(documents.select("doc_id").distinct(), "doc_id", "left_semi")
    digests = F.transform(F.coalesce("checksums", F.array().cast("array<struct<algorithm:string,value:string>>")), lambda c: F.concat(c["algorithm"], F.lit(":"), c["value"]))
    each = rows.select("key", F.coalesce("version", F.lit(NO_VERSION)).alias("version"), digests.alias("digests"), F.struct("ord", "pos", "name").alias("at"))
    return each.groupBy("key").agg(F.min("at")["name"].alias("name"), F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("digests")))).alias("digests"), F.count("*").alias("n"))


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, name, change, reasons, left and right versions): added, removed, changed or unchanged between two sides.

    Versions change if their sets differ; digests only if both sides have any and the sets differ.
    """
    a, b = (s.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("name", "versions", "digests", "n"))) for s, side in ((left, "left"), (right, "right")))
    both = a.join(b, "key", "full_outer")
    version = F.col("left_versions") != F.col("right_versions")
    digest = (F.size("left_digests") > 0) & (F.size("right_digests") > 0) & (F.col("left_digests") != F.col("right_digests"))
    reasons = F.array_compact(F.array(F.when(version, "version"), F.when(digest, "digest")))
    change = F.when(F.col("left_n").isNull(), "added").when(F.col("right_n").isNull(), "removed").when(version | digest, "changed").otherwise("unchanged")
    return both.select("key", F.coalesce("left_name", "right_name").alias("name"), change.alias("change"), F.when(change == "changed", reasons).alias("reasons"), "left_versions", "right_versions")


def diff_summary(entries: DataFrame) -> DataFrame:
    return entries.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed", "unchanged")))


def diff_markdown(entries: DataFrame, left: str, right: str) -> str:
    """A report of the changes, for results that fit the driver."""
    rows = entries.where("change <> 'unchanged'").orderBy(F.collate("name", "UNICODE_CI_AI"), "key").collect()
    counts = diff_summary(entries).first().asDict()
    text = [f"# Cascade diff: {left} → {right}", "", ", ".join(f"{n} {c}" for c, n in counts.items()), ""]
    for change in ("added", "removed", "changed"):
        part = [r for r in rows if r.change == change]
        if part:
            text += [f"## {change.capitalize()} ({len(part)})", ""]
        for r in part:
            versions = lambda v: ", ".join(v or [])
            if change != "changed":
                text.append(f"- {r.name} {versions(r.right_versions or r.left_versions)}")
            elif r.reasons == ["digest"]:
                text.append(f"- {r.name} {versions(r.left_versions)}: same version, other digest")
            else:
                text.append(f"- {r.name} {versions(r.left_versions)} → {versions(r.right_versions)}")
        text += [""] * bool(part)
    return "\n".join(text)
