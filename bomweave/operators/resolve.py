"""Which loaded document does a reference to another document mean?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomweave.model import Workspace


def used_refs(ws: Workspace) -> DataFrame:
    """(doc_id, doc_ref): references that a relationship's end uses."""
    r = ws.relationship
    ends = F.explode(F.array(F.struct(F.col("from_kind").alias("kind"), F.col("from_ref").alias("ref")), F.struct(F.col("to_kind").alias("kind"), F.col("to_ref").alias("ref"))))
    return r.select("doc_id", ends.alias("e")).where("e.kind = 'external'").select("doc_id", F.col("e.ref").alias("doc_ref")).distinct()


def declared_refs(ws: Workspace) -> DataFrame:
    """Declared references, the first of each name in a document."""
    first = Window.partitionBy("doc_id", "doc_ref").orderBy("pos")
    return ws.ext_ref.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def informational_refs(ws: Workspace) -> DataFrame:
    """Declared references that no relationship uses."""
    return ws.ext_ref.join(used_refs(ws), ["doc_id", "doc_ref"], "left_anti")


def resolutions(ws: Workspace) -> DataFrame:
    """One row a declared reference: doc_id, pos, doc_ref, uri, status, target_doc_id, method, structural.

    A SHA-1 checksum that is a loaded file's comes first, then a uri that is a loaded document's namespace (the first in order
    of several), then a binding by hand. Three equi-joins; a reference that a join resolves keeps its earlier answer.
    """
    first = lambda df, key: df.groupBy(key).agg(F.min_by("doc_id", "ord").alias("target"))
    by_sha1 = first(ws.document.where("sha1 is not null").withColumn("_sha1", F.lower("sha1")), "_sha1").withColumnRenamed("target", "_t1")
    by_name = first(ws.document.where("namespace is not null").withColumnRenamed("namespace", "_ns"), "_ns").withColumnRenamed("target", "_t2")
    bound = ws.binding.join(ws.document.select(F.col("doc_id").alias("target_doc_id")), "target_doc_id", "left_semi").select("doc_id", "doc_ref", F.col("target_doc_id").alias("_t3"))
    refs = declared_refs(ws).withColumn("_sha1", F.when(F.upper("checksum_alg") == "SHA1", F.lower("checksum_value")))
    used = used_refs(ws).withColumn("_used", F.lit(True))
    joined = refs.join(by_sha1, "_sha1", "left").join(by_name, refs.uri == by_name._ns, "left").join(bound, ["doc_id", "doc_ref"], "left").join(used, ["doc_id", "doc_ref"], "left")
    target = F.coalesce("_t1", "_t2", "_t3")
    method = F.when(F.col("_t1").isNotNull(), "checksum").when(F.col("_t2").isNotNull(), "namespace").when(F.col("_t3").isNotNull(), "manual")
    return joined.select(
        "doc_id", "pos", "doc_ref", "uri", F.when(target.isNotNull(), "resolved").otherwise("unresolved").alias("status"), target.alias("target_doc_id"), method.alias("method"),
        F.coalesce("_used", F.lit(False)).alias("structural"),
    )


def suggestions(ws: Workspace, resolved: DataFrame) -> DataFrame:
    """(doc_id, doc_ref, suggestion_doc_id, reason) for unresolved structural references whose words another document's name has.

    Words of the reference (without its trailing version) are joined to the words of names: a relational division, so only
    documents that share a word meet. Nothing is bound by it.
    """
    tokens = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), ""))
    bare = F.regexp_replace(F.regexp_replace("doc_ref", "^DocumentRef-", ""), r"[-_ ]v?\d[\w.]*$", "")
    wanted = resolved.where("status = 'unresolved' and structural").select("doc_id", "doc_ref", tokens(bare).alias("words")).where(F.size("words") > 0)
    names = ws.document.select(F.col("doc_id").alias("other"), "ord", "name", F.explode(tokens(F.col("name"))).alias("word"))
    each = wanted.select("doc_id", "doc_ref", F.size("words").alias("n"), F.explode("words").alias("word"))
    hits = each.join(names, "word").where("doc_id <> other").groupBy("doc_id", "doc_ref", "n", "other", "ord", "name").count().where("count = n")
    best = hits.groupBy("doc_id", "doc_ref").agg(F.min_by(F.struct("other", "name"), "ord").alias("s"))
    return best.select("doc_id", "doc_ref", F.col("s.other").alias("suggestion_doc_id"), F.concat(F.lit("looks like "), "s.name").alias("reason"))


def document_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, method): resolved references between different documents; the first by position names the method."""
    rows = resolved.where("status = 'resolved' and doc_id <> target_doc_id")
    return rows.groupBy(F.col("doc_id").alias("src"), F.col("target_doc_id").alias("dst")).agg(F.min_by("method", "pos").alias("method"))
