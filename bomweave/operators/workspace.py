"""Changes to a workspace: adding documents, removing them, binding references by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomweave.model import BINDING, TABLES, Workspace


def new_by_content(loaded: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of batch (sha1, ord) whose bytes are neither loaded nor earlier in the batch.

    What comes first is found by a minimum over two columns, so a frequent content isn't gathered with its rows.
    """
    first = batch.groupBy("sha1").agg(F.min("ord").alias("ord")).join(loaded.select("sha1"), "sha1", "left_anti")
    return batch.join(first, ["sha1", "ord"], "left_semi")


def renamed_ids(loaded: DataFrame, batch: DataFrame) -> DataFrame:
    """(old_id, ord, sha1, doc_id) of batch rows: an id that is taken gets the first 8 digits of the bytes' SHA-1."""
    taken = loaded.select("doc_id").withColumn("taken", F.lit(True)).distinct()
    first = batch.groupBy("doc_id").agg(F.min("ord").alias("first")).join(taken, "doc_id", "left")
    rows = batch.select("doc_id", "ord", "sha1").join(first, "doc_id").withColumn("again", F.coalesce("taken", F.lit(False)) | (F.col("ord") > F.col("first")))
    return rows.select(F.col("doc_id").alias("old_id"), "ord", "sha1", F.when(F.col("again"), F.concat("doc_id", F.lit("~dup-"), F.substring("sha1", 1, 8))).otherwise(F.col("doc_id")).alias("doc_id"), "again")


def add_documents(ws: Workspace, batch: Workspace) -> Workspace:
    """The workspace with the batch's new documents; tables of the batch are keyed by a doc_id of their own each.

    Documents equal to a loaded one by bytes are left out; one whose id is taken is renamed everywhere and gets a warning.
    Parsers key their rows by file, so ids that clash inside a batch are told apart by (doc_id, sha1) before this step.
    """
    fresh = new_by_content(ws.document, batch.document)
    names = renamed_ids(ws.document, fresh).withColumnRenamed("doc_id", "new_id")
    key = names.select(F.col("old_id").alias("doc_id"), "new_id", "again")
    tables = {}
    for name in TABLES:
        part = getattr(batch, name)
        if name == "document":
            part = fresh.join(names.select(F.col("old_id").alias("doc_id"), "ord", "new_id"), ["doc_id", "ord"])
        else:
            part = part.join(key.select("doc_id", "new_id").distinct(), "doc_id")
        part = part.withColumn("doc_id", F.col("new_id")).select(*TABLES[name].names)
        tables[name] = getattr(ws, name).unionByName(part)
    clash = key.where("again").select(F.col("new_id").alias("doc_id"), F.lit(1_000_000).cast("long").alias("seq"), F.lit("warning").alias("severity"), F.lit("DOC_NAMESPACE_COLLISION").alias("code"), F.concat(F.lit("another document has the id "), "doc_id").alias("message"), F.lit(None).cast("long").alias("line"))
    tables["diagnostic"] = tables["diagnostic"].unionByName(clash)
    return ws.with_tables(**tables)


def remove_documents(ws: Workspace, gone: DataFrame) -> Workspace:
    """The workspace without the documents of gone (doc_id), and without bindings from or to them."""
    gone = gone.select("doc_id").distinct()
    tables = {name: getattr(ws, name).join(gone, "doc_id", "left_anti") for name in TABLES}
    tables["binding"] = tables["binding"].join(gone.withColumnRenamed("doc_id", "target_doc_id"), "target_doc_id", "left_anti").select(*BINDING.names)
    return ws.with_tables(**tables)


def bind(ws: Workspace, doc_id: str, doc_ref: str, target_doc_id: str | None) -> Workspace:
    """The workspace with a reference bound by hand, or unbound where the target is None."""
    rest = ws.binding.where((F.col("doc_id") != doc_id) | (F.col("doc_ref") != doc_ref))
    if target_doc_id is None:
        return ws.with_tables(binding=rest)
    spark = ws.binding.sparkSession
    return ws.with_tables(binding=rest.unionByName(spark.createDataFrame([(doc_id, doc_ref, target_doc_id)], BINDING)))
