"""Ranked search, facets, the inventory and its exports."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomweave.functions.identity import effective_license, natural_key
from bomweave.model import Workspace
from bomweave.operators.order import numbered
from bomweave.storage import materialize

MAX_HITS = 500
#: So many documents at most are held by every task of a join, some tens of MB of ids and names.
FEW_DOCUMENTS = 250_000
CSV_COLUMNS = ["name", "version", "license", "supplier", "purpose", "purl", "spdx_id", "kind", "doc_name"]
CSV_HEADER = ["name", "version", "license", "supplier", "purpose", "purl", "spdxId", "kind", "document"]


def inventory(ws: Workspace) -> DataFrame:
    """Elements with their document's name and order, and their effective license."""
    docs = ws.document.select("doc_id", "ord", F.col("name").alias("doc_name"))
    return ws.element.join(docs, "doc_id").withColumn("license", effective_license(F.col("license_concluded"), F.col("license_declared")))


def few_documents(ws: Workspace) -> Workspace:
    """ws for an inventory: its documents, where they are few, go to every task, so that elements aren't dealt out to meet names."""
    few = ws.document.select("doc_id").limit(FEW_DOCUMENTS + 1).count() <= FEW_DOCUMENTS
    return ws.with_tables(document=F.broadcast(ws.document)) if few else ws


def search_blob(name: Column, version: Column, purl: Column, spdx_id: Column) -> Column:
    blank = F.lit("")
    return F.lower(F.concat(F.coalesce(name, blank), F.lit(" "), F.coalesce(version, blank), F.lit(" "), F.coalesce(purl, blank), F.lit(" "), F.coalesce(spdx_id, blank)))


def score(query: str, name: Column, blob: Column) -> Column:
    """How well a lower-case name or blob matches a lower-case query: decimal(10, 3), 0 for not at all."""
    spread = ".*".join(f"\\Q{c}\\E" if c != "\\" else "\\\\" for c in query)
    base = (
        F.when(name == query, 1000).when(name.startswith(query), 800).when(F.contains(name, F.lit(query)), 600).when(F.contains(blob, F.lit(query)), 400)
        .when(F.lit(len(query) >= 3) & name.rlike(f"(?s){spread}"), 100).otherwise(0)
    )
    return F.when(base > 0, base.cast("decimal(10,3)") - (F.least(F.length(name), F.lit(200)).cast("decimal(10,3)") / 1000).cast("decimal(10,3)")).otherwise(0).cast("decimal(10,3)")


def facets(rows: DataFrame, documents: Iterable[str] | None = None, kinds: Iterable[str] | None = None, purposes: Iterable[str] | None = None, licenses: Iterable[str] | None = None) -> DataFrame:
    """Rows in the chosen sets; None leaves a facet out. They stand below the scoring, so they reach the scan."""
    for column, chosen in (("doc_id", documents), ("kind", kinds), ("purpose", purposes), ("license", licenses)):
        if chosen is not None:
            rows = rows.where(F.col(column).isin(*chosen))
    return rows


def search(ws: Workspace, query: str, limit: int | None = MAX_HITS, **chosen: Iterable[str] | None) -> DataFrame:
    """Inventory rows that match, with score and total (hits before the limit), best first; an empty query keeps document order.

    With a limit, hits are scored once and written; their number and the best of them are taken from that table.
    """
    rows, query = facets(inventory(ws), **chosen), query.strip().lower()
    if not query:
        found = rows.withColumn("score", F.lit(0).cast("decimal(10,3)"))
    else:
        blob = search_blob(F.col("name"), F.col("version"), F.col("purl"), F.col("spdx_id"))
        found = rows.withColumn("score", score(query, F.lower("name"), blob)).where("score > 0")
    if limit is None:
        return found
    hits = materialize(found, "hits")
    return hits.orderBy(F.desc("score"), "ord", "pos").limit(limit).withColumn("total", F.lit(hits.count()).cast("long"))


def view(ws: Workspace, query: str = "", within: DataFrame | None = None, **chosen: Iterable[str] | None) -> DataFrame:
    """The inventory as it is shown: packages alone unless kinds are chosen, and of the elements of within (doc_id, spdx_id) if given."""
    kinds = chosen.pop("kinds", None) or ["package"]
    rows = search(ws, query, limit=None, kinds=kinds, **chosen)
    return rows if within is None else rows.join(within.select("doc_id", "spdx_id").distinct(), ["doc_id", "spdx_id"], "left_semi")


def facet_counts(ws: Workspace, facet: str) -> DataFrame:
    """(value, n) over documents: purposes of all elements, or effective licenses of packages."""
    rows = inventory(ws)
    if facet == "license":
        rows = rows.where("kind <> 'file'")
    return rows.where(F.col(facet).isNotNull() & (F.col(facet) != "")).groupBy(F.col(facet).alias("value")).agg(F.count("*").alias("n"))


def top_facet(ws: Workspace, facet: str, n: int = 6) -> DataFrame:
    return facet_counts(ws, facet).orderBy(F.desc("n"), "value").limit(n)


def _sort_key(key: str, descending: bool) -> Column:
    c = F.coalesce("doc_name" if key == "document" else key, F.lit(""))
    value = natural_key(c) if key == "version" else F.collate(c, "UNICODE_CI_AI")
    return value.desc() if descending else value.asc()


def sort_inventory(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """By one column without regard to case and accents; versions by their numbers; ties in document order."""
    return rows.orderBy(_sort_key(key, descending), "ord", "pos")


def placed(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Every row with its place (from 1) in that order, for inventories of any size."""
    return numbered(rows, _sort_key(key, descending), "ord", "pos").withColumn("place", F.col("place") + 1)


def escape_csv(c: Column) -> Column:
    return F.when(c.rlike('[",\\n\\r;]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_lines(rows: DataFrame, with_vex: bool = False) -> DataFrame:
    """The line of each row, without its end; with_vex adds the columns vex_status and vex_vulnerabilities."""
    columns = CSV_COLUMNS + (["vex_status", "vex_vulnerabilities"] if with_vex else [])
    blank = F.lit("")
    return rows.withColumn("line", F.concat_ws(",", *(escape_csv(F.coalesce(F.col(c), blank)) for c in columns)))


def to_csv(rows: DataFrame, with_vex: bool = False) -> str:
    """The whole export as a text, for results that fit the driver; write csv_lines() for others."""
    header = ",".join(CSV_HEADER + (["vex_status", "vex_vulnerabilities"] if with_vex else []))
    return "".join(f"{line}\r\n" for line in [header, *(r.line for r in csv_lines(rows, with_vex).collect())])


def json_rows(rows: DataFrame) -> DataFrame:
    """rows with `json`, the object of each: absent values are left out.

    Rows overlaid with statements (vex_status, vex_findings) have vexStatus and vexFindings where something is stated.
    """
    names = dict(zip([*CSV_COLUMNS, "doc_id"], [*CSV_HEADER, "documentId"], strict=True))
    own = [F.col(c).alias(n) for c, n in names.items()]
    if "vex_findings" in rows.columns:
        stated = F.size("vex_findings") > 0
        own += [F.when(stated, F.col("vex_status")).alias("vexStatus"), F.when(stated, F.transform("vex_findings", lambda f: F.struct(f["vulnerability"].alias("vulnerability"), f["status"].alias("status")))).alias("vexFindings")]
    return rows.withColumn("json", F.to_json(F.struct(*own)))


def to_json(rows: DataFrame) -> str:
    """The same as a JSON array with a line end, for results that fit the driver; write json_rows() for others."""
    return json.dumps([json.loads(r.json) for r in json_rows(rows).collect()], indent=2, ensure_ascii=False) + "\n"


def write_csv(rows: DataFrame, path: str, with_vex: bool = False) -> None:
    """The export as files of lines (CRLF ends), written by the executors; each file is without the header."""
    csv_lines(rows, with_vex).select(F.col("line").alias("value")).write.option("lineSep", "\r\n").text(path)
