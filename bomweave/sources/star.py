"""A workspace over the star-schema test tables: every operator runs on it as it would on parsed documents.

Regions, nations and suppliers are documents; a supplier's parts are its packages; texts are delivered files; events are
vulnerability statements. SQL_VIEWS says the same in SQL that does not use this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomweave.model import BINDING, DIAGNOSTIC, Workspace
from bomweave.operators.search import FEW_DOCUMENTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(value: str | None = None) -> F.Column:
    return F.lit(value).cast("string")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (supplier, part) that lineitem has: the part's columns, its package URL and external references, and the greatest return flag.

    Lines are dealt out once, by part: a pair is found where it meets its part. What a part alone says is made once a part.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag").repartition("l_partkey")
    pairs = lines.groupBy("l_suppkey", "l_partkey").agg(F.max("l_returnflag").alias("flag"))
    purl = F.concat(F.lit("pkg:generic/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("@"), F.col("p_size").cast("string"))
    refs = F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("category"), F.lit("purl").alias("type"), F.col("p_purl").alias("locator")))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.when(F.col("p_partkey") % 10 != 0, purl).alias("p_purl"))
    part = part.withColumn("p_refs", F.when(F.col("p_partkey") % 10 != 0, refs))
    return pairs.join(part, pairs.l_partkey == part.p_partkey).drop("p_partkey")


def _owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers; where they are few, they go to every task, so that packages aren't dealt out to meet them."""
    owner = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return F.broadcast(owner) if owner.limit(FEW_DOCUMENTS + 1).count() <= FEW_DOCUMENTS else owner


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("doc_id"), F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("k"), F.lit(None).cast("long").alias("first"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("doc_id"), (F.col("n_nationkey") + 1000).cast("long").alias("ord"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("k"), F.lit(None).cast("long").alias("first"))
    least = table(spark, sf_dir, "lineitem").where("l_suppkey % 2 = 1").groupBy("l_suppkey").agg(F.min("l_partkey").alias("first"))
    supplier = table(spark, sf_dir, "supplier").join(least, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.concat(F.lit("s"), "s_suppkey").alias("doc_id"), (F.col("s_suppkey") + 1_000_000).alias("ord"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"), "first"
    )
    every = region.unionByName(nation).unionByName(supplier)
    namespace = F.concat(F.lit("urn:td:"), "doc_id")
    tool, owner = F.lit("Tool: gen-1"), F.concat(F.lit("Organization: "), "name")
    creators = F.when(F.col("ord") % 3 == 0, F.array().cast("array<string>")).when(F.col("ord") % 3 == 1, F.array(tool)).otherwise(F.array(owner, tool))
    return every.select(
        "doc_id", "ord", F.lit("spdx-2").alias("model"), F.lit("SPDX-2.3").alias("version"), F.lit("json").alias("serialization"), F.lit("SPDXRef-DOCUMENT").alias("spdx_id"), "name",
        namespace.alias("namespace"), F.when(F.col("ord") % 11 != 0, F.concat(F.lit("2024-0"), (F.col("ord") % 9 + 1).cast("string"), F.lit("-15T00:00:00Z"))).alias("created"), creators.alias("creators"),
        _text().alias("comment"), F.when(F.col("ord") % 5 == 0, None).when(F.col("ord") % 7 == 0, "MIT").otherwise("CC0-1.0").alias("data_license"),
        F.when(F.col("first").isNotNull(), F.array(F.concat(F.lit("P"), "first"))).otherwise(F.array().cast("array<string>")).alias("describes"), F.sha1(namespace).alias("sha1"), F.concat("doc_id", F.lit(".spdx.json")).alias("file_name"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, size, key = F.col("p_name"), F.col("p_size").cast("string"), F.col("l_partkey")
    rows = packages(spark, sf_dir).join(_owners(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
    digest = F.concat(F.lit("d"), key.cast("string"), F.lit("-"), (F.col("l_suppkey") % 2).cast("string"))
    checksum = lambda alg, c: F.array(F.struct(F.lit(alg).alias("algorithm"), c.alias("value")))
    return rows.select(
        F.concat(F.lit("s"), "l_suppkey").alias("doc_id"), key.alias("pos"), F.concat(F.lit("P"), key).alias("spdx_id"), F.lit("package").alias("kind"), name.alias("name"), size.alias("version"), F.col("p_purl").alias("purl"),
        F.when(key % 6 == 0, "NOASSERTION").when(key % 6 == 1, "NONE").otherwise(F.col("s_name")).alias("supplier"), F.when(key % 3 == 1, F.concat(F.lit("Organization: "), "p_brand")).alias("originator"),
        F.when(key % 5 == 0, "NOASSERTION").otherwise(F.concat(F.lit("https://example.org/"), key.cast("string"))).alias("download_location"),
        F.when(F.col("flag") == "A", "Apache-2.0").when(F.col("flag") == "R", "MIT").otherwise("NOASSERTION").alias("license_concluded"), F.when(key % 4 == 0, "BSD-3-Clause").alias("license_declared"),
        _text().alias("copyright"), F.col("p_type").alias("purpose"), _text().alias("description"), _text().alias("comment"),
        F.when(key % 3 == 0, checksum("SHA256", F.sha2(digest, 256))).when(key % 3 == 1, checksum("SHA1", F.sha1(digest))).alias("checksums"), F.col("p_refs").alias("external_refs"),
        F.lit(None).cast("map<string,string>").alias("extra_identity"),
    )


def file_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as file elements of one document each source, with two checksums; every 13th has none, every 17th an odd one."""
    d, checksum = table(spark, sf_dir, "documents"), lambda alg, c: F.struct(F.lit(alg).alias("algorithm"), c.alias("value"))
    text, key = F.coalesce("text", F.lit("")), F.col("doc_id")
    sums = F.when(key % 13 == 0, F.lit(None)).when(key % 17 == 0, F.array(checksum("BLAKE3", F.md5(text)))).otherwise(F.array(checksum("SHA1", F.sha1(text)), checksum("sha-256", F.sha2(text, 256))))
    return d.select(F.concat(F.lit("f-"), "source").alias("doc_id"), key.alias("pos"), F.concat(F.lit("F"), key).alias("spdx_id"), F.lit("file").alias("kind"), F.concat(F.lit("./texts/"), key.cast("string"), F.lit(".txt")).alias("name"), sums.alias("checksums"))


def delivered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery of these texts: every 10th altered, every 11th missing, every 25th also under a path that nobody declares."""
    d, key = table(spark, sf_dir, "documents"), F.col("doc_id")
    text = F.when(key % 10 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.coalesce("text", F.lit("")))
    digests = F.create_map(F.lit("SHA256"), F.sha2(text, 256), F.lit("SHA1"), F.sha1(text))
    row = lambda path: d.select(path.alias("path"), F.octet_length(text).cast("long").alias("size"), digests.alias("digests"), key.alias("ord"))
    known = row(F.concat(F.lit("texts\\"), key.cast("string"), F.lit(".txt"))).where("ord % 11 <> 4")
    return known.unionByName(row(F.concat(F.lit("/extra/"), key.cast("string"), F.lit(".txt"))).where("ord % 25 = 0"))


def ext_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = _text()
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("doc_id"), F.col("n_nationkey").cast("long").alias("pos"), F.concat(F.lit("DocumentRef-n"), "n_nationkey").alias("doc_ref"), F.concat(F.lit("urn:td:n"), "n_nationkey").alias("uri"), none.alias("checksum_alg"), none.alias("checksum_value"))
    s = table(spark, sf_dir, "supplier")
    good = F.sha1(F.concat(F.lit("urn:td:s"), "s_suppkey"))
    supplier = s.select(
        F.concat(F.lit("n"), "s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("DocumentRef-s"), "s_suppkey").alias("doc_ref"), F.concat(F.lit("https://example.org/s"), "s_suppkey", F.lit(".spdx.json")).alias("uri"),
        F.lit("SHA1").alias("checksum_alg"), F.when(F.col("s_suppkey") % 7 == 3, F.sha1(F.concat(F.lit("bad"), "s_suppkey"))).otherwise(good).alias("checksum_value"),
    )
    scan = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("doc_id"), F.lit(1_000_000_000).cast("long").alias("pos"), F.concat(F.lit("DocumentRef-scan-"), "n_nationkey").alias("doc_ref"), F.concat(F.lit("https://example.org/scan/"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, ".json").otherwise(".pdf")).alias("uri"), none.alias("checksum_alg"), none.alias("checksum_value"))
    named = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 2_000_000_000).cast("long").alias("pos"), _named_ref().alias("doc_ref"), F.concat(F.lit("https://example.org/names/"), "n_nationkey", F.lit(".rdf")).alias("uri"), none.alias("checksum_alg"), none.alias("checksum_value"))
    return nation.unionByName(supplier).unionByName(scan).unionByName(named)


def _named_ref() -> F.Column:
    """A reference that nothing resolves, whose words are those of a nation's document."""
    return F.concat(F.lit("DocumentRef-"), F.replace("n_name", F.lit(" "), F.lit("-")), F.lit("-2.0"))


def bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other corrupted supplier reference is bound by hand."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 14 = 3")
    return s.select(F.concat(F.lit("n"), "s_nationkey").alias("doc_id"), F.concat(F.lit("DocumentRef-s"), "s_suppkey").alias("doc_ref"), F.concat(F.lit("s"), "s_suppkey").alias("target_doc_id")).to(BINDING)


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = _text()
    ends = ["from_kind", "from_ref", "from_id", "to_kind", "to_ref", "to_id"]
    root = lambda df, doc, ref, index: df.select(doc.alias("doc_id"), index.cast("long").alias("rel_index"), F.lit("DESCRIBES").alias("type"), F.lit("local").alias("from_kind"), none.alias("from_ref"), F.lit("SPDXRef-DOCUMENT").alias("from_id"), F.lit("external").alias("to_kind"), ref.alias("to_ref"), none.alias("to_id"))
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    upper = root(nation, F.concat(F.lit("r"), "n_regionkey"), F.concat(F.lit("DocumentRef-n"), "n_nationkey"), F.col("n_nationkey"))
    lower = root(supplier, F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("DocumentRef-s"), "s_suppkey"), F.col("s_suppkey"))
    odd = nation.where("n_nationkey % 2 = 1").select(F.concat(F.lit("r"), "n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 1000).cast("long").alias("rel_index"), F.lit("DEPENDS_ON").alias("type"), F.lit("local").alias("from_kind"), none.alias("from_ref"), F.lit("SPDXRef-DOCUMENT").alias("from_id"), F.lit("external").alias("to_kind"), _named_ref().alias("to_ref"), none.alias("to_id"))
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    key, parent = F.col("l_partkey"), F.floor(F.col("l_partkey") / 10).cast("long")
    child_id, parent_id = F.concat(F.lit("P"), key.cast("string")), F.concat(F.lit("P"), parent.cast("string"))
    down = key % 4
    kind = F.when(down == 0, "CONTAINS").when(down == 1, "DEPENDENCY_OF").when(down == 2, "DEPENDS_ON").otherwise("CONTAINED_BY")
    first, second = F.when(down.isin(0, 2), parent_id).otherwise(child_id), F.when(down.isin(0, 2), child_id).otherwise(parent_id)
    doc = F.concat(F.lit("s"), "l_suppkey").alias("doc_id")
    inner = pairs.select(doc, (key * 10).alias("rel_index"), kind.alias("type"), F.lit("local").alias("from_kind"), none.alias("from_ref"), first.alias("from_id"), F.lit("local").alias("to_kind"), none.alias("to_ref"), second.alias("to_id"))
    special = pairs.where("l_partkey % 50 = 0").select(doc, (key * 10 + 1).alias("rel_index"), F.lit("DEPENDS_ON").alias("type"), F.lit("local").alias("from_kind"), none.alias("from_ref"), child_id.alias("from_id"), F.lit("special").alias("to_kind"), none.alias("to_ref"), F.lit("NOASSERTION").alias("to_id"))
    unknown = pairs.where("l_partkey % 97 = 0").select(doc, (key * 10 + 2).alias("rel_index"), F.lit("DEPENDS_ON").alias("type"), F.lit("local").alias("from_kind"), none.alias("from_ref"), child_id.alias("from_id"), F.lit("external").alias("to_kind"), F.lit("DocumentRef-unknown").alias("to_ref"), F.lit("X").alias("to_id"))
    every = upper.unionByName(lower).unionByName(odd).unionByName(inner).unionByName(special).unionByName(unknown)
    return every.select("doc_id", "rel_index", "type", *ends, none.alias("comment"))


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    return Workspace(documents(spark, sf_dir), elements(spark, sf_dir), relationships(spark, sf_dir), ext_refs(spark, sf_dir), spark.createDataFrame([], DIAGNOSTIC), bindings(spark, sf_dir))


def vex_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as statements: (vex_ord, cand_ord, vulnerability, status, ref, timestamp); clicks have a status of no meaning."""
    e = table(spark, sf_dir, "events")
    part = table(spark, sf_dir, "part")
    product = F.concat(F.lit("pkg:generic/"), F.replace(F.col("p_brand"), F.lit("#"), F.lit("-")), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("@"), F.col("p_size").cast("string"))).otherwise(""))
    status = F.when(F.col("event_type") == "error", "affected").when(F.col("event_type") == "signup", "under_investigation").when(F.col("event_type") == "purchase", "fixed").when(F.col("event_type") == "view", "not_affected")
    rows = e.join(part, e.user_id == part.p_partkey).where("event_type <> 'click'")
    return rows.select(
        (F.col("event_id") % 5).alias("vex_ord"), F.col("event_id").alias("cand_ord"), F.concat(F.lit("CVE-2024-"), (F.col("event_id") % 40).cast("string")).alias("vulnerability"), status.alias("status"), product.alias("ref"),
        F.when(F.col("event_id") % 19 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("no date").alias("timestamp"),
    )


#: The same projection in SQL, one view a table.
SQL_VIEWS = {
    "pk": """SELECT l_suppkey AS s, l_partkey AS p, max(l_returnflag) AS flag FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "document": """SELECT *, 'urn:td:' || doc_id AS namespace, sha1('urn:td:' || doc_id) AS sha1, CASE WHEN ord % 11 <> 0 THEN '2024-0' || (ord % 9 + 1) || '-15T00:00:00Z' END AS created,
 CASE ord % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['Tool: gen-1'] ELSE ['Organization: ' || name, 'Tool: gen-1'] END AS creators, CASE WHEN ord % 5 = 0 THEN NULL WHEN ord % 7 = 0 THEN 'MIT' ELSE 'CC0-1.0' END AS data_license FROM (
 SELECT 'r' || r_regionkey AS doc_id, r_regionkey::BIGINT AS ord, r_name AS name, NULL::VARCHAR AS root FROM region UNION ALL
 SELECT 'n' || n_nationkey, n_nationkey + 1000, n_name, NULL FROM nation UNION ALL
 SELECT 's' || s_suppkey, s_suppkey + 1000000, s_name, (SELECT 'P' || min(l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey AND s_suppkey % 2 = 1) FROM supplier)""",
    "element": """SELECT 's' || s AS doc_id, p AS pos, 'P' || p AS spdx_id, p_name AS name, p_size::VARCHAR AS version, CASE WHEN p % 10 <> 0 THEN 'pkg:generic/' || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-') || '@' || p_size END AS purl,
 CASE p % 6 WHEN 0 THEN 'NOASSERTION' WHEN 1 THEN 'NONE' ELSE s_name END AS supplier, CASE WHEN p % 3 = 1 THEN 'Organization: ' || p_brand END AS originator,
 CASE WHEN p % 5 = 0 THEN 'NOASSERTION' ELSE 'https://example.org/' || p END AS download_location, CASE flag WHEN 'A' THEN 'Apache-2.0' WHEN 'R' THEN 'MIT' ELSE 'NOASSERTION' END AS license_concluded,
 CASE WHEN p % 4 = 0 THEN 'BSD-3-Clause' END AS license_declared, CASE WHEN flag IN ('A', 'R') THEN CASE flag WHEN 'A' THEN 'Apache-2.0' ELSE 'MIT' END WHEN p % 4 = 0 THEN 'BSD-3-Clause' END AS license, p_type AS purpose,
 CASE p % 3 WHEN 0 THEN 'SHA256' WHEN 1 THEN 'SHA1' END AS alg, CASE p % 3 WHEN 0 THEN sha256('d' || p || '-' || s % 2) WHEN 1 THEN sha1('d' || p || '-' || s % 2) END AS digest, s AS suppkey,
 CASE WHEN p % 10 <> 0 THEN 'purl:pkg:generic/' || replace(p_brand, '#', '-') || '/' || replace(p_name, ' ', '-') ELSE 'name:' || lower(p_name) END AS key FROM pk JOIN part ON p = p_partkey JOIN supplier ON s = s_suppkey""",
    "ext_ref": """SELECT 'r' || n_regionkey AS doc_id, n_nationkey::BIGINT AS pos, 'DocumentRef-n' || n_nationkey AS doc_ref, 'urn:td:n' || n_nationkey AS uri, NULL::VARCHAR AS sum FROM nation UNION ALL
 SELECT 'n' || s_nationkey, s_suppkey, 'DocumentRef-s' || s_suppkey, 'https://example.org/s' || s_suppkey || '.spdx.json', CASE WHEN s_suppkey % 7 = 3 THEN sha1('bad' || s_suppkey) ELSE sha1('urn:td:s' || s_suppkey) END FROM supplier UNION ALL
 SELECT 'n' || n_nationkey, 1000000000, 'DocumentRef-scan-' || n_nationkey, 'https://example.org/scan/' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.json' ELSE '.pdf' END, NULL FROM nation UNION ALL
 SELECT 'r' || n_regionkey, 2000000000 + n_nationkey, 'DocumentRef-' || replace(n_name, ' ', '-') || '-2.0', 'https://example.org/names/' || n_nationkey || '.rdf', NULL FROM nation""",
    "relationship": """SELECT 'r' || n_regionkey AS doc_id, n_nationkey::BIGINT AS rel_index, 'DESCRIBES' AS type, 'local' AS from_kind, 'SPDXRef-DOCUMENT' AS from_id, 'external' AS to_kind, 'DocumentRef-n' || n_nationkey AS to_ref, NULL::VARCHAR AS to_id FROM nation UNION ALL
 SELECT 'n' || s_nationkey, s_suppkey, 'DESCRIBES', 'local', 'SPDXRef-DOCUMENT', 'external', 'DocumentRef-s' || s_suppkey, NULL FROM supplier UNION ALL
 SELECT 'r' || n_regionkey, 1000 + n_nationkey, 'DEPENDS_ON', 'local', 'SPDXRef-DOCUMENT', 'external', 'DocumentRef-' || replace(n_name, ' ', '-') || '-2.0', NULL FROM nation WHERE n_nationkey % 2 = 1 UNION ALL
 SELECT 's' || s, p * 10, CASE p % 4 WHEN 0 THEN 'CONTAINS' WHEN 1 THEN 'DEPENDENCY_OF' WHEN 2 THEN 'DEPENDS_ON' ELSE 'CONTAINED_BY' END, 'local', 'P' || CASE WHEN p % 2 = 0 THEN p // 10 ELSE p END, 'local', NULL, 'P' || CASE WHEN p % 2 = 0 THEN p ELSE p // 10 END FROM pk UNION ALL
 SELECT 's' || s, p * 10 + 1, 'DEPENDS_ON', 'local', 'P' || p, 'special', NULL, 'NOASSERTION' FROM pk WHERE p % 50 = 0 UNION ALL
 SELECT 's' || s, p * 10 + 2, 'DEPENDS_ON', 'local', 'P' || p, 'external', 'DocumentRef-unknown', 'X' FROM pk WHERE p % 97 = 0""",
    "binding": """SELECT 'n' || s_nationkey AS doc_id, 'DocumentRef-s' || s_suppkey AS doc_ref, 's' || s_suppkey AS target FROM supplier WHERE s_suppkey % 14 = 3""",
    "candidate": """SELECT event_id AS ord, 'CVE-2024-' || event_id % 40 AS vulnerability, CASE event_type WHEN 'error' THEN 'affected' WHEN 'signup' THEN 'under_investigation' WHEN 'purchase' THEN 'fixed' ELSE 'not_affected' END AS status,
 'generic/' || lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-') AS id, CASE WHEN event_id % 3 <> 0 THEN p_size::VARCHAR END AS version, CASE WHEN event_id % 19 <> 0 THEN date_trunc('second', ts) END AS stamp
 FROM events JOIN part ON user_id = p_partkey WHERE event_type <> 'click'""",
}


def sql(body: str, *views: str) -> str:
    """A query over SQL_VIEWS: views in the order of their use."""
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({SQL_VIEWS[v]})" for v in views) + "\n" + body
