"""Delivered files held against the files that documents declare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomweave.functions.identity import STRENGTH, delivery_algorithm, normalized_path

COMPUTED = {"SHA1": lambda c: F.sha1(c), "SHA256": lambda c: F.sha2(c, 256), "SHA384": lambda c: F.sha2(c, 384), "SHA512": lambda c: F.sha2(c, 512)}


def delivery_algorithms(elements: DataFrame) -> DataFrame:
    """algorithm: those that any file element declares."""
    return elements.where("kind = 'file'").select(F.explode("checksums").alias("c")).select(delivery_algorithm(F.col("c.algorithm")).alias("algorithm")).distinct()


def has_verifiable_files(elements: DataFrame) -> bool:
    return not elements.where((F.col("kind") == "file") & (F.size("checksums") > 0)).limit(1).isEmpty()


def hash_files(files: DataFrame, algorithms: list[str]) -> DataFrame:
    """path, size, digests of files as the binaryFile source reads them, for the algorithms that can be computed."""
    own = [x for a in algorithms if a in COMPUTED for x in (F.lit(a), COMPUTED[a](F.col("content")))]
    digests = F.create_map(*own) if own else F.create_map().cast("map<string,string>")
    return files.select("path", F.col("length").alias("size"), digests.alias("digests"), F.monotonically_increasing_id().alias("ord"))


def check(elements: DataFrame, delivered: DataFrame) -> DataFrame:
    """(doc_id, spdx_id, path, verdict, algorithm, declared, actual, reason) of each file element.

    delivered: path, size, digests (algorithm to hex) and ord; of files with one path the last counts. The strongest algorithm
    that both sides have decides.
    """
    last = delivered.groupBy(normalized_path(F.col("path")).alias("key")).agg(F.max_by("digests", "ord").alias("digests"))
    files = elements.where("kind = 'file'").withColumn("key", normalized_path(F.col("name")))
    joined = files.join(last, "key", "left")
    sums = F.transform("checksums", lambda c: F.struct(delivery_algorithm(c["algorithm"]).alias("a"), F.lower(c["value"]).alias("v")))
    joined = joined.withColumn("sums", sums)

    def tried(a: str) -> F.Column:
        declared = F.get(F.filter("sums", lambda c: c["a"] == a), F.lit(0))["v"]
        return F.struct(F.lit(a).alias("a"), declared.alias("declared"), F.lower(F.try_element_at("digests", F.lit(a))).alias("actual"))

    hit = F.get(F.filter(F.array(*map(tried, STRENGTH)), lambda t: t["declared"].isNotNull() & t["actual"].isNotNull()), F.lit(0))
    joined = joined.withColumn("hit", hit)
    none = F.coalesce(F.size("checksums"), F.lit(0)) == 0
    verdict = F.when(F.col("digests").isNull(), "missing").when(none | F.col("hit").isNull(), "unverifiable").when(F.col("hit.actual") == F.col("hit.declared"), "match").otherwise("mismatch")
    reason = F.when(F.col("verdict") == "unverifiable", F.when(none, "no checksum in the document").otherwise("no checksum algorithm in common"))
    seen = F.col("digests").isNotNull()
    return joined.withColumn("verdict", verdict).select("doc_id", "spdx_id", F.col("name").alias("path"), "verdict", F.when(seen, F.col("hit.a")).alias("algorithm"), F.when(seen, F.col("hit.declared")).alias("declared"), F.when(seen, F.col("hit.actual")).alias("actual"), reason.alias("reason"))


def extra(elements: DataFrame, delivered: DataFrame) -> DataFrame:
    """(path, size): delivered files that no file element declares."""
    known = elements.where("kind = 'file'").select(normalized_path(F.col("name")).alias("key")).distinct()
    return delivered.withColumn("key", normalized_path(F.col("path"))).join(known, "key", "left_anti").select("path", "size")


def summary(checked: DataFrame, extras: DataFrame) -> DataFrame:
    """One row: files by verdict, extra files, and file elements in all."""
    verdicts = checked.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("match", "mismatch", "missing", "unverifiable")), F.count("*").alias("total"))
    return verdicts.join(extras.agg(F.count("*").alias("extra")))  # one row each


def blob_verdict(algorithm: F.Column, declared: F.Column, stored: F.Column, unpacked: F.Column, manifest: F.Column) -> F.Column:
    """Whether a blob's digest is the declared one, by the declared normalisation; null where none is declared."""
    same = lambda c: F.lower(c) == F.lower(declared)
    generic = F.when(same(stored) | F.coalesce(same(unpacked), F.lit(False)), "match").otherwise("mismatch")
    artifact = F.when(manifest.isNull(), "unchecked").when(same(manifest), "match").otherwise("mismatch")
    return F.when(declared.isNull(), None).when(algorithm == "genericBlobDigest/v1", generic).when(algorithm == "ociArtifactDigest/v1", artifact).otherwise("unchecked")


def indexed_verdict(algorithm: F.Column, declared: F.Column, stored: F.Column, gzipped: F.Column) -> F.Column:
    """The same for a blob known by its index only: SHA-256, and never a mismatch where the bytes are packed."""
    return F.when(declared.isNull(), None).when(F.lower(algorithm) != "sha256", "unchecked").when(F.lower(stored) == F.lower(declared), "match").when(gzipped, "unchecked").otherwise("mismatch")
