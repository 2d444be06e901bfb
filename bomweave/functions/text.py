"""Small text rules: display sizes, version tags, shared folders, deep links, license expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomweave.sources.lint import license_error

MAX_LINKS = 8


def format_bytes(n: Column) -> Column:
    """1023 B, 1.0 KB, 1.5 MB: one decimal from a kilobyte on, halves upwards; megabytes are the greatest unit."""

    def shown(unit: int, name: str) -> Column:
        tenths = F.floor((n * 20 + unit) / (2 * unit))
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {name}"))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, shown(1 << 10, "KB")).otherwise(shown(1 << 20, "MB"))


def format_count(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n.cast("long"), 0)


def tag_from_version(version: Column) -> Column:
    """A registry's tag: the first plus sign becomes .build-."""
    return F.regexp_replace(version, r"^([^+]*)\+", "$1.build-")


def version_from_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^(.*?)\.build-", "$1+")


def registry_versions(tags: Column) -> Column:
    """The versions that a registry's tags stand for, in the order of their characters."""
    return F.sort_array(F.transform(F.filter(tags, lambda t: t.isNotNull()), version_from_tag))


def common_folder(paths: DataFrame) -> DataFrame:
    """folder: the one that all paths (column path) begin with, empty where there is none. Least and greatest path decide."""
    parts = lambda c: F.slice(F.split(c, "/"), 1, F.greatest(F.size(F.split(c, "/")) - 1, F.lit(0)))
    ends = paths.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    both = F.arrays_zip(parts(F.col("a")).alias("x"), parts(F.col("b")).alias("y"))
    first = F.array_position(F.transform(both, lambda z: F.coalesce(z["x"] == z["y"], F.lit(False))), False)
    n = F.when(first == 0, F.size(both)).otherwise(first - 1)
    return ends.select(F.array_join(F.slice(parts(F.col("a")), F.lit(1), n.cast("int")), "/").alias("folder"))


def deep_links(urls: DataFrame, limit: int = MAX_LINKS) -> DataFrame:
    """(id, url, place): of each row's urls (array) the absolute http ones, each once, the first `limit`."""
    every = urls.select("id", F.posexplode("urls").alias("pos", "url")).where(F.col("url").rlike("(?i)^https?://[^/]"))
    once = every.groupBy("id", "url").agg(F.min("pos").alias("pos"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).where(F.col("place") <= limit).select("id", "url", "place")


@F.pandas_udf(T.StringType())
def license_expression_error(expressions: pd.Series) -> pd.Series:
    """Why each license expression is not well formed, or null: a grammar with nesting, so Arrow batches of Python."""
    return expressions.map(lambda e: None if e is None else license_error(e))
