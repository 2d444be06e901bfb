"""Places in an order over all rows, without a window that would gather them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomweave.storage import materialize

_ROW = (1 << 33) - 1  # the bits of monotonically_increasing_id() that count a partition's rows


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with their place in the order, from 0: sorted by ranges and written, then each range's rows are offset by the ranges before.

    The one window without a key holds as many rows as the sort has partitions.
    """
    tagged = materialize(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialize(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base")), "bases")
    return tagged.withColumn("_part", part).join(bases, "_part").withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit(_ROW))).drop("_part", "_at", "_base")


def numbered_within(rows: DataFrame, group: str, *order: Column | str, name: str = "place") -> DataFrame:
    """The same by group: places start at 0 in each, and a group may hold any share of the rows."""
    every = materialize(numbered(rows, group, *order, name="_place"), "places")
    first = materialize(every.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first")), "firsts")
    return every.join(first, every[group].eqNullSafe(first["_group"])).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_group", "_first")
