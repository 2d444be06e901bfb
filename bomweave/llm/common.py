"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: the ASCII characters 0x20 and 0x09 to 0x0D.
WHITE_SPACE = "[\\x20\\x09-\\x0D]"


#: A local master's folder where spark.checkpoint.dir is unset: made once a process, removed at its end.
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (the folder may be in any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder of its own, removed at exit; a cluster gets an error,
    since no machine-local folder is seen by all its executors.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="bomweave-"))
        atexit.register(shutil.rmtree, _OWN[0], True)
    return _OWN[0]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to a Python worker, where the session doesn't say: rows may be long, so a number of rows
#: bounds nothing.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow(run, schema), with batches bounded by bytes and with unused memory given back after each task.

    Workers are used again by later stages beside JVMs that have grown, so what they keep for themselves adds up.
    """
    conf = df.sparkSession.conf
    if conf.get(_BYTES, None) is None:
        conf.set(_BYTES, BATCH_BYTES)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return df.mapInArrow(released, schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_many_to_one(rows: DataFrame, key: str, ones: DataFrame, n: str = "n") -> DataFrame:
    """rows with the columns of ones: a written table with one row a key, whose column n says how many rows have the key.

    Keys of more than a 4 * partitions-th of all rows are at most as many, so those are broadcast and none of them lands in one
    task; the others are shuffled.
    """
    total = ones.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) > total // (4 * shuffle_partitions(rows.sparkSession))
    hot, rest = ones.where(often).drop(n), ones.where(~often).drop(n)
    if hot.isEmpty():
        return rows.join(rest, key)
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(rest, key))


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text or one of white space only."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WHITE_SPACE}+"), "")


def rank_in(bounds: Column, n_bounds: int, key: Column, strict: bool = False) -> Column:
    """How many of the sorted bounds are at most key (strict: less than key), by binary search (log2 n steps a row)."""
    passed = (lambda bound: bound < key) if strict else (lambda bound: bound <= key)
    steps = [1 << k for k in reversed(range(max(1, n_bounds.bit_length())))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= n_bounds) & (passed(F.get(bounds, at + step - 1))), at + step).otherwise(at),
    )


def quoted(name: str) -> str:
    """A column name as column expressions take it, whatever characters it holds."""
    return f"`{name.replace('`', '``')}`"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df has not, made from names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
