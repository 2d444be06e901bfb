"""Tables that iterative plans write between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A local master's folder where spark.checkpoint.dir is unset: made once a process, removed at its end.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a local master and an error for a cluster."""
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


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df as Parquet and read it back, so that later plans start from the table."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """A table that grows by steps: each is written below one folder, and all of them are read as one scan."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.n, self.schema = spark, new_path(spark, label), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write a step and read it alone."""
        path = f"{self.path}/step-{self.n}"
        df.write.parquet(path)
        self.n, self.schema = self.n + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)
