"""Documents as they arrive: a file stream parsed by the batch parser, each micro-batch appended to a table of parses.

A late document can change any earlier answer, so nothing is answered from a stream: the workspace is made from the whole table
of parses when it is asked for, and equals that of one batch over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bomweave.model import Workspace
from bomweave.sources.files import ROW, scan, to_workspace


def start(spark: SparkSession, source: str, table: str, checkpoint: str, pattern: str | None = None, once: bool = True) -> StreamingQuery:
    """Parse files that arrive in source into Parquet files at table; exactly once, by the file sink's log."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    writer = scan(reader.load(source)).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def parses(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(table)


def workspace(spark: SparkSession, table: str) -> Workspace:
    return to_workspace(parses(spark, table))
