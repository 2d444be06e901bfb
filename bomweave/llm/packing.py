"""Best-two-fit packing of token sequences.

A document is its token ids and an end id; one longer than a sequence is cut into pieces of the full length (the last may be
shorter). A bin is filled greedily with the longest piece that still fits; then its smallest piece is replaced by two unpacked
pieces that fit the gap so expanded more tightly, if there are such two.

Pieces of equal length are alike to the packer, so it runs over the counts by length (at most `size` numbers whatever the
corpus) and repeats a filled bin for as long as the counts allow: the same bins as piece by piece, without collecting a piece.
Which piece goes where follows from its rank among the pieces of its length; the ranks come from counts by salted bucket, so
that no task gets all the pieces of a frequent length.

Cases: a null or empty text is the end id alone; a text of any length is cut, never shortened; repeated rows and null ids are
packed like others, each row on its own; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomweave.llm.bpe import LibraryEncoder, encoder, read_tokenizer
from bomweave.llm.common import map_batches, materialize, shuffle_partitions

#: Buckets among which the pieces of one length are dealt for ranking, at least; as many as shuffle partitions where those are more.
BUCKETS = 64


class LengthPacker:
    """Packs pieces given as counts by length; bins() gives (lengths of a bin, longest first; times it is used)."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.left = np.zeros(size + 1, np.int64)
        for length, n in counts.items():
            if not 1 <= length <= size:
                raise ValueError(f"a piece of {length} tokens in sequences of {size}")
            self.left[length] += n
        self._reach()

    def _reach(self) -> None:
        """longest[g]: the greatest length of which a piece is left and that is at most g, or 0."""
        self.longest = np.maximum.accumulate(np.where(self.left > 0, np.arange(self.size + 1), 0))

    def _take(self, length: int) -> None:
        self.left[length] -= 1
        if not self.left[length]:
            self._reach()

    def _give(self, length: int) -> None:
        self.left[length] += 1
        if self.left[length] == 1:
            self._reach()

    def _two(self, room: int) -> tuple[int, int]:
        """Two unpacked lengths, the first at least the second, of the greatest sum that room holds; zeros if none."""
        first = np.flatnonzero(self.left[: room + 1])
        again = (self.left[first] >= 2) & (2 * first <= room)
        second = np.where(again, first, self.longest[np.maximum(np.minimum(room - first, first - 1), 0)])
        sums = np.where(second > 0, first + second, 0)
        if not len(sums) or not sums.max():
            return 0, 0
        best = len(sums) - 1 - int(sums[::-1].argmax())
        return int(first[best]), int(second[best])

    def _one_bin(self) -> list[int]:
        gap, own = self.size, []
        while length := int(self.longest[gap]):
            self._take(length)
            own.append(length)
            gap -= length
        if gap and len(own) > 1:
            smallest = own[-1]
            first, second = self._two(gap + smallest)
            if first + second > smallest:
                own.pop()
                self._give(smallest)
                for length in (first, second):
                    self._take(length)
                    own.append(length)
        return sorted(own, reverse=True)

    def bins(self) -> Iterator[tuple[list[int], int]]:
        while self.longest[self.size]:
            own = self._one_bin()
            lengths, each = np.unique(own, return_counts=True)
            more = int((self.left[lengths] // each).min())
            self.left[lengths] -= more * each
            if more:
                self._reach()
            yield own, 1 + more


def places(counts: dict[int, int], size: int) -> pd.DataFrame:
    """Where the pieces of each length go: from rank `start` on, `each` to a sequence, from `sequence` and `offset` on.

    As many rows as the packer makes different bins, times the lengths in each: bounded by the size of a sequence.
    """
    used = dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    for own, times in LengthPacker(counts, size).bins():
        offset = 0
        lengths, each = np.unique(own, return_counts=True)
        for length, n in zip(lengths[::-1].tolist(), each[::-1].tolist(), strict=True):
            rows.append((length, used[length], n, sequence, offset))
            used[length] += n * times
            offset += n * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "start", "each", "sequence", "offset"]).sort_values(["length", "start"], ignore_index=True)


def cut(docs: DataFrame, tokenizer_path: str, size: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of each document: id, piece, start, length, crc32 of the ids' bytes and, if asked for, these bytes."""
    tokenizer = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    end = array("i", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer.value, LibraryEncoder)
        for batch in batches:
            keys, rows = [], []
            for key, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                ids = own.encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    keys.append(key)
                    rows.append((k, at // 4, len(piece) // 4, zlib.crc32(piece), *([piece] if keep_ids else [])))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if keep_ids else [])]
            columns = [*zip(*rows, strict=True)] if rows else [[]] * len(kinds)
            names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), *map(pa.array, columns, kinds)], names)

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return map_batches(chosen, run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with the sequence that each goes to and its offset there.

    Tokenized once (the pieces are written to the shared folder), counted and ranked by length, then placed inside the JVM: the
    table of places, whose size depends on `size` only, is cut where the buckets of a length meet, so a piece is joined to the
    runs of its own length and bucket and finds its run there by binary search.
    """
    spark = docs.sparkSession
    buckets = max(BUCKETS, shuffle_partitions(spark))
    bucket = F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)).cast("int")
    pieces = materialize(cut(docs, tokenizer_path, size, end_id, id_col, text_col, keep_ids).withColumn("bucket", bucket), "pieces")
    by_bucket = materialize(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")  # size x buckets rows at most
    counts = {r.length: r.n for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(pa.Table.from_pandas(places(counts, size)))

    upto = F.sum("n").over(Window.partitionBy("length").orderBy("bucket"))
    dealt = by_bucket.select("length", "bucket", (upto - F.col("n")).alias("base"), upto.alias("end"))
    ends = F.lead("start").over(Window.partitionBy("length").orderBy("start"))
    own = runs.withColumn("stop", ends).join(dealt, "length").where("start < end and (stop is null or stop > base)")
    own = own.groupBy("length", "bucket", "base").agg(F.array_sort(F.collect_list(F.struct("start", "each", "sequence", "offset"))).alias("runs"))
    own = materialize(own, "runs")

    within = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = pieces.withColumn("local", F.row_number().over(within) - 1).join(own, ["length", "bucket"]).withColumn("rank", F.col("local") + F.col("base"))
    steps = F.transform(F.sequence(F.lit(0), F.length(F.bin(F.size("runs").cast("long"))) - 1), lambda k: F.call_function("shiftleft", F.lit(1), k))
    ahead = lambda at, step: F.when((at + step < F.size("runs")) & (F.get(F.col("runs.start"), at + step) <= F.col("rank")), at + step).otherwise(at)
    found = ranked.withColumn("run", F.get("runs", F.aggregate(F.reverse(steps), F.lit(0), ahead)))
    past = F.col("rank") - F.col("run.start")
    out = [F.col(c) for c in pieces.columns if c != "bucket"]
    placed = found.select(*out, (F.col("run.sequence") + F.floor(past / F.col("run.each"))).alias("sequence_id"), (F.col("run.offset") + past % F.col("run.each") * F.col("length")).alias("offset"))
    return placed.withColumnRenamed("id", id_col)
