"""Toxicity: a character n-gram linear classifier with features scaled by naive Bayes log-count ratios.

It is fitted on a bounded sample of labelled rows: at most about MAX_TOXIC toxic ones and MAX_CLEAN others, drawn by a hash of
the id from all that may be learned from, weighted back to the shares of all. One task fits it; the model, of fixed greatest
size, is broadcast, and scoring is a narrow map over whole texts.

Cases: null and empty texts get the score of a text without features; a text of any length is read whole, in blocks; of several
labels of one document the greatest counts, and null labels none; of several rows of a labelled id that of the least text is
learned from; n-grams that separate the labels equally well are kept in order of their hashes; where nothing is labelled every
score is 0; repeated rows are scored each; an empty table gives no rows. Scores read the text only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomweave.llm.common import map_batches
from bomweave.llm.linear import GramModel, sigmoid

MAX_TOXIC, MAX_CLEAN = 1_500, 3_000
SIZES = (3, 4, 5, 6)
THRESHOLD = 0.3
_SEED = 10


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> GramModel | None:
    """A model of the labelled rows of docs where may_learn (over `id`) holds; None where there are none.

    The sample of ids is drawn from the labels alone and joined to the documents; its size is bounded, so the join broadcasts it.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(may_learn & F.col("label").isNotNull() & F.col("id").isNotNull())
    known = known.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    shares = {label: min(1.0, most / totals[label]) for label, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)) if label in totals}
    dice = F.pmod(F.xxhash64("id", F.lit(_SEED)), F.lit(1 << 30))
    share = F.when(F.col("label") == 1, shares.get(1, 0.0)).otherwise(shares.get(0, 0.0))
    drawn = known.where(dice < share * (1 << 30))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(drawn), "id")  # bounded by MAX_TOXIC and MAX_CLEAN
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))  # an id may have any number of rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((i, label, t) for b in batches for i, t, label in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda x: (x[0], x[1], x[2] or ""))
        y = np.array([label for _, label, _ in found], float)
        weight = np.array([1 / shares[label] for _, label, _ in found])
        model = GramModel(SIZES, True).fit([t for *_, t in found], y, weight / max(weight.mean(), 1e-9) if len(weight) else weight)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    fitted = map_batches(rows.select("id", "text", "label").repartition(1), run, "model binary").first()
    return pickle.loads(fitted.model) if fitted else None


def score(docs: DataFrame, model: GramModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            own = [float(sigmoid(model.logit(t.as_py()))) if model else 0.0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.float64())], ["id", "score"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return map_batches(chosen, run, f"id {kind}, score double").withColumnRenamed("id", id_col)
