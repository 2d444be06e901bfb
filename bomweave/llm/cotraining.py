"""Quality classifier by co-training on two views of a document.

The content view is the classifier of linear.py on the words of the text. The metadata view is a logistic regression on language,
source, length and layout figures (lines, and shares of character classes): what is known of the page without reading a word. So
no feature is in both views. Both start from the labelled rows; in every round each gives the pool documents that it is surest
of, with its own label for them, to the other one's training rows, and both are fitted again. Labelled rows that neither was
fitted on then calibrate each view and a combination of both logits, which scores all documents.

The labelled rows are a bounded sample, drawn by a hash of the id: about MAX_LABEL of each label at most (a quarter of them for
calibration), weighted back to the shares of all, so a rare label isn't lost; the views are fitted in one task. The pool is every
unlabelled document that may be learned from: each round scores all of them with both views in a narrow map over whole texts and
takes the surest of each label by a distributed top-k.

Cases: null texts count as empty, null metadata as values of their own; of several labels of one document the greatest counts;
of several rows of a labelled id one is learned from; of equally sure documents those of the smallest ids are exchanged; without
labels every score is 0.5 and every document is kept; repeated rows are scored each; a text of any length is read whole; an empty
table gives no rows. Scores never read labels or ids.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bomweave.llm.common import map_batches, materialize
from bomweave.llm.linear import BLOCK, WordModel, fit_dense, sigmoid

MAX_LABEL = 800
ROUNDS, PER_ROUND, SURE = 3, 150, 0.9
#: Score from which a document is kept.
KEEP = 0.3
_SEED = 5
_LANGS, _SOURCES = 8, 32

#: A row: text, lang, source, n_chars.
Row = tuple[str | None, str | None, str | None, int | None]


def _classes() -> np.ndarray:
    """0 other, 1 lower-case, 2 upper-case, 3 digit, 4 white space, 5 other letter, for each code point below 0x3000."""
    out = np.zeros(0x3000, np.int64)
    for i in range(len(out)):
        c = chr(i)
        out[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 5 if c.isalpha() else 0
    return out


_CLASSES = _classes()


def layout(text: str | None) -> list[float]:
    """Shares of character classes, and lines and blank lines by 1,000 characters."""
    text = text or ""
    counts = np.zeros(6)
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
        counts += np.bincount(_CLASSES[np.minimum(points, len(_CLASSES) - 1)], minlength=6)
    n = max(len(text), 1)
    return [*(counts / n).tolist(), 1000 * text.count("\n") / n, 1000 * text.count("\n\n") / n]


def _hashed(value: str | None, slots: int) -> np.ndarray:
    out = np.zeros(slots)
    out[0 if value is None else 1 + zlib.crc32(value.encode("utf-8", "surrogatepass")) % (slots - 1)] = 1
    return out


def metadata(row: Row) -> np.ndarray:
    text, lang, source, n_chars = row
    size = np.log1p(max(n_chars if n_chars is not None else len(text or ""), 0))
    own = layout(text)
    return np.concatenate([_hashed(lang, _LANGS), _hashed(source, _SOURCES), [size, size * size / 10, float(n_chars is None)], own, np.sqrt(own)])


class Content:
    """The view of the text."""

    def __init__(self) -> None:
        self.model = WordModel()

    def fit(self, rows: list[Row], y: np.ndarray, weight: np.ndarray | None = None) -> None:
        self.model.fit([r[0] for r in rows], y, weight)

    def logits(self, rows: list[Row]) -> np.ndarray:
        return np.array([self.model.logit(r[0]) for r in rows])


class Metadata:
    """The view of everything else."""

    def __init__(self) -> None:
        self.mean = self.scale = self.weights = np.zeros(0)

    def fit(self, rows: list[Row], y: np.ndarray, weight: np.ndarray | None = None) -> None:
        x = np.array([metadata(r) for r in rows])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.weights = fit_dense((x - self.mean) / self.scale, y, weight)

    def logits(self, rows: list[Row]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        x = (np.array([metadata(r) for r in rows]) - self.mean) / self.scale
        return x.clip(-8, 8) @ self.weights[:-1] + self.weights[-1]


class CoTrained:
    """Both views after the exchange, and their calibration."""

    def __init__(self, rows: list[Row], y: np.ndarray, pool: list[Row], check: list[Row], check_y: np.ndarray, rounds: int = ROUNDS, per_round: int = PER_ROUND):
        self.views = [Content(), Metadata()]
        own = [(list(rows), y.tolist()) for _ in self.views]
        left = [[*pool], [*pool]]
        self.exchanged = 0
        for r in range(rounds + 1):
            for view, (x, labels) in zip(self.views, own, strict=True):
                view.fit(x, np.array(labels))
            if r == rounds:
                break
            for i, view in enumerate(self.views):
                sure = np.array([sigmoid(z) for z in view.logits(left[i])])
                good = np.argsort(-sure, kind="stable")[:per_round]
                bad = np.argsort(sure, kind="stable")[:per_round]
                given = {**{int(k): 1.0 for k in good if sure[k] >= SURE}, **{int(k): 0.0 for k in bad if sure[k] <= 1 - SURE}}
                other = own[1 - i]
                other[0].extend(left[i][k] for k in given)
                other[1].extend(given.values())
                left[i] = [x for k, x in enumerate(left[i]) if k not in given]
                self.exchanged += len(given)
        self._calibrate(check, check_y)

    @classmethod
    def of(cls, own: list[tuple[list[Row], np.ndarray, np.ndarray]], check: list[Row], check_y: np.ndarray, check_weight: np.ndarray) -> CoTrained:
        """The views fitted once on their own rows (with labels and weights), without an exchange."""
        out = cls.__new__(cls)
        out.views, out.exchanged = [Content(), Metadata()], 0
        for view, (x, labels, weight) in zip(out.views, own, strict=True):
            view.fit(x, labels, weight)
        out._calibrate(check, check_y, check_weight)
        return out

    def _calibrate(self, check: list[Row], check_y: np.ndarray, weight: np.ndarray | None = None) -> None:
        z = np.column_stack([v.logits(check) for v in self.views])
        self.single = [fit_dense(z[:, [i]], check_y, weight) for i in range(2)]
        self.both = fit_dense(z, check_y, weight)

    def scores(self, rows: list[Row]) -> np.ndarray:
        """Calibrated content score, metadata score and combined score of each row."""
        z = np.column_stack([v.logits(rows) for v in self.views])
        return np.column_stack([*(sigmoid(z[:, i] * w[0] + w[1]) for i, w in enumerate(self.single)), sigmoid(z @ self.both[:2] + self.both[2])])


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", label_col: str = "quality") -> CoTrained | None:
    """A model from samples of docs (text, lang, source, n_chars) and labels where may_learn (over `id`) holds; None without both labels."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull())
    known = known.groupBy("id").agg((F.max("label") > 0).cast("int").alias("label"))
    n = {r.label: r.n for r in known.where(may_learn).groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    dice = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30))
    shares = {label: min(1.0, MAX_LABEL / count) for label, count in n.items()}
    drawn = known.where(may_learn & (dice(_SEED) < F.when(F.col("label") == 1, shares[1]).otherwise(shares[0]) * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    rows = rows.where(may_learn & F.col("id").isNotNull()).withColumn("mark", F.xxhash64("text", "lang", "source", "n_chars"))
    plain = StructType([StructField("id", rows.schema["id"].dataType), *(StructField(c, LongType()) for c in ("mark", "to", "label"))])
    found = rows.join(F.broadcast(drawn), "id")  # bounded by MAX_LABEL; one scan of the texts
    one = found.groupBy("id", "label").agg(F.min_by(F.struct("text", "lang", "source", "n_chars", "mark"), "mark").alias("row"))
    chosen = one.select("id", "row.*", F.lit(None).cast("long").alias("to"), F.col("label").cast("long").alias("label"))
    chosen = materialize(chosen.select(*rows.columns, "to", "label"), "labelled")
    given: list[set[tuple[object, int]]] = [set(), set()]  # by the view that gave: at most 2 * PER_ROUND a round
    for r in range(ROUNDS + 1):
        model = pickle.loads(map_batches(chosen.repartition(1), _fit(shares), "model binary").first().model)
        model.exchanged = sum(map(len, given))
        if r == ROUNDS:
            break
        sure = materialize(_logits(rows, model).join(known.select("id"), "id", "left_anti"), "logits")
        new = []
        for view, own in enumerate(given):
            past = docs.sparkSession.createDataFrame([(*k, None, None) for k in own], plain).select("id", "mark")
            z, bound = F.col(f"z{view}"), float(np.log(SURE / (1 - SURE)))
            left = sure.where(F.abs(z) >= bound).join(F.broadcast(past), ["id", "mark"], "left_anti")  # past: at most 2 * PER_ROUND a round
            once = left.groupBy("id", "mark").agg(F.max(z).alias("z"))
            for label, found in ((1, once.where("z > 0").orderBy(F.desc("z"), "id", "mark")), (0, once.where("z < 0").orderBy("z", "id", "mark"))):
                for k in found.limit(PER_ROUND).select("id", "mark").collect():
                    own.add((k.id, k.mark))
                    new.append((k.id, k.mark, 1 - view, label))
        if new:
            picked = docs.sparkSession.createDataFrame(new, plain)
            chosen = chosen.unionByName(materialize(rows.join(F.broadcast(picked), ["id", "mark"]).dropDuplicates(["id", "mark", "to"]), "given"))
    return model


def _fit(shares: dict[int, float]):
    """A map from rows with labels to a pickled model: of the sample (`to` is null), drawn by these shares, and rows given to one view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["id"], r["text"] or ""))
        row = lambda r: (r["text"], r["lang"], r["source"], r["n_chars"])
        check, fit = [], []
        for label in (0, 1):  # a quarter of each label calibrates
            own = [r for r in found if r["to"] is None and r["label"] == label]
            check += own[3::4]
            fit += [r for k, r in enumerate(own) if k % 4 != 3]
        y = lambda part: np.array([float(r["label"]) for r in part])

        def weight(part: list[dict]) -> np.ndarray:
            """Of the sample back to the shares of all, 1 on average; 1 for rows that were given."""
            own = np.array([1 / shares[r["label"]] if r["to"] is None else 0.0 for r in part])
            return np.where(own > 0, own / max(own[own > 0].mean() if (own > 0).any() else 1, 1e-9), 1.0)

        parts = [fit + [r for r in found if r["to"] == view] for view in range(2)]
        model = CoTrained.of([([*map(row, part)], y(part), weight(part)) for part in parts], [*map(row, check)], y(check), weight(check))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return run


def _logits(rows: DataFrame, model: CoTrained) -> DataFrame:
    """id, mark and both views' logits (z0, z1) of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: tuple[list[np.ndarray], ...] = ([], [])
            for at in range(0, batch.num_rows, 256):
                own = [*zip(*(c.to_pylist() for c in batch.slice(at, 256).columns[2:]), strict=True)]
                for part, view in zip(parts, shared.value.views, strict=True):
                    part.append(view.logits(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.concatenate([*p, np.zeros(0)])) for p in parts)], ["id", "mark", "z0", "z1"])

    chosen = rows.select("id", "mark", "text", "lang", "source", "n_chars")
    return map_batches(chosen, run, f"id {rows.schema['id'].dataType.simpleString()}, mark long, z0 double, z1 double")


def score(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", keep: float = KEEP) -> DataFrame:
    """id, content_score, metadata_score, score and kept of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["id", "content_score", "metadata_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for at in range(0, batch.num_rows, 256):
                rows = [*zip(*(c.to_pylist() for c in batch.slice(at, 256).columns[1:]), strict=True)]
                parts.append(shared.value.scores(rows) if shared.value else np.full((len(rows), 3), 0.5))
            own = np.concatenate(parts) if parts else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(own[:, i].copy()) for i in range(3))], names)

    chosen = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    kind = chosen.schema["id"].dataType.simpleString()
    scored = map_batches(chosen, run, f"id {kind}, content_score double, metadata_score double, score double")
    return scored.withColumn("kept", F.col("score") >= keep).withColumnRenamed("id", id_col)
