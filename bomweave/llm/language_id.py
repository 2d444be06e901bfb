"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 entries, drawn from a seed and its code point. A letter trigram (word ends count
as a letter) is bound into one vector: its letters' vectors, shifted by 2, 1 and 0 places, multiplied. A text's vector is the
bundle (sum) of its trigram vectors; a language's prototype is the bundle of its documents' unit vectors. A text is given the
language whose prototype has the greatest cosine with its vector, and that cosine, 0 at least, is its score.

Prototypes are learned from about `per_language` documents of each language at most, drawn by a hash of the id from all that may
be learned from; every language that is given is learned, so the profiles take 4 KB for each word of that vocabulary. Partial
bundles are integers, so their sum doesn't depend on order.

Cases: a null text and one without letters are `und` with score 0; ties go to the first language by name; a text of any length
is read whole, in blocks; repeated rows are judged each; where there is nothing to learn from, every text is `und`; a null id is
never learned from. Predictions read the text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomweave.llm.common import map_batches, materialize

DIMENSIONS = 1024
SEED = 20_240
#: Documents of a language that a prototype is learned from, about, at most.
PER_LANGUAGE = 2_000
#: Trigram vectors that a worker keeps; letters of a text that are bundled at once; and texts at once.
KEPT_TRIGRAMS, BLOCK, TEXTS = 24_576, 1 << 19, 64
#: Trigram vectors, and counts, that one multiplication takes.
PART, COUNTS = 2_048, 1 << 20
#: Cosine under which keep() rejects a document: three deviations of what random letters reach.
MIN_COSINE = 0.1
UNKNOWN = "und"
_SPACE = 32
_SCALE = float(1 << 30)


class Trigrams:
    """Letter trigrams of texts, and their vectors: one a task, so that no worker holds them longer."""

    def __init__(self) -> None:
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.vectors = np.empty((KEPT_TRIGRAMS, DIMENSIONS), np.float32)
        points = np.arange(0x110000, dtype=np.uint32)
        self.is_letter = np.array([chr(c).isalpha() for c in points.tolist()], bool)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            if len(self.letters) > 8 * KEPT_TRIGRAMS:
                self.letters.clear()
            self.letters[point] = np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1
        return self.letters[point]

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigrams given as codes."""
        missing = [c for c in codes.tolist() if c not in self.place]
        if len(self.place) + len(missing) > KEPT_TRIGRAMS:
            self.place.clear()
            missing = codes.tolist()
        if len(missing) > KEPT_TRIGRAMS:
            return np.array([self._bound(c) for c in missing], np.float32)
        for c in missing:
            self.place[c] = len(self.place)
            self.vectors[self.place[c]] = self._bound(c)
        return self.vectors[[self.place[c] for c in codes.tolist()]]

    def _bound(self, code: int) -> np.ndarray:
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def blocks(self, text: str) -> Iterator[np.ndarray]:
        """Letters of the lower-cased text, anything between words as one space; blocks share the two letters at a seam."""
        tail = np.array([_SPACE], np.int64)
        for at in range(0, len(text), BLOCK):
            own = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            own = np.where(self.is_letter[own], own, _SPACE)
            if at + BLOCK >= len(text):
                own = np.append(own, _SPACE)
            own = np.concatenate([tail, own])
            own = own[np.concatenate([[True], (own[1:] != _SPACE) | (own[:-1] != _SPACE)])]
            if len(own) > 2:
                yield own
            tail = own[-2:]

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """The vector of each text; zeros for one without letters."""
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        rows: list[tuple[int, np.ndarray]] = []
        held = 0
        for i, text in enumerate(texts):
            for block in self.blocks(text or ""):
                rows.append((i, block))
                held += len(block)
                if held >= BLOCK or len(rows) >= TEXTS:
                    self._add(out, rows)
                    rows, held = [], 0
        if rows:
            self._add(out, rows)
        return out

    def _add(self, out: np.ndarray, rows: list[tuple[int, np.ndarray]]) -> None:
        letters, compact = np.unique(np.concatenate([r for _, r in rows]), return_inverse=True)
        k, sizes = len(letters), [len(r) for _, r in rows]
        inside = np.ones(len(compact), bool)  # of trigrams that don't cross from one row to the next
        for end in np.cumsum(sizes).tolist():
            inside[max(0, end - 2) : end] = False
        first = np.flatnonzero(inside)
        codes = (compact[first] * k + compact[first + 1]) * k + compact[first + 2]
        row = np.repeat(np.arange(len(rows)), sizes)[first]
        if k**3 <= 4 * BLOCK:
            seen = np.flatnonzero(np.bincount(codes, minlength=k**3))
            slot = np.zeros(k**3, np.int64)
            slot[seen] = np.arange(len(seen))
            codes = slot[codes]
        else:
            seen, codes = np.unique(codes, return_inverse=True)
        g = len(seen)
        named = letters[seen // (k * k)] << 42 | letters[seen // k % k] << 21 | letters[seen % k]
        for at in range(0, len(rows), max(1, COUNTS // max(g, 1))):  # counts of few rows at once where there are many trigrams
            to = min(len(rows), at + max(1, COUNTS // max(g, 1)))
            here = slice(*np.searchsorted(row, [at, to]))
            counts = np.bincount((row[here] - at) * g + codes[here], minlength=(to - at) * g).reshape(to - at, g).astype(np.float32)
            for part in range(0, g, PART):
                own = slice(part, part + PART)
                np.add.at(out, [i for i, _ in rows[at:to]], counts[:, own] @ self.matrix(named[own]))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


class Profiles:
    """Prototypes of languages."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages = languages
        self.prototypes = _unit(prototypes.astype(np.float64)).astype(np.float32)

    def predict(self, texts: list[str | None], trigrams: Trigrams) -> tuple[list[str], np.ndarray]:
        """The language of each text and the cosine with its prototype."""
        own = _unit(trigrams.bundles(texts))
        if not self.languages or not len(own):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        cosines = own @ self.prototypes.T
        best = cosines.argmax(axis=1)
        some = own.any(axis=1)
        score = np.where(some, cosines[np.arange(len(own)), best], 0).clip(0, 1).astype(float)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)], score


def _slices(column: pa.Array) -> Iterator[list[str | None]]:
    for at in range(0, len(column), TEXTS):
        yield column.slice(at, TEXTS).to_pylist()


def learn(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Profiles:
    """Prototypes from the rows of docs where may_learn holds and a language is given."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), may_learn.alias("may"))
    rows = rows.where("may and lang is not null and id is not null")
    shares = materialize(rows.groupBy("lang").agg((F.lit(per_language) / F.count("*")).alias("share")), "languages")
    if shares.isEmpty():
        return Profiles([], np.zeros((0, DIMENSIONS)))
    # a row a language, as a written table: Spark broadcasts it where it is known to be small
    drawn = rows.join(shares, "lang").where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        trigrams = Trigrams()
        for batch in batches:
            for texts, langs in zip(_slices(batch.column(0)), _slices(batch.column(1)), strict=True):
                whole = np.rint(_unit(trigrams.bundles(texts).astype(np.float64)) * _SCALE).astype(np.int64)
                for lang, own in zip(langs, whole, strict=True):
                    sums[lang] = sums.get(lang, 0) + own
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        whole = sum(np.frombuffer(b, np.int64) for b in group["sums"])
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "sums": [np.asarray(whole, np.int64).tobytes()]})

    parts = map_batches(drawn.select("text", "lang"), run, "lang string, sums binary")
    whole = sorted(parts.groupBy("lang").applyInPandas(add, "lang string, sums binary").collect(), key=lambda r: r.lang)
    return Profiles([r.lang for r in whole], np.array([np.frombuffer(r.sums, np.int64) for r in whole]).reshape(-1, DIMENSIONS))


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of each row: a narrow map. The profiles, a vector a language, are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = Trigrams()
        for batch in batches:
            langs, scores = [], []
            for texts in _slices(batch.column(1)):
                own, score = shared.value.predict(texts, trigrams)
                langs += own
                scores += score.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return map_batches(chosen, run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep(docs: DataFrame, profiles: Profiles, text_col: str = "text", least: float = MIN_COSINE) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: not `und`, and of at least the cosine `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    at = docs.columns.index(text_col)

    def kept(texts: list[str | None], trigrams: Trigrams) -> list[bool]:
        langs, scores = shared.value.predict(texts, trigrams)
        return [x != UNKNOWN and s >= least for x, s in zip(langs, scores.tolist(), strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigrams = Trigrams()
        for batch in batches:
            mask = [k for texts in _slices(batch.column(at)) for k in kept(texts, trigrams)]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def may_learn(id_col: str = "doc_id", folds: int = 5, held_out: int = 0) -> Column:
    """Whether a row is outside the held-out fold: crc32 of the id as text, modulo folds. Null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held_out
