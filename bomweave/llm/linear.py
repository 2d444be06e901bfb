"""A linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of a text, told apart by a 64-bit hash. Training counts in how many texts of each label an
n-gram occurs; the ratio of the smoothed shares gives its log-count ratio r. The n-grams that separate the labels best are kept,
at most MAX_FEATURES; a text has r at each of its kept n-grams, 0 elsewhere, and a logistic regression is fitted on that. WordModel
is the same on the distinct words of a text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

MAX_FEATURES = 8_192
#: Characters of a text that are hashed at once, so that a text of any length needs bounded memory.
BLOCK = 1 << 20
#: Size, in bits, of the table that counts n-grams before they are told apart exactly, and of that which finds kept ones.
COUNT_BITS, FIND_BITS = 22, 20
#: Texts that an n-gram has to occur in.
LEAST_TEXTS = 4
_FACTOR = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(_FACTOR)
    return h ^ (h >> np.uint64(29))


def grams(text: str, sizes: tuple[int, ...], fold: bool) -> Iterator[np.ndarray]:
    """64-bit hashes of the n-grams of a text, in blocks; white space counts as one space, and one begins and ends the text."""
    if fold:
        text = text.lower()
    most = max(sizes)
    for at in range(0, max(len(text), 1), BLOCK):
        part = " ".join(text[max(0, at - 2 * most) : at + BLOCK].split())
        part = " " * (at == 0) + part + " " * (at + BLOCK >= len(text))
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(points)
        h = np.zeros(n, np.uint64)
        for size in range(1, most + 1):
            if size > n:
                break
            h = h[: n - size + 1] * np.uint64(0x100000001B3) + points[size - 1 :]
            if size in sizes:
                yield _mixed(h + np.uint64(size))


def _log_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    return np.log((pos + 1) / (n_pos + 2)) - np.log((neg + 1) / (n_neg + 2))


def _separation(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """How many deviations the shares of texts that have an n-gram are apart; 0 for a rare n-gram."""
    p, q = (pos + 0.5) / (n_pos + 1), (neg + 0.5) / (n_neg + 1)
    z = np.abs(p - q) / np.sqrt(p * (1 - p) / (n_pos + 1) + q * (1 - q) / (n_neg + 1))
    return np.where(pos + neg >= LEAST_TEXTS, z, 0)


def fit_logistic(x: list[np.ndarray], values: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a logistic regression by accelerated gradient steps; x: the features that each row has."""
    sizes = np.array([len(a) for a in x])
    flat = np.concatenate([*x, np.empty(0, np.int32)])
    row = np.repeat(np.arange(len(x), dtype=np.int32), sizes)
    scaled = values.astype(np.float32)[flat]
    norms = np.bincount(row, scaled**2, len(x)) + 1
    rate = 1 / (0.25 * float((weight * norms).sum()) / 4 + l2)
    w = v = np.zeros(len(values))
    b = c = 0.0
    best: tuple[float, np.ndarray, float] | None = None
    for k in range(steps):
        z = np.bincount(row, scaled * v[flat], len(x)) + c
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        loss = -float((weight * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum()) + l2 * float(v @ v) / 2
        if best is None or loss < best[0]:
            best = (loss, v, c)
        elif loss > 1.5 * best[0] + 1:  # the step was too long for this curvature
            rate, w, v, b, c = rate / 4, best[1], best[1], best[2], best[2]
            continue
        g = weight * (p - y)
        new_w, new_b = v - rate * (np.bincount(flat, scaled * g[row], len(values)) + l2 * v), c - rate * float(g.sum())
        momentum = k / (k + 3)
        v, c, w, b = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b), new_w, new_b
    assert best is not None
    return best[1], best[2]


@dataclass
class GramModel:
    """Kept n-grams (sorted hashes) with their ratios and coefficients; logit() scores a text."""

    sizes: tuple[int, ...]
    fold: bool
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    ratios: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    intercept: float = 0.0
    _find: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_find": None}

    def features(self, text: str | None) -> np.ndarray:
        """Places of the kept n-grams that a text has."""
        if self._find is None:
            self._find = np.zeros(1 << FIND_BITS, bool)
            self._find[self.hashes >> np.uint64(64 - FIND_BITS)] = True
        found = []
        if len(self.hashes):
            for h in grams(text or "", self.sizes, self.fold):
                h = h[self._find[h >> np.uint64(64 - FIND_BITS)]]
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                found.append(at[self.hashes[at] == h])
        return np.unique(np.concatenate(found)).astype(np.int32) if found else np.empty(0, np.int32)

    def logit(self, text: str | None) -> float:
        at = self.features(text)
        return self.intercept + float((self.ratios[at] * self.weights[at]).sum())

    def choose(self, texts: list[str | None], y: np.ndarray) -> None:
        """Keep the n-grams that separate labels 1 and 0 best, with their ratios."""
        n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
        shift = np.uint64(64 - COUNT_BITS)
        counts = np.zeros((2, 1 << COUNT_BITS), np.int32)
        for text, label in zip(texts, y.tolist(), strict=True):
            seen = np.unique(np.concatenate([h >> shift for h in grams(text or "", self.sizes, self.fold)] or [np.empty(0, np.uint64)]))
            counts[int(label), seen] += 1
        z = np.empty(1 << COUNT_BITS, np.float32)
        for at in range(0, len(z), 1 << 18):  # in parts, for the memory of what lies between
            z[at : at + (1 << 18)] = _separation(counts[1, at : at + (1 << 18)], counts[0, at : at + (1 << 18)], n_pos, n_neg)
        top = 2 * MAX_FEATURES
        rough = z >= max(np.partition(z, -top)[-top], 1e-9)
        del counts, z
        kept: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        for text, label in zip(texts, y.tolist(), strict=True):
            kept[int(label)].append(np.unique(np.concatenate([h[rough[h >> shift]] for h in grams(text or "", self.sizes, self.fold)] or [np.empty(0, np.uint64)])))
        own, both = np.empty(0, np.uint64), []
        for part in kept:  # sorted in place and counted by label: no inverse of the size of all occurrences
            flat = np.concatenate([*part, np.empty(0, np.uint64)])
            part.clear()
            flat.sort()
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, int)
            both.append((flat[first], np.diff(np.append(first, len(flat)))))
            own = np.union1d(own, flat[first])
        neg, pos = (np.zeros(len(own)), np.zeros(len(own)))
        for values, (found, n) in zip((neg, pos), both, strict=True):
            values[np.searchsorted(own, found)] = n
        z = _separation(pos, neg, n_pos, n_neg)
        best = np.sort(np.argsort(-z, kind="stable")[:MAX_FEATURES])
        best = best[z[best] > 0]
        self.hashes, self.ratios, self._find = own[best], _log_ratio(pos, neg, n_pos, n_neg)[best], None
        self.weights = np.zeros(len(best))

    def fit(self, texts: list[str | None], y: np.ndarray, weight: np.ndarray | None = None) -> GramModel:
        """Choose features and fit their coefficients. With one label only, every text gets its (smoothed) share."""
        y = np.asarray(y, float)
        weight = np.ones(len(y)) if weight is None else weight
        share = float((weight * y).sum() + 0.5) / float(weight.sum() + 1)
        self.intercept = float(np.log(share / (1 - share)))
        if 0 < y.sum() < len(y):
            self.choose(texts, y)
            if len(self.hashes):
                self.weights, self.intercept = fit_logistic([self.features(t) for t in texts], self.ratios, y, weight)
        return self


@dataclass
class WordModel:
    """What each kept word (as white space separates them) adds to the logit of a text that has it."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def logit(self, text: str | None) -> float:
        known = self.weights.get
        return self.intercept + float(sum(sorted([v for w in set((text or "").split()) if (v := known(w)) is not None])))

    def fit(self, texts: list[str | None], y: np.ndarray, weight: np.ndarray | None = None) -> WordModel:
        """Keep the words that separate the labels best and fit their coefficients. With one label only, every text gets its (smoothed) share."""
        y = np.asarray(y, float)
        weight = np.ones(len(y)) if weight is None else weight
        share = float((weight * y).sum() + 0.5) / float(weight.sum() + 1)
        self.weights, self.intercept = {}, float(np.log(share / (1 - share)))
        n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
        if not n_pos or not n_neg:
            return self
        own = [set((t or "").split()) for t in texts]
        both: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
        for words, label in zip(own, y.tolist(), strict=True):
            both[int(label)].update(words)
        names = sorted(w for w in both[0] | both[1] if both[0][w] + both[1][w] >= LEAST_TEXTS)
        neg, pos = (np.array([c[w] for w in names], float) for c in both)
        z = _separation(pos, neg, n_pos, n_neg)
        best = np.sort(np.argsort(-z, kind="stable")[:MAX_FEATURES])
        best = best[z[best] > 0]
        place = {names[k]: i for i, k in enumerate(best.tolist())}
        ratios = _log_ratio(pos, neg, n_pos, n_neg)[best]
        if len(best):
            x = [np.array(sorted(place[w] for w in words if w in place), np.int32) for words in own]
            coefficients, self.intercept = fit_logistic(x, ratios, y, weight)
            self.weights = {w: float(ratios[i] * coefficients[i]) for w, i in place.items()}
        return self


def sigmoid(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, steps: int = 25) -> np.ndarray:
    """Coefficients, the intercept last, of a logistic regression on a dense matrix, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-3
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
