"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good; web text without a label is a mixture of good and bad.
A linear model minimises the non-negative unbiased risk

    prior * E_P[l(f, +1)] + max(0, E_U[l(f, -1)] - prior * E_P[l(f, -1)]),

with logistic loss l and a class prior estimated from the same two samples: the least ratio,
over the scores' upper tails, of the unlabelled share to the positive share.  No negative
label is used.  Inputs are shares of a text that follow from its form alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_arrow, by_bytes, discard, fresh, held_out, labelled_sample, lower_ascii, eights, span_hash, stored, utf8_slices, words_of

SHAPES, CHUNK = 192, 1_000_000

# Classes of bytes: letters small and large, digits; others stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[97:123] = _KIND[128:] = ord("a")
_KIND[65:91] = ord("A")
_KIND[48:58] = ord("0")

_STATS = 12


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of shares for each text: hashed word shapes, and statistics of repetition and of characters."""
    n = len(offsets) - 1
    out = np.zeros((n, SHAPES + _STATS), np.float32)
    start, stop, row = words_of(raw, offsets)
    words = np.bincount(row, minlength=n).astype(np.float64)
    per_word, size = 1.0 / np.maximum(words, 1), np.maximum(np.diff(offsets), 1)
    share = lambda rows: np.bincount(rows, minlength=n) * per_word

    kind = _KIND[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[start] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    shape = span_hash(eights(kind[keep]), place[start], place[stop]) % np.uint64(SHAPES)
    np.add.at(out.reshape(-1), row * out.shape[1] + shape.astype(np.int64), per_word[row].astype(np.float32))

    word = span_hash(eights(lower_ascii(raw)), start, stop)
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((word, row))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
    single = stop - start == 1
    solid = _KIND[raw[start]] if len(start) else np.zeros(0, np.uint8)
    letters, upper, digit = kind == ord("a"), kind == ord("A"), kind == ord("0")
    at = np.repeat(np.arange(n), np.diff(offsets))
    per_byte = lambda mask: np.bincount(at[mask], minlength=n) / size
    symbol = ~(letters | upper | digit) & (raw > 32)
    stats = [
        share(row[same]),
        np.where(words > 0, 1 - np.bincount(row[order][new], minlength=n) * per_word, 0) ** 2,
        share(row[single & ~np.isin(solid, [ord("a"), ord("A"), ord("0")])]),
        per_byte(upper),
        per_byte(digit),
        per_byte(symbol),
        per_byte(raw == 10),
        per_byte(letters),
        np.minimum(np.bincount(row, weights=stop - start, minlength=n) * per_word / 20, 3),
        np.log1p(words) / 10,
        words == 0,
        per_byte(symbol) ** 2,
    ]
    out[:, SHAPES:] = np.stack(stats, 1)
    return out


def all_features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    parts = [features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in by_bytes(offsets, CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, SHAPES + _STATS), np.float32)


@dataclass
class PositiveUnlabelled:
    weights: np.ndarray
    bias: float
    scale: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _logistic(np.clip(x / self.scale, -8, 8) @ self.weights + self.bias)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def risk(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float]:
    """The two terms of the risk: of the positives, and of the unseen negatives as estimated."""
    fp, fu = _logistic(p @ w + b), _logistic(u @ w + b)
    return -prior * np.log(fp + 1e-12).mean(), -np.log(1 - fu + 1e-12).mean() + prior * np.log(1 - fp + 1e-12).mean()


def risk_gradient(p: np.ndarray, u: np.ndarray, w: np.ndarray, b: float, prior: float) -> np.ndarray:
    """Of the sum of both terms; where the second is negative, the way back up for it alone."""
    fp, fu = _logistic(p @ w + b), _logistic(u @ w + b)
    if risk(p, u, w, b, prior)[1] >= 0:
        cp, cu = (prior * (fp - 1) - prior * fp) / len(p), fu / len(u)
    else:
        cp, cu = prior * fp / len(p), -fu / len(u)
    return np.append(p.T @ cp + u.T @ cu, cp.sum() + cu.sum())


def minimise_risk(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Non-negative unbiased risk with logistic loss, by Adam on the whole sample; where the estimated
    risk of the unseen negatives turns negative, the step undoes it."""
    w, b = np.zeros(p.shape[1]), 0.0
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        g = risk_gradient(p, u, w, b, prior) + decay * np.append(w, 0)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def estimate_prior(p: np.ndarray, u: np.ndarray, confidence: float = 0.01) -> float:
    """Share of positives in the unlabelled scores: the least upper bound of tail(u) / tail(p) over thresholds."""
    slack = math.sqrt(math.log(4 / confidence) / 2)
    bound_u, bound_p = slack / math.sqrt(len(u)), slack / math.sqrt(len(p))
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    tail_p = 1 - np.searchsorted(np.sort(p), cuts) / len(p)
    tail_u = 1 - np.searchsorted(np.sort(u), cuts) / len(u)
    best = np.argmin((tail_u + bound_u) / np.maximum(tail_p - bound_p, 1e-3) + (tail_p < 2 * bound_p) * 9)
    return float(np.clip(tail_u[best] / max(tail_p[best], 1e-3), 0.02, 0.98))


def _collect(sample: DataFrame) -> np.ndarray:
    def run(batches):
        for batch in batches:
            x = all_features(*utf8_slices(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    rows = sorted(bytes(r) for r in sample.select("text").mapInArrow(run, "x binary").toPandas()["x"])
    return np.frombuffer(b"".join(rows), np.float32).reshape(-1, SHAPES + _STATS).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_positive: int = 8_000, max_unlabelled: int = 16_000, seed: int = 3) -> PositiveUnlabelled:
    """A model from trusted positives (label 1 outside the held-out fold) and documents without a label.

    At most about ``max_positive`` and ``max_unlabelled`` documents are used, seeded samples
    where there are more, whole texts each.  Without positives every score is 0.5; without
    unlabelled text the prior is 0.98.  Rows with a null id or text, or a null label, take no
    part; of rows that share an id the smallest text counts as positive.  ``docs`` needs
    columns doc_id and text, ``labels`` doc_id and ``label``; others are not read.
    """
    width = SHAPES + _STATS
    positives = labelled_sample(docs, labels.filter(F.col(label) == 1), label, max_positive, seed)
    p = _collect(positives)
    discard(positives)
    if not len(p):
        return PositiveUnlabelled(np.zeros(width), 0.0, np.ones(width), 0.5)
    fold = docs.select("doc_id", F.col("text").cast("string").alias("text")).dropna().filter(~held_out("doc_id"))
    named = labels.select("doc_id").dropna().distinct()
    n = fold.select("doc_id").join(named, "doc_id", "left_anti").count()
    if n > max_unlabelled:
        fold = fold.filter(F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(1_000_000_000)) < int(1e9 * max_unlabelled / n))
    unlabelled = stored(fold.join(named, "doc_id", "left_anti").select("text"), "unlabelled")
    u = _collect(unlabelled)
    discard(unlabelled)
    if not len(u):
        u = p
    scale = np.concatenate([p, u]).std(0) + 1e-2
    p, u = np.clip(p / scale, -8, 8), np.clip(u / scale, -8, 8)
    w, b = minimise_risk(p, u, 0.5, steps=150)
    prior = estimate_prior(p @ w + b, u @ w + b)
    w, b = minimise_risk(p, u, prior)
    return PositiveUnlabelled(w, b, scale, prior)


def score_quality(docs: DataFrame, model: PositiveUnlabelled, text: str = "text", threshold: float = 0.3, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score (0 to 1, higher is better) and predicted (score >= threshold), under ``names``.

    Whole texts of any length are scored; null and empty texts get the score of the features'
    zeros (and of the feature that says so).  Repeated rows stay repeated; an empty table gives
    an empty table; columns of ``docs`` that have one of ``names`` give way.
    """

    def make():
        def work(column):
            score = model.score(all_features(*utf8_slices(column)))
            return pa.array(score), pa.array((score >= threshold).astype(np.int32))

        return work

    return append_arrow(docs, [text], [(names[0], "double"), (names[1], "int")], make, keep)


def without_junk(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that a model learnt from ``labels`` calls good, with their own columns.

    Every row is decided by its text: null and empty ones alike, repeated ones alike.  Without
    trusted positives nothing is known against a row, and all stay.
    """
    names = fresh(docs.columns, "score", "predicted")
    scored = score_quality(docs, fit(docs, labels), threshold=threshold, names=tuple(names))
    return scored.filter(F.col(names[1]) == 1).drop(*names)
