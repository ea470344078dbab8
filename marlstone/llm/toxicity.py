"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their prefixes of three to eight bytes, as
64-bit hashes; a document has a term or not.  The score is the logistic function of

    w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,

so a pair of terms can count for more, or less, than its two terms.  The terms of the model
are those whose class counts differ beyond chance, and the most frequent ones, with which
others can interact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_arrow, by_bytes, discard, distinct, fresh, labelled_sample, lower_ascii, mix64, eights, span_hash, utf8_slices

PREFIXES = (3, 4, 5, 6, 7, 8)
CHUNK = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class FactorizationMachine:
    """Bounded by ``most_terms`` of :func:`fit`: hashes (sorted), bias, weights, factors."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray


def terms_of(raw: np.ndarray, offsets: np.ndarray):
    """Pairs of arrays (row, 64-bit term), for the words and then for each prefix length."""
    raw = lower_ascii(raw)
    letter = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last[:-1] &= ~letter[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    hashes = eights(raw)
    yield row, span_hash(hashes, start, stop)
    for n in PREFIXES:
        longer = stop - start > n
        row, start, stop = row[longer], start[longer], stop[longer]
        # A prefix is another term than the word of the same bytes.
        yield row, span_hash(hashes, start, start + n) ^ np.uint64(0x5851F42D4C957F2D)


def _class_counts(batches):
    """Documents that have each term, by class, summed over a task's batches."""
    for batch in batches:
        raw, offsets = utf8_slices(batch.column(0))
        y = batch.column(1).to_numpy(zero_copy_only=False)
        seen = []
        for a, b in by_bytes(offsets, CHUNK):
            part = raw[offsets[a] : offsets[b]]
            for r, t in terms_of(part, offsets[a : b + 1] - offsets[a]):
                once = np.unique(t ^ mix64(r.astype(np.uint64)), return_index=True)[1]
                seen.append((r[once] + a, t[once]))
        if seen:
            rows = np.concatenate([r for r, _ in seen])
            terms, at = np.unique(np.concatenate([t for _, t in seen]), return_inverse=True)
            positive = np.bincount(at, weights=y[rows] > 0, minlength=len(terms)).astype(np.int64)
            df = np.bincount(at, minlength=len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df), pa.array(positive)], ["term", "df", "positive"])


class _Lookup:
    """Index of 64-bit terms; a bitmap turns most misses away."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(terms >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = self.maybe[(term >> np.uint64(42)).astype(np.int64)]
        row, term = row[hit], term[hit]
        at = np.searchsorted(self.terms, term)
        at[at == len(self.terms)] = 0
        right = self.terms[at] == term if len(self.terms) else np.zeros(len(term), bool)
        return row[right], at[right]


def active(lookup: _Lookup, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term index) pairs, in order."""
    rows, terms = [], []
    for a, b in by_bytes(offsets, CHUNK):
        for row, term in terms_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
            row, at = lookup(row + a, term)
            rows.append(row)
            terms.append(at)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = max(1, len(lookup.terms))
    both = distinct(np.concatenate(rows) * size + np.concatenate(terms))
    return both // size, both % size


def margins(model: FactorizationMachine, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
    """w0 + linear + pairwise part for rows 0 to n - 1."""
    square = (model.factors**2).sum(1)
    out = model.bias + np.bincount(row, weights=(model.weights - 0.5 * square)[term], minlength=n)
    for f in range(model.factors.shape[1]):
        out += 0.5 * np.bincount(row, weights=model.factors[term, f], minlength=n) ** 2
    return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[np.ndarray], y: np.ndarray, size: int, rank: int = 8, epochs: int = 12, steps: int = 800, rate: float = 0.1, decay: float = 1e-4, batch: int = 128, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss by AdaGrad over shuffled batches of rows of active terms: ``epochs`` passes, and ``steps`` batches at least."""
    rng = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    bias, w, v = math.log(share / (1 - share)), np.zeros(size), rng.normal(0, 0.01, (size, rank))
    gw, gv, gb = np.full(size, 1e-6), np.full((size, rank), 1e-6), 1e-6
    for _ in range(max(epochs, -(-steps * batch // max(1, len(rows))))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            take = order[at : at + batch]
            n = np.array([len(rows[i]) for i in take])
            term, row = np.concatenate([rows[i] for i in take]), np.repeat(np.arange(len(take)), n)
            vt = v[term]
            sums = np.stack([np.bincount(row, weights=vt[:, f], minlength=len(take)) for f in range(rank)], 1)
            score = bias + np.bincount(row, weights=w[term] - 0.5 * (vt**2).sum(1), minlength=len(take)) + 0.5 * (sums**2).sum(1)
            error = (logistic(score) - y[take]) / len(take)
            touched, where = np.unique(term, return_inverse=True)
            g = np.bincount(where, weights=error[row], minlength=len(touched)) + decay * w[touched]
            h = np.stack([np.bincount(where, weights=error[row] * (sums[row, f] - vt[:, f]), minlength=len(touched)) for f in range(rank)], 1) + decay * v[touched]
            gw[touched] += g**2
            gv[touched] += h**2
            w[touched] -= rate * g / np.sqrt(gw[touched])
            v[touched] -= 0.2 * rate * h / np.sqrt(gv[touched])
            step = error.sum()
            gb += step**2
            bias -= rate * step / math.sqrt(gb)
    return bias, w, v


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 20_000, most_terms: int = 16_384, frequent: int = 1_024, rank: int = 8, seed: int = 5) -> FactorizationMachine:
    """A model learnt from ``labels`` (doc_id, label) outside the held-out fold.

    At most about ``max_rows`` labelled documents are used (a seeded sample where there are
    more), whole texts each; the model has at most ``most_terms`` terms.  With no labelled
    rows, or one class alone, the score is a constant.  Rows with a null id, text or label take
    no part; of rows that share an id the smallest text and the largest label count.  ``docs``
    needs columns doc_id and text, ``labels`` doc_id and ``label``; others are not read.
    """
    sample = labelled_sample(docs, labels, label, max_rows, seed)
    y_n = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    n, n1 = int(y_n[0]), int(y_n[1])
    if not n or not n1 or n1 == n:
        share = (n1 + 0.5) / (n + 1.0) if n else 0.0
        return FactorizationMachine(np.zeros(0, np.uint64), math.log(share / (1 - share)) if share else -40.0, np.zeros(0), np.zeros((0, rank)))
    counts = sample.mapInArrow(_class_counts, "term long, df long, positive long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("positive").alias("k"))
    counts = counts.filter("df >= 3")
    # The likelihood-ratio statistic of the two-by-two table of term and class.
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    df, k, rest = F.col("df"), F.col("k"), n - n1
    g = 2 * (cell(k, df * n1 / n) + cell(df - k, df * rest / n) + cell(n1 - k, (n - df) * n1 / n) + cell(rest - df + k, (n - df) * rest / n))
    counts = counts.select("term", "df", g.alias("g")).persist()
    tested = counts.count()
    telling = counts.filter(F.col("g") >= 2 * math.log(tested + 1)).orderBy(F.desc("g"), "term").limit(most_terms - frequent).select("term")
    # Frequent terms without a difference of their own: only as many as the rarer class can bear.
    common = counts.orderBy(F.desc("df"), "term").limit(min(frequent, min(n1, n - n1) // 2)).select("term")
    terms = np.unique(telling.union(common).toPandas()["term"].to_numpy(np.int64).view(np.uint64))
    counts.unpersist()

    def encode(batches):
        lookup = _Lookup(terms)
        for batch in batches:
            raw, offsets = utf8_slices(batch.column(0))
            row, term = active(lookup, raw, offsets)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            packed = [term[a:b].astype(np.uint16).tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1)], ["packed", "y"])

    rows = sample.mapInArrow(encode, "packed binary, y int").toPandas()
    rows["packed"] = rows["packed"].map(bytes)
    rows = rows.sort_values(["packed", "y"], ignore_index=True)  # the same order however tasks end
    discard(sample)
    bias, w, v = train([np.frombuffer(p, np.uint16).astype(np.int64) for p in rows["packed"]], rows["y"].to_numpy(np.float64), len(terms), rank, seed=seed)
    return FactorizationMachine(terms, bias, w, v)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text: str = "text", threshold: float = 0.5, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score (0 to 1) and predicted (score >= threshold), under ``names``.

    Whole texts of any length are scored.  A null or empty text, or one without known terms,
    gets the score of the bias alone.  Repeated rows stay repeated; an empty table gives an
    empty table; columns of ``docs`` that have one of ``names`` give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most most_terms * (rank + 2) numbers

    def make():
        machine = shared.value
        lookup = _Lookup(machine.terms)

        def work(column):
            raw, offsets = utf8_slices(column)
            row, term = active(lookup, raw, offsets)
            score = logistic(margins(machine, len(column), row, term))
            return pa.array(score), pa.array((score >= threshold).astype(np.int32))

        return work

    return append_arrow(docs, [text], [(names[0], "double"), (names[1], "int")], make, keep)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that a model learnt from ``labels`` does not call toxic, with their own columns.

    Every row is decided by its text: null and empty ones alike, repeated ones alike.  Without
    labels all stay.
    """
    names = fresh(docs.columns, "score", "predicted")
    scored = score_toxicity(docs, fit(docs, labels), threshold=threshold, names=tuple(names))
    return scored.filter(F.col(names[1]) == 0).drop(*names)
