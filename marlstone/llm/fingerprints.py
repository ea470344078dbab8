"""Document fingerprints: a digest of improbable features.

Every window of 64 bytes has an entropy; how rare its entropy class is among all windows of
the corpus gives its rank, the rarest first.  In each run of 64 neighbouring windows the one
of least rank (the leftmost of equals) gets a point; windows with ``POINTS`` points or more
are the features.  Features go in order of place into Bloom filters of 2,048 bits, five bits
each, a new filter for every ``PER_FILTER`` features.  Two digests are alike by the overlap of
their filters' bits, from what chance gives (0) to the most there can be (1).
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, eights, fresh, small_batches, span_hash, utf8_slices

WINDOW, RUN, POINTS, PER_FILTER, BITS, CLASSES = 64, 64, 16, 160, 2_048, 1_001
#: Where fewer than FEW windows have the points, the points asked for are halved until there are as many.
FEW = 16
#: The most ranges that the documents' order is cut into; what a range holds is streamed.
RANGES = 65_536
#: Windows of entropy class below LEAST (of 1,000) never are features: runs of one byte and the like.
LEAST = 100
REACH = WINDOW + RUN - 1
FROM, UPTO = 256, 768
CHUNK = 1_500_000

# n * log2(n) in fixed point, and its steps.
_N = np.arange(WINDOW + 1)
_NLOG = np.round(_N * np.log2(np.maximum(_N, 1)) * (1 << 16)).astype(np.int64)
_STEP = np.concatenate([[0], np.diff(_NLOG)])
_MOST = _NLOG[WINDOW]


def entropy_classes(raw: np.ndarray) -> np.ndarray:
    """0 (one byte value) to 1,000 (64 distinct ones) for each window of 64 bytes.

    Moving a window by one byte changes two counts; these are found by looking, among the
    places of each byte value, for the first one that lies 64 further on or back.
    """
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(raw, kind="stable")
    kind, shift = (np.int32, 23) if n + WINDOW < 1 << 23 else (np.int64, 40)
    place = (raw[order].astype(kind) << shift) + order.astype(kind)
    index = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    # Of the ascending places of a byte value: where the first one lies that is 64 or more ahead.
    beyond = np.searchsorted(place, place + kind(WINDOW)).astype(index.dtype)
    left = np.cumsum(np.bincount(beyond, minlength=n + 1)[:n]).astype(index.dtype)  # places 64 or more behind
    ahead, behind = np.empty(n, np.int8), np.empty(n, np.int8)
    ahead[order] = beyond - index
    behind[order] = index + 1 - left
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _NLOG[np.bincount(raw[:WINDOW], minlength=256)].sum()
    total[1:] = _STEP[behind[WINDOW:]] - _STEP[ahead[: n - WINDOW]]
    np.cumsum(total, out=total)
    return ((_MOST - total) * (CLASSES - 1)) // _MOST


def class_counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(CLASSES, np.int64)
    for a, b in by_bytes(offsets, CHUNK):
        part, cut = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        out += np.bincount(entropy_classes(part)[_inside(cut, WINDOW)], minlength=CLASSES)
    return out


def _inside(offsets: np.ndarray, size: int) -> np.ndarray:
    """Places at which a span of ``size`` bytes lies within its text."""
    n = np.maximum(np.diff(offsets) - size + 1, 0)
    return np.arange(n.sum()) + np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each class, the rarest first; classes below LEAST come last and are never chosen."""
    rank = np.empty(CLASSES, np.int64)
    rank[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    rank[:LEAST] = CLASSES
    return rank


def corpus_ranks(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Rarity ranks of the entropy classes over all windows of all documents, and the documents' bytes."""

    def run(batches):
        counts, size = np.zeros(CLASSES, np.int64), 0
        for batch in batches:
            raw, offsets = utf8_slices(batch.column(0))
            counts += class_counts(raw, offsets)
            size += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, CLASSES)), pa.array(np.append(size, counts))], ["class", "n"])

    found = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n"))
    counts = np.zeros(CLASSES + 1, np.int64)
    for r in found.collect():  # one row a class
        counts[r[0] + 1] = r[1]
    return ranks_of(counts[1:]), int(counts[0])


def _leaders(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of RUN windows, the place of the leftmost least rank, and whether it may be a feature."""
    kind, shift = (np.uint32, 22) if len(ranks) < 1 << 22 else (np.int64, 40)
    best = (ranks.astype(kind) << kind(shift)) + np.arange(len(ranks), dtype=kind)
    width = 1
    while width < RUN:
        best = np.minimum(best[:-width], best[width:]) if len(best) > width else best[:0]
        width *= 2
    return (best & kind((1 << shift) - 1)).astype(np.int64), (best >> kind(shift)) < CLASSES


def _spans(text: bytes) -> np.ndarray:
    """All spans of eight bytes of a short text (of four or two, of a very short one), the first of equals kept."""
    raw = np.frombuffer(text, np.uint8)
    size = min(len(raw), 8 if len(raw) >= 48 else 4 if len(raw) >= 12 else 2)
    start = np.arange(len(raw) - size + 1) if size else np.zeros(0, np.int64)
    return _first(span_hash(eights(raw), start, start + size))


def _first(found: np.ndarray) -> np.ndarray:
    return found[np.sort(np.unique(found, return_index=True)[1])]


def feature_lists(texts: list[bytes], ranks: np.ndarray, shared: list[tuple[int, int]] | None = None) -> list[list[np.ndarray]]:
    """Feature hashes of each text in order of place, the first of equals kept: those of windows
    (texts of FROM bytes or more), then the spans of short texts (of less than UPTO bytes).
    Texts between the two have both, so that texts of about the same length always have one in common.

    With ``shared``, entry i is (j, p): text i begins with the first p bytes of text j, which is
    listed before and whole.  What lies wholly in the shared part is then taken from text j.
    """
    shared = shared or [(-1, 0)] * len(texts)
    pieces, skip = [], []
    for text, (j, p) in zip(texts, shared):
        skip.append(max(0, p - REACH + 1) if j >= 0 and len(text) >= FROM else 0)
        pieces.append(text[skip[-1] :])
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    hashes = eights(raw)
    place, usable = _leaders(ranks[entropy_classes(raw)])
    out = []
    for i, text in enumerate(texts):
        chains = []
        if len(text) >= FROM:
            a = int(offsets[i])
            runs = slice(a, int(offsets[i + 1]) - REACH + 1)
            at = place[runs][usable[runs]] - a + skip[i]
            here = a - skip[i]
            there = int(offsets[shared[i][0]]) if skip[i] else here
            if skip[i]:  # runs wholly inside the shared part: the same as in text j
                old = slice(there, there + max(0, shared[i][1] - REACH + 1))
                at = np.concatenate([place[old][usable[old]] - there, at])
            points = np.bincount(at)
            least = POINTS
            while (chosen := np.flatnonzero(points >= least)).size < FEW and least > 1:
                least //= 2
            start = np.where(chosen >= skip[i], here, there) + chosen
            found = span_hash(hashes, start, start + WINDOW)
            if not len(found):
                found = np.array([int.from_bytes(hashlib.sha256(text).digest()[:8], "big")], np.uint64)
            chains.append(_first(found))
        if len(text) < UPTO:
            chains.append(_spans(text))
        out.append(chains)
    return out


def filters_of(chains: list[np.ndarray]) -> np.ndarray:
    """Chained Bloom filters as rows of 256 bytes."""
    return np.concatenate([np.zeros((0, BITS // 8), np.uint8), *map(_filters, chains)])


def _filters(features: np.ndarray) -> np.ndarray:
    n = math.ceil(len(features) / PER_FILTER)
    bits = np.zeros((n, BITS), bool)
    owner = np.arange(len(features)) // PER_FILTER
    for j in range(5):
        bits[owner, ((features >> np.uint64(11 * j)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter digest its best overlap with one of the other's, on average
    weighted by set bits; an overlap counts from what independent filters share to the most possible."""
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    if len(one) == len(other) and (one == other).all():
        return 1.0
    if len(one) > len(other):
        one, other = other, one
    a, b = np.bitwise_count(one).sum(1, dtype=np.int64), np.bitwise_count(other).sum(1, dtype=np.int64)
    common = np.bitwise_count(one[:, None] & other[None]).sum(2, dtype=np.int64)
    chance, most = a[:, None] * b[None] / BITS, np.minimum(a[:, None], b[None])
    score = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)
    # A filter with few features says little about a full one: its overlap counts by its share.
    score *= np.minimum(1.0, most / np.maximum(np.maximum(a[:, None], b[None]), 1)) ** 0.5
    return float((score.max(1) * a).sum() / a.sum())


def as_text(filters: np.ndarray) -> str:
    return f"{len(filters)}:" + base64.b64encode(filters.tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint.partition(":")[2]), np.uint8).reshape(-1, BITS // 8)


def edited(text: str, following: str) -> str:
    """``text`` with the last quarter replaced by the beginning of the following document."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _compare(texts: list[str], ranks: np.ndarray) -> list[tuple]:
    """For all texts but the last, which follows the one before it: the result columns."""
    changed = [edited(t, f) for t, f in zip(texts, texts[1:])]
    raw, raw_changed = [t.encode() for t in texts], [t.encode() for t in changed]
    shared = [(-1, 0)] * len(raw) + [(i, len(texts[i][: len(texts[i]) - len(texts[i]) // 4].encode())) for i in range(len(changed))]
    digests = [filters_of(f) for f in feature_lists(raw + raw_changed, ranks, shared)]
    own, new = digests[: len(raw)], digests[len(raw) :]
    return [
        (len(texts[i]), hashlib.sha256(raw_changed[i]).hexdigest(), as_text(own[i]), as_text(new[i]), likeness(own[i], new[i]), likeness(own[i], own[i + 1]))
        for i in range(len(changed))
    ]


RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


class _Ranges:
    """Ranges of the documents' order, each named by its first document: (id or None, tie)."""

    def __init__(self, heads: list[tuple]):
        heads = sorted((h[0] is not None, h[0], h[1]) for h in heads)
        known = [h for h in heads if h[0]]
        self.nulls = len(heads) - len(known)
        self.ids, self.ties = np.array([h[1] for h in known]), np.array([h[2] for h in heads], np.int64)

    def find(self, known: np.ndarray, ids: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of each document, and whether it is (or equals) the range's first."""
        n = self.nulls
        low, high = np.zeros(len(ties), np.int64), np.full(len(ties), n)
        if known.any():
            low[known] = n + np.searchsorted(self.ids, ids[known], side="left")
            high[known] = n + np.searchsorted(self.ids, ids[known], side="right")
        upto = low.copy()  # of ranges that begin with the same id, those whose tie is not greater
        for i in np.flatnonzero(high > low):
            upto[i] += np.searchsorted(self.ties[low[i] : high[i]], ties[i], side="right")
        at = np.maximum(upto - 1, 0)
        return at, (upto > low) & (self.ties[at] == ties)


def neighbour_fingerprints(docs: DataFrame, ranks: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text", part_bytes: int = 16_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are put in ascending order of doc_id (nulls first, ties by a hash of the text and
    the text) and cut into ranges of about ``part_bytes``, at most :data:`RANGES` of them; each
    range also gets the first document of the next one, the last range that of the first.
    Within a range the documents are read one after the other.  A single document follows
    itself.  Null texts are empty; an empty text has the digest without filters, like another
    empty one and unlike all others.  The features of texts of less than 256 bytes are their
    spans of eight bytes.  Texts of any length are whole; two of them are held at a time, at
    least.  Repeated rows stay repeated; an empty table gives an empty table; other columns
    of ``docs`` are not returned.
    """
    small_batches(docs.sparkSession)
    if ranks is None:
        ranks, total = corpus_ranks(docs, text)
    else:
        total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    ident, tie, at, part, look, body = fresh(RESULT, "doc_id", "tie__", "at__", "part__", "look__", "text__")
    rows = docs.select(F.col(f"`{doc_id}`").alias(ident), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body)).withColumn(tie, F.xxhash64(body))
    parts = min(RANGES, max(1, math.ceil(total / part_bytes)))
    # The first document of each range, by Spark's own range partitioning of the ids alone.
    order = F.struct(F.col(ident).isNotNull().alias("known"), F.col(ident).alias("id"), F.col(tie).alias("tie"))
    firsts = rows.select(order.alias("first"), ident, tie)
    if parts > 1:
        firsts = firsts.repartitionByRange(parts, F.col(ident).asc_nulls_first(), tie)
    by = [F.spark_partition_id()] if parts > 1 else []
    heads = {(r["first"].id, r["first"].tie) for r in firsts.groupBy(*by).agg(F.min("first").alias("first")).collect() if r["first"]}  # one a range
    ranges, n = _Ranges(list(heads)), max(1, len(heads))
    id_type = rows.schema[ident].dataType.simpleString()

    @F.pandas_udf("long")
    def place(known: pd.Series, ids: pd.Series, ties: pd.Series) -> pd.Series:
        found, first = ranges.find(known.to_numpy(bool), ids.to_numpy(), ties.to_numpy(np.int64))
        return pd.Series(2 * found + first)

    some = next((h[0] for h in heads if h[0] is not None), None)  # stands for null ids, so that their column keeps its type
    rows = rows.withColumn(at, place(F.col(ident).isNotNull(), F.coalesce(F.col(ident), F.lit(some).cast(id_type)), F.col(tie)))
    here, before = (F.struct(where.cast("int").alias(part), F.lit(flag).alias(look)) for where, flag in ((F.shiftright(at, 1), 0), (F.pmod(F.shiftright(at, 1) - 1, F.lit(n)), 1)))
    rows = rows.withColumn(at, F.explode(F.when(F.col(at) % 2 == 1, F.array(here, before)).otherwise(F.array(here))))
    sent = rows.select(ident, body, tie, f"{at}.{part}", f"{at}.{look}").repartitionById(n, F.col(part))
    sent = sent.sortWithinPartitions(part, look, F.col(ident).asc_nulls_first(), tie, body).select(ident, body, part, look)

    def run(batches):
        held: list[tuple] = []
        size, ids, ended = 0, None, None

        def flush():
            made = _compare([h[1] for h in held], ranks)
            arrays = [pa.array([h[0] for h in held[:-1]], ids), *(pa.array(c) for c in zip(*made))]
            return pa.RecordBatch.from_arrays(arrays, [ident, *RESULT])

        for batch in batches:
            ids = ids or batch.column(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2] == ended:  # the follower has come: what equals it is not needed
                    continue
                held.append(row)
                size += len(row[1])
                if row[3]:
                    ended = row[2]
                if (row[3] or size > CHUNK) and len(held) > 1:
                    yield flush()
                    held = [] if row[3] else held[-1:]
                    size = len(held[0][1]) if held else 0

    return sent.mapInArrow(run, f"{ident} {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
