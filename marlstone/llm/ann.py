"""Approximate nearest neighbours by score-aware quantisation.

The nearest vectors by Euclidean distance are those of greatest q.x - |x|^2 / 2, an inner
product with a known offset.  Vectors are coded by ``dim / 2`` four-bit codes.  Codes and
codebooks minimise an anisotropic loss: the part of the residual that is parallel to the
vector, and so shifts its greatest scores, costs more than the rest.  A search routes the
query to the partitions with the nearest centres, adds up table entries by the codes, and
reranks the best candidates of each block by exact distance on the original vectors.

The codebooks, the partitions and the number of partitions to probe come from a bounded
sample (the last one as what reached the wanted recall on it); every row is indexed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Rows of an index block and queries of a query block: the most that one task step holds.
BLOCK, QUERIES = 8_192, 2_048
#: The most vectors that an index is fitted on; there is a partition for 16 of them at most.
MOST_SAMPLE = 65_536
#: Candidates are reranked beyond the fixed number while their score is within so many standard errors.
MARGIN = 2.0


@dataclass
class Index:
    mean: np.ndarray
    centres: np.ndarray  # partitions x dim
    books: np.ndarray  # subspaces x 16 x width
    weight: float  # extra cost of the parallel residual
    probe: int

    def split(self, x: np.ndarray) -> np.ndarray:
        """Vectors cut into subspaces, filled up with zeros."""
        m, _, width = self.books.shape
        out = np.zeros((len(x), m * width))
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, width)


def _assign(x: np.ndarray, unit: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 3) -> np.ndarray:
    """Codes by coordinate descent on |r|^2 + weight * (r.u)^2, from the plain nearest centres."""
    n, m, _ = x.shape
    codes = np.empty((n, m), np.uint8)
    along = np.zeros(n)
    cost, shift = [], []
    for j in range(m):
        r = x[:, j, None] - books[j][None]
        cost.append((r**2).sum(2))
        shift.append(np.einsum("nkw,nw->nk", r, unit[:, j]))
        codes[:, j] = cost[j].argmin(1)
        along += shift[j][np.arange(n), codes[:, j]]
    for _ in range(sweeps if weight else 0):
        for j in range(m):
            rest = along - shift[j][np.arange(n), codes[:, j]]
            codes[:, j] = (cost[j] + weight * (rest[:, None] + shift[j]) ** 2).argmin(1)
            along = rest + shift[j][np.arange(n), codes[:, j]]
    return codes


def _update(x: np.ndarray, unit: np.ndarray, codes: np.ndarray, books: np.ndarray, weight: float) -> np.ndarray:
    """The codebooks of least loss for given codes: one linear system, as the parallel part ties the subspaces."""
    n, m, width = x.shape
    size = m * 16 * width
    column = ((np.arange(m)[None, :, None] * 16 + codes[:, :, None]) * width + np.arange(width)).reshape(n, -1)
    left, right = np.zeros((size, size)), np.zeros(size)
    diagonal = np.bincount(column.ravel(), minlength=size).astype(float)
    right += np.bincount(column.ravel(), weights=x.reshape(n, -1).ravel(), minlength=size)
    along = np.einsum("nmw,nmw->n", x, unit)
    for a in range(0, n, 2_048):
        v = np.zeros((len(column[a : a + 2_048]), size))
        np.put_along_axis(v, column[a : a + 2_048], unit[a : a + 2_048].reshape(len(v), -1), 1)
        left += weight * (v.T @ v)
        right += weight * (v.T @ along[a : a + 2_048])
    left[np.arange(size), np.arange(size)] += diagonal + 1e-6
    right += 1e-6 * books.ravel()
    return np.linalg.solve(left, right).reshape(books.shape)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1)[None] / 2
    return np.concatenate([(half - x[a : a + 4_096] @ centres.T).argmin(1) for a in range(0, len(x), 4_096)])


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def _order(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argsort((centres**2).sum(1)[None] / 2 - x @ centres.T, axis=1, kind="stable")


def fit(sample: np.ndarray, rows: int, threshold: float = 0.2, wanted: float = 0.98, neighbours: int = 10, seed: int = 11) -> Index:
    """An index from a sample (vectors as rows) of a table with ``rows`` rows."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    mean = sample.mean(0)
    x = sample - mean
    width = 2
    m = -(-dim // width)
    # The parallel weight for inner products above threshold * |x|, as in the published derivation.
    weight = max(0.0, (dim - 1) * threshold**2 / (1 - threshold**2) - 1)
    index = Index(mean, np.zeros((1, dim)), np.zeros((m, 16, width)), weight, 1)
    parts = index.split(x)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None, None]
    some = rng.choice(len(x), 16, replace=len(x) < 16)
    index.books = np.stack([_k_means(parts[:, j], 16, rng) if len(x) >= 16 else parts[some, j] for j in range(m)])
    for _ in range(3):
        index.books = _update(parts, unit, _assign(parts, unit, index.books, weight), index.books, weight)
    k = int(min(max(1, round(math.sqrt(rows) / 4)), max(1, len(x) // 16)))
    if k > 1:
        index.centres = _k_means(x, k, rng)
        # Partitions to probe: by the sample's own neighbours.
        q, true = x[: min(500, len(x))], []
        for a in range(0, len(q), 50):
            far = (x**2).sum(1)[None] - 2 * q[a : a + 50] @ x.T
            far[np.arange(len(far)), a + np.arange(len(far))] = np.inf
            true.append(np.argsort(far, axis=1)[:, :neighbours])
        true, home = np.concatenate(true), _nearest(x, index.centres)
        place = np.argsort(_order(q, index.centres), axis=1)  # rank of each partition for each query
        index.probe = int(np.quantile(np.take_along_axis(place, home[true], 1).ravel(), wanted)) + 1
    return index


def _matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def scan(index: Index, queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int, rerank: int):
    """(query_id, vec_id, distance) of the k nearest found of each query in one block.

    Equal vectors are scanned once, each for its k + 1 smallest ids, so copies cannot crowd out others.
    """
    order = np.argsort(ids, kind="stable")
    vectors, ids, codes = vectors[order], ids[order], codes[order]
    key = np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").ravel()
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    copies = np.argsort(which, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(which))])
    one, few = vectors[first], codes[first]
    offset = (((one - index.mean) ** 2).sum(1) / 2).astype(np.float32)
    m = few.shape[1]
    nearest = min(rerank, len(first))
    # The standard error of a score: that of the residual's product with a vector of length one.
    error = np.linalg.norm(index.split(one - index.mean) - index.books[np.arange(m)[None], few], axis=(1, 2)) / math.sqrt(one.shape[1])
    # Which copies come along with each distinct vector.
    take = [copies[a : min(b, a + k + 1)] for a, b in zip(at, at[1:])]
    n_take = np.array([len(x) for x in take])
    flat, cut = np.concatenate(take), np.concatenate([[0], np.cumsum(n_take)])
    out = []
    for a in range(0, len(queries), 128):
        q = queries[a : a + 128]
        tables = np.einsum("qmw,mkw->mqk", index.split(q - index.mean), index.books).astype(np.float32)
        score = np.repeat(offset[None], len(q), 0)
        for j in range(m):
            score -= tables[j][:, few[:, j]]
        reach = np.linalg.norm(q - index.mean, axis=1)
        best = np.argpartition(score, nearest - 1, axis=1)[:, :nearest] if nearest < len(first) else np.repeat(np.arange(len(first))[None], len(q), 0)
        for i in range(len(q)):
            some = best[i]
            distance = np.sqrt(((one[some] - q[i]) ** 2).sum(1))
            if nearest < len(first):  # and all whose score may hide, within its error, a distance below the k-th so far
                furthest = np.sort(np.repeat(distance, n_take[some]))[k : k + 1]
                limit = (furthest[0] ** 2 - reach[i] ** 2) / 2 if len(furthest) else np.inf
                more = np.setdiff1d(np.flatnonzero(score[i] <= limit + MARGIN * reach[i] * error), some)
                distance = np.concatenate([distance, np.sqrt(((one[more] - q[i]) ** 2).sum(1))])
                some = np.concatenate([some, more])
            member = np.concatenate([flat[cut[s] : cut[s + 1]] for s in some])
            distance = np.repeat(distance, n_take[some])
            keep = ids[member] != query_ids[a + i]
            member, distance = member[keep], distance[keep]
            top = np.lexsort((ids[member], distance))[:k]
            out.append((np.full(len(top), query_ids[a + i]), ids[member[top]], distance[top]))
    return [np.concatenate(c) for c in zip(*out)]


def nearest(vectors: DataFrame, k: int = 10, query_every: int = 100, max_sample: int = 8_000, rerank: int = 128, wanted: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by ``query_every``, its k nearest found.

    score is the Euclidean distance in double precision on the original vectors; nearest
    first, ties to the smaller vec_id.  Rows with a null id, and vectors that are null, zero,
    or hold null or non-finite components, take no part, nor do vectors of another length than
    the most frequent one (the shortest of several), to which no distance is defined.  A
    repeated id is searched once, with the first of its vectors in their order, and as candidate
    stands for each of its rows.  With fewer candidates than k, all are returned; an empty table
    gives an empty table; other columns of ``vectors`` are not returned.

    The index is fitted on about ``max_sample`` vectors, or 4 * sqrt(rows) if that is more, at
    most MOST_SAMPLE; there are sqrt(rows) / 4 partitions as long as the sample bears them.
    Every row is coded once, in a stored table.  A partition is searched block by block, each
    by up to QUERIES queries at a time, with the vectors beside the codes: a block has the few
    that a query's reranking wants, where fetching them later would move each for each query.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col("x")
    usable = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("x")).filter("id is not null and x is not null")
    usable = usable.filter(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0))
    lengths = usable.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "query_id long, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = lengths
    usable = usable.filter(F.size(x) == dim)
    drawn = usable.select("id", "x")
    size = min(MOST_SAMPLE, max(max_sample, math.ceil(4 * math.sqrt(rows))))
    if rows > size:
        drawn = drawn.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000_000)) < int(1e9 * size / rows))
    drawn = drawn.dropDuplicates(["x"]).orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(2 * size).select("x").toPandas()
    index = fit(np.stack(drawn["x"].to_numpy()), rows, wanted=wanted, neighbours=k, seed=seed)
    shared = spark.sparkContext.broadcast(index)

    def place(batches):
        own = shared.value
        for batch in batches:
            v = _matrix(batch.column(1))
            part = ((own.centres**2).sum(1)[None] / 2 - (v - own.mean) @ own.centres.T).argmin(1)
            c = own.split(v - own.mean)
            u = c / np.maximum(np.linalg.norm(v - own.mean, axis=1), 1e-12)[:, None, None]
            codes = np.concatenate([_assign(c[a : a + 2_048], u[a : a + 2_048], own.books, own.weight) for a in range(0, len(c), 2_048)]) if len(c) else np.zeros((0, c.shape[1]), np.uint8)
            if codes.shape[1] % 2:
                codes = np.pad(codes, ((0, 0), (0, 1)))
            packed = codes[:, 0::2] | (codes[:, 1::2] << 4)  # two codes a byte
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32)), pa.array([p.tobytes() for p in packed], pa.binary())], ["id", "x", "part", "code"])

    placed = stored(usable.mapInArrow(place, "id long, x array<double>, part int, code binary"), "placed")
    counts = {r[0]: r[1] for r in placed.groupBy("part").count().collect()}  # one row a partition
    sizes = np.array([counts.get(i, 0) for i in range(len(index.centres))])
    blocks = np.maximum(1, -(-sizes // BLOCK))

    def route(batches):
        own = shared.value
        for batch in batches:
            v = _matrix(batch.column(1))
            if not len(v):
                continue
            order = _order(v - own.mean, own.centres)
            enough = (np.cumsum(sizes[order], axis=1) >= k + 1).argmax(1) + 1  # as many as hold k others
            enough[sizes.sum() < k + 1] = len(sizes)
            query, part = [], []
            for i, n in enumerate(np.maximum(own.probe, enough)):
                query.append(np.full(n, i))
                part.append(order[i, :n])
            query, part = np.concatenate(query), np.concatenate(part)
            n = blocks[part]
            block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            query, part = np.repeat(query, n), np.repeat(part, n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(query)), batch.column(1).take(pa.array(query)), pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32))], ["id", "x", "part", "block"])

    asked = usable.filter(F.col("id") % query_every == 0)
    asked = asked.groupBy("id").agg(F.min("x").alias("x"))
    routed = asked.mapInArrow(route, "id long, x array<double>, part int, block int")
    per_part = {r[0]: r[1] for r in routed.filter("block = 0").groupBy("part").count().collect()}
    lots = np.array([max(1, -(-per_part.get(i, 0) // QUERIES)) for i in range(len(sizes))])
    table = lambda a: F.lit([int(v) for v in a]).cast("array<int>")
    of = lambda a: F.element_at(table(a), F.col("part") + 1)
    routed = routed.withColumn("lot", F.pmod(F.xxhash64("id"), of(lots)).cast("int"))
    held = placed.withColumn("block", F.pmod(F.xxhash64("id"), of(blocks)).cast("int"))
    held = held.withColumn("lot", F.explode(F.sequence(F.lit(0), of(lots) - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own = shared.value
        packed = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(right.num_rows, -1)[:, : own.books.shape[0]]
        found = scan(own, _matrix(left.column("x")), left.column("id").to_numpy(), _matrix(right.column("x")), right.column("id").to_numpy(), codes, k, rerank)
        return pa.table(dict(zip(["query_id", "vec_id", "score"], found)))

    key = ["part", "block", "lot"]
    found = routed.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(search, result)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
