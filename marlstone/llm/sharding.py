"""Sharding by a hypergeometric communication matrix.

A uniform shuffle with exact shard sizes: rows are dealt into source groups, the number
of rows that each group sends to each block of a shard is drawn from the multivariate
hypergeometric law, each group is permuted locally and cut accordingly, the rows are
exchanged, and each block is permuted again.  Blocks cut a shard so that no task has to
hold a whole one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh

#: Rows aimed at in a source group and in a block; the counts of both are bounded, so that the
#: matrix has at most GROUPS * shards * BLOCKS entries (84 MB) whatever the size of the table.
#: Beyond 400 million rows a group has more rows, which Spark sorts with spilling.
GROUP_ROWS, BLOCK_ROWS, GROUPS, BLOCKS = 100_000, 250_000, 4096, 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw; the library's sampler up to its limit, inversion around the mode beyond."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    total, low, high = good + bad, max(0, draws - bad), min(good, draws)
    mean = draws * good / total
    deviation = math.sqrt(max(1.0, mean * (bad / total) * (total - draws) / max(1, total - 1)))
    low, high = max(low, int(mean - 40 * deviation)), min(high, int(mean + 40 * deviation) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Counts with the given margins, as a uniform random permutation would give them."""
    rng, left = np.random.default_rng(seed), np.array(columns, np.int64)
    out, total = np.zeros((len(rows), len(columns)), np.int64), int(left.sum())
    for i, n in enumerate(rows):
        if total < 1_000_000_000:  # the library's limit
            out[i] = rng.multivariate_hypergeometric(left, n, method="marginals")
        else:
            rest, draws = total, n
            for j, size in enumerate(left.tolist()):
                if not draws:
                    break
                out[i, j] = k = hypergeometric(rng, size, rest - size, draws)
                rest, draws = rest - size, draws - k
        left -= out[i]
        total -= n
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def uniform_shards(df: DataFrame, key: list[str], shards: int = 40, seed: int = 20_240_601, group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with shard (0 to shards - 1, row counts at most one apart) and slot (gapless from 0 in each shard).

    ``key`` orders the rows reproducibly: the same rows and seed give the same result however
    the input is partitioned.  Rows equal in the whole key are interchangeable, and are given
    different slots.  Nulls in the key are values like others, and texts of any length travel
    whole.  An empty table gives an empty table; with fewer rows than shards, the later shards
    stay empty.  Columns of ``df`` called shard or slot give way.
    """
    group, rank, dest, place, cuts = fresh(df.columns, "group__", "rank__", "dest__", "place__", "cuts__")
    total = df.count()
    groups = min(GROUPS, max(1, math.ceil(total / group_rows)))
    blocks = min(BLOCKS, max(1, math.ceil(total / shards / block_rows)))
    keys = [F.col(f"`{k}`") for k in key]
    dealt = df.drop(*(c for c in df.columns if c.lower() in ("shard", "slot"))).withColumn(group, F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(groups)).cast("int"))
    counts = {r[0]: r[1] for r in dealt.groupBy(group).count().collect()}
    sizes = even(total, shards)
    block_sizes = [n for size in sizes for n in even(size, blocks)]
    matrix = communication_matrix([counts.get(i, 0) for i in range(groups)], block_sizes, seed)
    upto = np.cumsum(matrix, axis=1)
    first = np.concatenate([np.concatenate([[0], np.cumsum(even(size, blocks))[:-1]]) for size in sizes])

    spark = df.sparkSession
    lists = pa.ListArray.from_arrays(np.arange(groups + 1, dtype=np.int32) * len(block_sizes), upto.ravel())
    table = spark.createDataFrame(pa.table({group: pa.array(np.arange(groups, dtype=np.int32)), cuts: lists}))
    table = F.broadcast(table) if groups * len(block_sizes) <= 4 * BROADCAST_ROWS else table

    local = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed + 1), *keys), *keys)
    ranked = dealt.withColumn(rank, F.row_number().over(local) - 1).join(table, group)
    # The block whose range has the rank: first the shard by its last cut, then the block within it.
    shard = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda s: F.element_at(cuts, s * blocks)), lambda c: c <= F.col(rank)))
    ranked = ranked.withColumn("shard", shard)
    within = F.size(F.filter(F.slice(cuts, F.col("shard") * blocks + 1, blocks), lambda c: c <= F.col(rank)))
    sent = ranked.withColumn(dest, (F.col("shard") * blocks + within).cast("int")).drop(group, rank, cuts)

    again = Window.partitionBy(dest).orderBy(F.xxhash64(F.lit(seed + 2), *keys), *keys)
    placed = sent.withColumn(place, F.row_number().over(again) - 1)
    offsets = F.element_at(F.lit([int(x) for x in first]).cast("array<long>"), F.col(dest) + 1)
    return placed.withColumn("slot", (F.col(place) + offsets).cast("long")).drop(dest, place)
