"""Relational operators on DataFrames with internal column names; Catalyst picks the physical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import aggregates_in, to_aggregate, to_column
from ..plans import binder as B


def scan(table: DataFrame, source: B.Source) -> DataFrame:
    """The table under the statement's internal names; unused columns are pruned down to the file scan."""
    return table.select(*(F.col(f"`{name}`").alias(c.id) for name, c in zip(table.columns, source.columns)))


#: Without an equality between its sides, a join compares all pairs.  Where the product of the sides' bytes, as
#: Spark estimates them, is more than the first figure, sides of at most the second are dealt out over the cores:
#: a table of few row groups would leave all pairs to as few tasks.
PAIR_BYTES, SMALL_SIDE = 100_000_000, 64_000_000

#: Rows of a block; the most bytes, as estimated, of a side whose blocks are sent to all tasks; more partitions than any
#: DataFrame has.
BLOCK_ROWS, SENT_SIDE, ANY = 256, 8_000_000, 1_000_000


def columns_in(e: B.Bound | None) -> set[str]:
    if isinstance(e, B.AggregateCall):
        return columns_in(e.argument)
    return {e.id} if isinstance(e, B.Column) else {c for x in getattr(e, "operands", ()) for c in columns_in(x)}


def _equates(on: B.Bound, left: set[str]) -> bool:
    """Whether a conjunct equates one side with the other."""
    if not isinstance(on, B.Call) or on.op not in ("and", "="):
        return False
    if on.op == "and":
        return any(_equates(x, left) for x in on.operands)
    one, other = map(columns_in, on.operands)
    return bool(one and other) and (one <= left and not other & left or other <= left and not one & left)


def _compared(on: B.Bound, left: set[str]) -> list[B.Call]:
    """The conjuncts that hold a column of the left side below or above one of the right."""
    if not isinstance(on, B.Call) or on.op not in ("and", "<", "<=", ">", ">="):
        return []
    if on.op == "and":
        return [c for x in on.operands for c in _compared(x, left)]
    one, other = on.operands
    if not isinstance(one, B.Column) or not isinstance(other, B.Column) or (one.id in left) == (other.id in left):
        return []
    return [on if one.id in left else B.Call(on.type, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[on.op], (other, one))]


def _bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _sortable(df: DataFrame) -> bool:
    return not df.isStreaming and not any("map<" in t or "variant" in t for _, t in df.dtypes)


def _blocks(df: DataFrame, by: list[str], name: str, tasks: int) -> DataFrame:
    """Rows that are near each other in the order of ``by``, packed as one row with the least and greatest of each of
    these columns.  All columns take part in the order, so that a task that is run again makes the same blocks."""
    by, rows = list(dict.fromkeys(by)), f"{name}_rows"
    ordered = df.repartitionByRange(tasks, *by).sortWithinPartitions(*by, *(c for c in df.columns if c not in by))
    numbered = ordered.withColumn(name, F.shiftright(F.monotonically_increasing_id(), BLOCK_ROWS.bit_length() - 1))
    ends = [f(c).alias(f"{end}_{c}") for c in by for end, f in (("least", F.min), ("greatest", F.max))]
    return numbered.repartition(tasks, name).groupBy(name).agg(F.collect_list(F.struct(*df.columns)).alias(rows), *ends).drop(name)


def _block_join(left: DataFrame, right: DataFrame, on: B.Bound, compared: list[B.Call], sizes: list[int], tasks: int) -> DataFrame:
    """Inner join by pairs of blocks, of which those are left out whose least and greatest values rule out every
    pair of rows.  What is made of a pair of blocks repeats the same few values again and again, so that results, which
    grow with the product of the sides, take a fraction of the bytes once written in columns."""
    pairs = [(c.operands[0].id, c.op, c.operands[1].id) for c in compared]
    packed = [_blocks(df, [p[2 * i] for p in pairs], name, tasks) for i, (df, name) in enumerate(((left, "left"), (right, "right")))]
    possible = None
    for c, (one, op, other) in zip(compared, pairs):
        ends = ("least", "greatest") if op[0] == "<" else ("greatest", "least")
        holds = to_column(c, {c.operands[0]: f"{ends[0]}_{one}", c.operands[1]: f"{ends[1]}_{other}"})
        possible = holds if possible is None else possible & holds
    small = int(sizes[1] <= sizes[0])
    if sizes[small] <= SENT_SIDE:
        packed[small] = F.broadcast(packed[small])
    outer, inner = (("left_rows", left), ("right_rows", right))[:: 1 if small else -1]
    # coalesce() merges no partitions here: it stands outside generated code, which would otherwise hold the rows of all
    # blocks that a block meets in memory before it hands on the first
    met = packed[0].join(packed[1], possible, "inner").coalesce(ANY).select(F.inline(outer[0]), inner[0])
    met = met.select(*outer[1].columns, F.inline(inner[0]))
    return keep(met, on).select(*left.columns, *right.columns)


def join(left: DataFrame, right: DataFrame, kind: str, on: B.Bound | None, needed: set[str]) -> DataFrame:
    """Inner, left or cross join.  Equalities between the sides become hash or sort-merge joins, whatever
    else the condition holds; the side to broadcast, if any, is left to the size that Spark measures.
    ``needed``: the columns that the statement reads, this condition's among them."""
    if kind == "cross" or not _equates(on, set(left.columns)):
        sizes, tasks = [_bytes(df) for df in (left, right)], 4 * left.sparkSession.sparkContext.defaultParallelism
        if sizes[0] * sizes[1] > PAIR_BYTES:
            compared = _compared(on, set(left.columns)) if kind == "inner" else []
            sides = [df.select(*(c for c in df.columns if c in needed)) for df in (left, right)]
            if compared and max(sizes) <= SMALL_SIDE and all(map(_sortable, sides)):
                return _block_join(*sides, on, compared, sizes, tasks)
            left, right = (df.repartition(tasks) if size <= SMALL_SIDE else df for df, size in zip((left, right), sizes))
    if kind == "cross":
        return left.crossJoin(right)
    return left.join(right, to_column(on), kind)


def keep(df: DataFrame, condition: B.Bound | None) -> DataFrame:
    """Rows for which the condition is true, neither false nor NULL."""
    return df if condition is None else df.filter(to_column(condition))


def aggregate(df: DataFrame, groups: list[B.Bound], wanted: list[B.Bound]) -> tuple[DataFrame, dict[B.Bound, str]]:
    """Grouped rows, and the columns in which groups and aggregates now stand."""
    known = {g: f"g{i}" for i, g in enumerate(dict.fromkeys(groups))}
    calls = {a: f"a{i}" for i, a in enumerate(dict.fromkeys(a for e in wanted for a in aggregates_in(e)))}
    keys = [to_column(g).alias(name) for g, name in known.items()]
    measures = [to_aggregate(a).alias(name) for a, name in calls.items()]
    if measures:
        return df.groupBy(*keys).agg(*measures), known | calls
    return df.select(*keys).distinct(), known


def sort(df: DataFrame, order: list[tuple[B.Bound, bool, bool]], known: dict[B.Bound, str]) -> DataFrame:
    """By expressions with explicit places for NULLs: it is the largest value unless the query says otherwise."""
    ways = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
    return df.orderBy(*(getattr(to_column(e, known), ways[up, first])() for e, up, first in order)) if order else df


def project(df: DataFrame, outputs: list[B.Output], known: dict[B.Bound, str]) -> DataFrame:
    return df.select(*(to_column(o.expr, known).alias(o.name, metadata={"varchar_size": o.size}) if o.size is not None else to_column(o.expr, known).alias(o.name) for o in outputs))
