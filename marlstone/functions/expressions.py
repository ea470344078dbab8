"""Bound expressions as Spark columns.

Operands are cast to the wider type before they meet, so Spark never coerces by its own
rules; whole-number overflow raises under ANSI mode.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from ..plans import binder as B
from . import types as T

_BINARY = {
    "+": operator.add, "-": operator.sub, "=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "and": operator.and_, "or": operator.or_,
}


def to_column(e: B.Bound, known: dict[B.Bound, str] | None = None) -> SparkColumn:
    """``known``: expressions that stand in the DataFrame as columns already (groups, aggregates)."""
    if known and e in known:
        return F.col(known[e])
    if isinstance(e, B.Constant):
        return F.lit(e.value).cast(T.spark_type(e.type))
    if isinstance(e, B.Column):
        return F.col(e.id)
    assert isinstance(e, B.Call), e
    parts = [to_column(x, known) for x in e.operands]
    if e.op == "not":
        return ~parts[0]
    if e.op == "negate":
        return -parts[0].cast(T.spark_type(e.type))
    if e.op == "is null":
        return parts[0].isNull()
    if e.op == "is not null":
        return parts[0].isNotNull()
    if e.op in ("and", "or"):
        return _BINARY[e.op](*parts)
    left, right = e.operands
    kind = e.type if e.op in "+-" else T.wider(left.type, right.type) or (right.type if left.type == "null" else left.type)
    target = T.spark_type(kind)
    return _BINARY[e.op](*(p if x.type == kind else p.cast(target) for p, x in zip(parts, e.operands)))


def to_aggregate(e: B.AggregateCall) -> SparkColumn:
    argument = to_column(e.argument)
    if e.function == "count":
        made = F.count(argument)
    elif e.function == "sum":
        made = F.sum(argument)
    else:
        made = (F.min if e.function == "min" else F.max)(argument)
    return made.cast(T.spark_type(e.type))


def aggregates_in(e: B.Bound) -> list[B.AggregateCall]:
    if isinstance(e, B.AggregateCall):
        return [e]
    return [a for x in getattr(e, "operands", ()) for a in aggregates_in(x)]
