"""A bound query as a DataFrame: scans and joins, filter, aggregate, sort, project, limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import relational as R
from . import binder as B


def plan(query: B.Query, table: Callable[[str], DataFrame]) -> DataFrame:
    df = R.scan(table(query.source.table), query.source)
    read = [j.on for j in query.joins] + [query.where] + query.groups + [o.expr for o in query.outputs] + [e for e, _, _ in query.order]
    needed = {c for e in read for c in R.columns_in(e)}
    for j in query.joins:
        df = R.join(df, R.scan(table(j.source.table), j.source), j.kind, j.on, needed)
    df = R.keep(df, query.where)
    known: dict[B.Bound, str] = {}
    if query.grouped:
        df, known = R.aggregate(df, query.groups, [o.expr for o in query.outputs] + [e for e, _, _ in query.order])
    df = R.sort(df, query.order, known)
    df = R.project(df, query.outputs, known)
    return df if query.limit is None else df.limit(query.limit)
