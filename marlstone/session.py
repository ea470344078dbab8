"""Statements in, results out: the engine's front door."""

from __future__ import annotations

import threading
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from .errors import BindError, CatalogError
from .functions.types import Field
from .operators import changes
from .plans import syntax as S
from .plans.binder import Binder, Query
from .plans.parser import parse
from .plans.planner import plan
from .sources.catalog import Catalog


@dataclass
class Result:
    """``frame`` holds rows, ``tag`` names a statement without any."""

    frame: DataFrame | None = None
    tag: str | None = None

    def rows(self) -> list[tuple]:
        return [] if self.frame is None else [tuple(r) for r in changes.run_spark(self.frame.collect)]


class Session:
    """One statement at a time against a catalog of tables.

    ``qualified``: output columns are named table.column; ``narrow``: COUNT is int and SUM has
    the type of its input, failing where the sum does not fit.  The Spark session is set to ANSI
    arithmetic, which the strict overflow rules need and which other users of it share.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, qualified: bool = False, narrow: bool = False):
        spark.conf.set("spark.sql.ansi.enabled", "true")
        self.spark, self.catalog, self.qualified, self.narrow = spark, Catalog(spark, folder), qualified, narrow
        self._lock = threading.RLock()

    def register(self, name: str, df: DataFrame) -> None:
        with self._lock:
            self.catalog.register(name, df)

    def register_parquet(self, folder: str, *names: str) -> None:
        """Tables over ``folder``/<name>.parquet."""
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))

    def select(self, text: str) -> DataFrame:
        """The DataFrame of a SELECT, not yet run."""
        with self._lock:
            return self._query(parse(text))[1]

    def sql(self, text: str) -> Result:
        with self._lock:
            return self._run(parse(text))

    def _query(self, s: S.Select) -> tuple[Query, DataFrame]:
        query = Binder(self.catalog, self.qualified, self.narrow).query(s)
        return query, plan(query, self.catalog.frame)

    def _count(self, name: str, n: int) -> Result:
        return Result(self.spark.createDataFrame([(n,)], f"`__{name}_rows` bigint"))

    def _run(self, s) -> Result:
        if isinstance(s, S.Select):
            return Result(self._query(s)[1])
        if isinstance(s, S.Insert):
            return self._count("insert", changes.insert(self.catalog, s, self._query))
        if isinstance(s, S.Update):
            return self._count("update", changes.update(self.catalog, s))
        if isinstance(s, S.Delete):
            return self._count("delete", changes.delete(self.catalog, s))
        if isinstance(s, S.Explain):
            return self._explain(s)
        if isinstance(s, S.CreateTable):
            return self._create_table(s)
        return self._create_index(s)

    def _explain(self, s: S.Explain) -> Result:
        inner = s.statement
        if isinstance(inner, S.Select):
            df = self._query(inner)[1]
        elif isinstance(inner, S.Insert):
            df = changes.insert_frame(self.catalog, inner, self._query)[1]
        else:
            made = changes.update(self.catalog, inner, True) if isinstance(inner, S.Update) else changes.delete(self.catalog, inner, True)
            df = reduce(DataFrame.unionByName, made) if made else self.catalog.frame(inner.table)
        execution = df._jdf.queryExecution()
        text = execution.analyzed().toString() if s.raw else f"{execution.optimizedPlan().toString()}\n{execution.executedPlan().toString()}"
        return Result(self.spark.createDataFrame([(text,)], "`QUERY PLAN` string"))

    def _create_table(self, s: S.CreateTable) -> Result:
        if not s.columns:
            raise BindError("CreateTableWithoutColumns", s.table)
        names = [c.name.lower() for c in s.columns]
        if len(set(names)) < len(names):
            raise BindError("DuplicateColumn", s.table)
        for key in s.primary_keys:
            if missing := [k for k in key if k.lower() not in names]:
                raise BindError("PrimaryKeyColumnNotFound", missing[0])
            if len({k.lower() for k in key}) < len(key):
                raise BindError("DuplicatePrimaryKeyColumn", s.table)
        self.catalog.create(s.table, [Field(c.name, c.type, c.size) for c in s.columns])
        try:
            for key in s.primary_keys:  # recorded, not enforced
                self.catalog.create_index(f"{s.table}_pk", s.table, key, primary=True)
        except CatalogError:
            self.catalog.drop(s.table)
            raise
        return Result(tag="CREATE TABLE")

    def _create_index(self, s: S.CreateIndex) -> Result:
        names = [f.name.lower() for f in self.catalog.fields(s.table)]
        for c in s.columns:
            if c.lower() not in names:
                raise BindError("ColumnNotFound", c)
        if len({c.lower() for c in s.columns}) < len(s.columns):
            raise BindError("DuplicateIndexColumn", s.name)
        if s.unique:
            raise CatalogError("UnsupportedUniqueIndex", s.name)
        self.catalog.create_index(s.name, s.table, s.columns)
        return Result(tag="CREATE INDEX")
