"""INSERT, UPDATE and DELETE as new table versions, each returning the number of rows concerned."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindError, ExecutionError, PlanError
from ..functions.expressions import to_column
from ..functions.types import Field, assignable, spark_type
from ..plans import binder as B
from ..plans import syntax as S
from ..sources.catalog import Catalog, Table


def _target(table: Table, name: str) -> Field:
    for f in table.fields:
        if f.name.lower() == name.lower():
            return f
    raise BindError("ColumnNotFound", name)


def _literal(e: B.Bound) -> int | None:
    whole = isinstance(e, B.Constant) and isinstance(e.value, int) and not isinstance(e.value, bool)
    return e.value if whole else None


def _checked(column, target: Field):
    """Cast to the target's type; a varchar longer than its size in bytes fails."""
    column = column.cast(spark_type(target.type))
    if target.size is None:
        return column
    return F.when(F.octet_length(column) > target.size, F.raise_error(F.lit(f"value too long for {target.name} varchar({target.size})")).cast("string")).otherwise(column)


def finished(df: DataFrame, table: Table, values: dict[str, object]) -> DataFrame:
    """Columns in the table's order; those without a value are NULL."""
    return df.select(*((_checked(values[f.name], f) if f.name in values else F.lit(None).cast(spark_type(f.type))).alias(f.name) for f in table.fields))


def run_spark(action, mismatch: str = "InsertSchemaMismatch"):
    """The value of ``action()``; what Spark reports of the data becomes an error of the engine.
    ``mismatch``: the kind for a value that its column cannot hold."""
    try:
        return action()
    except PySparkException as error:
        text = str(error)
        if "value too long for" in text:
            raise PlanError(mismatch, text[text.index("value too long for") :].split("\n")[0][:120]) from error
        if "OVERFLOW" in text:
            raise ExecutionError("NumericOutOfRange", text.split("\n")[0][:120]) from error
        raise


def insert_frame(catalog: Catalog, s: S.Insert, plan_query) -> tuple[Table, DataFrame]:
    """The rows to add, in the table's columns."""
    if s.table.startswith("__"):
        raise BindError("InvalidTableName", s.table)
    table = catalog.get(s.table)
    names = s.columns or [f.name for f in table.fields]
    targets = [_target(table, n) for n in names]
    if len({t.name for t in targets}) < len(targets):
        raise BindError("DuplicateInsertColumns")
    if s.query is not None:
        query, df = plan_query(s.query)
        if len(query.outputs) != len(targets):
            raise BindError("InsertValuesDoesntMatchColumns")
        df = df.toDF(*(f"v{i}" for i in range(len(targets))))
        for o, t in zip(query.outputs, targets):
            if not assignable(o.expr.type, t.type, _literal(o.expr)):
                raise PlanError("InsertSchemaMismatch", f"{t.name} {t.type} from {o.expr.type}")
        return table, finished(df, table, {t.name: F.col(f"v{i}") for i, t in enumerate(targets)})
    if not s.rows or not s.rows[0]:
        raise BindError("InsertValuesEmpty")
    binder, rows = B.Binder(catalog), []
    for row in s.rows:
        if len(row) != len(targets):
            raise BindError("InsertValuesDoesntMatchColumns")
        cells = [binder.expression(e) for e in row]
        for e, t in zip(cells, targets):
            if not assignable(e.type, t.type, _literal(e)):
                raise PlanError("InsertSchemaMismatch", f"{t.name} {t.type} from {e.type}")
        rows.append(cells)
    schema = T.StructType([T.StructField(f"v{i}", spark_type(t.type)) for i, t in enumerate(targets)])
    df = catalog.spark.createDataFrame(_values(catalog, rows, schema), schema)
    return table, finished(df, table, {t.name: F.col(f"v{i}") for i, t in enumerate(targets)})


#: Expressions that are computed in one query.
EXPRESSIONS = 200


def _values(catalog: Catalog, rows: list[list[B.Bound]], schema: T.StructType) -> list[tuple]:
    """The rows of VALUES: literals as they are, expressions computed a few hundred at a time."""
    open_cells = [(e, f.dataType) for row in rows for e, f in zip(row, schema) if not isinstance(e, B.Constant)]
    found = []
    for at in range(0, len(open_cells), EXPRESSIONS):
        some = [to_column(e).cast(kind).alias(f"e{i}") for i, (e, kind) in enumerate(open_cells[at : at + EXPRESSIONS])]
        found += run_spark(lambda some=some: catalog.spark.range(1).select(*some).first())
    done = iter(found)
    plain = lambda e, f: float(e.value) if isinstance(f.dataType, T.DoubleType) and e.value is not None else e.value
    return [tuple(plain(e, f) if isinstance(e, B.Constant) else next(done) for e, f in zip(row, schema)) for row in rows]


def insert(catalog: Catalog, s: S.Insert, plan_query) -> int:
    table, df = insert_frame(catalog, s, plan_query)
    part = run_spark(lambda: catalog.write(df, table))
    if part._rows:
        catalog.add(table, part)
    return part._rows


def _matching(catalog: Catalog, table: Table, where: S.Expr | None):
    binder = B.Binder(catalog)
    source = binder.add_source(S.TableRef(table.name))
    bound = binder.condition(where)
    test = F.lit(True) if bound is None else F.coalesce(to_column(bound), F.lit(False))
    scanned = [part.select(*(F.col(f"`{f.name}`").alias(c.id) for f, c in zip(table.fields, source.columns))) for part in table.parts]
    return binder, source, test, scanned


def _counts(scanned: list[DataFrame], test) -> list[int]:
    """Matching rows of each part, in one pass over all."""
    if not scanned:
        return []
    tagged = [df.select(F.lit(i).alias("part"), test.alias("hit")) for i, df in enumerate(scanned)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.union(t)
    found = {r[0]: r[1] for r in run_spark(lambda: every.groupBy("part").agg(F.count_if("hit")).collect())}
    return [found.get(i, 0) for i in range(len(scanned))]


def update(catalog: Catalog, s: S.Update, frame_only: bool = False):
    table = catalog.get(s.table)
    binder, source, test, scanned = _matching(catalog, table, s.where)
    values = {}
    for name, e in s.assignments:  # right sides see the old row; of equal targets the last counts
        target, bound = _target(table, name), binder.expression(e)
        if not assignable(bound.type, target.type, _literal(bound)):
            raise PlanError("UpdateSchemaMismatch", f"{target.name} {target.type} from {bound.type}")
        values[target.name] = _checked(to_column(bound), target)
    columns = [(F.when(test, values[f.name]).otherwise(F.col(c.id)) if f.name in values else F.col(c.id)).alias(f.name) for f, c in zip(table.fields, source.columns)]
    if frame_only:
        return [df.select(*columns) for df in scanned]
    counts = run_spark(lambda: _counts(scanned, test))
    _replace(catalog, table, [df.select(*columns) for df in scanned], counts, "UpdateSchemaMismatch")
    return sum(counts)


def _replace(catalog: Catalog, table: Table, made: list[DataFrame], counts: list[int], mismatch: str) -> None:
    """A version in which one new part, at the place of the first, has what becomes of all parts with matching rows."""
    hit = [i for i, n in enumerate(counts) if n]
    if not hit:
        return
    part = run_spark(lambda: catalog.write(reduce(DataFrame.unionByName, [made[i] for i in hit]), table), mismatch)
    parts = [part if i == hit[0] else p for i, p in enumerate(table.parts) if i == hit[0] or i not in hit]
    table.parts = tuple(p for p in parts if p is not part or part._rows)


def delete(catalog: Catalog, s: S.Delete, frame_only: bool = False):
    table = catalog.get(s.table)
    _, source, test, scanned = _matching(catalog, table, s.where)
    columns = [F.col(c.id).alias(f.name) for f, c in zip(table.fields, source.columns)]
    rest = [df.filter(~test).select(*columns) for df in scanned]
    if frame_only:
        return rest
    counts = _counts(scanned, test)
    if s.where is None:
        table.parts = ()
    else:
        _replace(catalog, table, rest, counts, "InsertSchemaMismatch")
    return sum(counts)
