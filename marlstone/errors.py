"""One exception class for each stage that can refuse a statement; ``kind`` names the reason."""

from __future__ import annotations


class SqlError(Exception):
    kinds: frozenset[str] = frozenset()

    def __init__(self, kind: str, detail: str = ""):
        assert kind in self.kinds, kind
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail = kind, detail


class ParseError(SqlError):
    kinds = frozenset("Parse ExpectedSingleStatement UnsupportedStatement UnsupportedQuery UnsupportedExpression UnsupportedDataType VarcharMissingSize".split())


class BindError(SqlError):
    kinds = frozenset(
        "DuplicateColumn PrimaryKeyColumnNotFound DuplicatePrimaryKeyColumn DuplicateIndexColumn CreateTableWithoutColumns TableNotFound InvalidTableName "
        "InsertValuesEmpty InsertValuesDoesntMatchColumns UnsupportedExpression AmbiguousColumn DuplicateInsertColumns ColumnNotFound "
        "MissingFromClauseEntry EmptySelectProjection UngroupedColumn AggregateInGroupBy NestedAggregate".split()
    )


class PlanError(SqlError):
    kinds = frozenset("AmbiguousColumn InsertSchemaMismatch UpdateSchemaMismatch UnsupportedStatement".split())


class ExecutionError(SqlError):
    kinds = frozenset("ExpectedBoolean ExpectedNumeric ExpectedInteger NegativeLimit ComparisonTypeMismatch NumericOutOfRange UnsupportedExpression".split())


class CatalogError(SqlError):
    kinds = frozenset("DuplicateTable DuplicateIndex TableNotFound IndexNotFound UnsupportedIndexType UnsupportedUniqueIndex".split())
