"""Statements as written: names and expressions before anything is looked up."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: object
    type: str


@dataclass(frozen=True)
class Name(Expr):
    qualifier: str | None
    name: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class NullTest(Expr):
    operand: Expr
    negated: bool


@dataclass(frozen=True)
class Aggregate(Expr):
    function: str
    argument: Expr  # the literal 1 for count(*)


@dataclass(frozen=True)
class Star:
    qualifier: str | None = None


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left or cross
    table: TableRef
    on: Expr | None


@dataclass(frozen=True)
class Order:
    expr: Expr
    ascending: bool
    nulls_first: bool


@dataclass
class Select:
    items: list
    table: TableRef
    joins: list[Join] = field(default_factory=list)
    where: Expr | None = None
    group_by: list[Expr] = field(default_factory=list)
    order_by: list[Order] = field(default_factory=list)
    limit: Expr | None = None


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[Expr]] | None
    query: Select | None


@dataclass
class Update:
    table: str
    assignments: list[tuple[str, Expr]]
    where: Expr | None


@dataclass
class Delete:
    table: str
    where: Expr | None


@dataclass
class ColumnDef:
    name: str
    type: str
    size: int | None


@dataclass
class CreateTable:
    table: str
    columns: list[ColumnDef]
    primary_keys: list[list[str]]


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: list[str]
    unique: bool


@dataclass
class Explain:
    statement: object
    raw: bool
