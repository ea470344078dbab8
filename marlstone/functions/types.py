"""The six SQL types, their Spark types, and which conversions lose nothing.

A type is a name: ``boolean smallint int bigint double varchar``, ``null`` for the literal that
takes the type of what it meets, or ``other:<spark type>`` for columns of registered tables
that are passed through (timestamps, arrays): they can be selected, grouped, ordered, tested for NULL and
compared with their own type.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

NUMERIC = ("smallint", "int", "bigint", "double")
SPARK = {"boolean": T.BooleanType(), "smallint": T.ShortType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "varchar": T.StringType(), "null": T.IntegerType()}
RANGES = {"smallint": 1 << 15, "int": 1 << 31, "bigint": 1 << 63}


@dataclass(frozen=True)
class Field:
    """A column of a table; ``size`` is the most bytes of a varchar (None: no limit)."""

    name: str
    type: str
    size: int | None = None


def spark_type(name: str) -> T.DataType:
    return T.DataType.fromDDL(name[6:]) if name.startswith("other:") else SPARK[name]


def type_of(kind: T.DataType) -> str:
    for name, spark in SPARK.items():
        if name != "null" and kind == spark:
            return name
    return f"other:{kind.simpleString()}"


def struct(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f.type), True, {"varchar_size": f.size} if f.size is not None else None) for f in fields])


def fields_of(schema: T.StructType) -> list[Field]:
    return [Field(f.name, type_of(f.dataType), (f.metadata or {}).get("varchar_size")) for f in schema.fields]


def wider(a: str, b: str) -> str | None:
    """The numeric type that holds both, or None; null takes the other's type."""
    if a == "null" or b == "null":
        other = b if a == "null" else a
        return other if other in (*NUMERIC, "null") else None
    if a in NUMERIC and b in NUMERIC:
        return NUMERIC[max(NUMERIC.index(a), NUMERIC.index(b))]
    return None


def comparable(a: str, b: str) -> bool:
    return a == b or "null" in (a, b) or wider(a, b) is not None


def assignable(source: str, target: str, literal: int | None = None) -> bool:
    """Whether a value of ``source`` can be stored as ``target`` without loss: equal types, NULL, widening,
    and whole-number literals in range."""
    if source in (target, "null"):
        return True
    if source in NUMERIC and target in NUMERIC:
        if NUMERIC.index(source) <= NUMERIC.index(target):
            return True
        return literal is not None and target in RANGES and -RANGES[target] <= literal < RANGES[target]
    return False
