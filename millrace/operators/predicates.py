"""Comparisons with the dialect's two-valued treatment of null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import BindingProblem


def family(kind: T.DataType | None) -> str | None:
    match kind:
        case T.StringType():
            return "string"
        case T.BooleanType():
            return "bool"
        case T.NumericType():
            return "number"
        case T.DateType() | T.TimestampType() | T.TimestampNTZType():
            return "time"
        case T.ArrayType() | T.MapType() | T.StructType():
            return "nested"
    return None


def comparable(a: T.DataType | None, b: T.DataType | None) -> None:
    """An error for values of two families; times may be compared with text."""
    x, y = family(a), family(b)
    if x and y and x != y and {x, y} != {"string", "time"}:
        raise BindingProblem(f"cannot compare {a.simpleString()} with {b.simpleString()}")


def equal(a: Column, b: Column) -> Column:
    """Null equals null and nothing else."""
    return a.eqNullSafe(b)


def unequal(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def settled(p: Column) -> Column:
    """A predicate for use under NOT: what is unknown is false."""
    return F.coalesce(p, F.lit(False))
