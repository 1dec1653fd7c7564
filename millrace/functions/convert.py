"""Conversions and choices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import FunctionProblem
from millrace.functions.dates import parsed
from millrace.functions.registry import BUILT_IN, Arg

fn = BUILT_IN.define
KINDS = {"string": "string", "varchar": "string", "text": "string", "number": "number", "double": "number", "float": "number", "date": "date"}


@fn("CAST", 2, 2)
def cast(value: Arg, kind: Arg) -> Column:
    match KINDS.get(kind.word("CAST: type")):
        case "string":
            return value.text()
        case "number":
            return value.number()
        case "date":
            return parsed(value)
    raise FunctionProblem(f"CAST: unknown type {kind.literal!r}; use string, number or date")


@fn("TRY_CAST", 2, 2)
def try_cast(value: Arg, kind: Arg) -> Column:
    """Null where ``CAST`` fails, and for an unknown type."""
    match KINDS.get(kind.word("TRY_CAST: type")):
        case "string":
            return value.text()
        case "number":
            return value.column.try_cast("double")
        case "date":
            return parsed(value, strict=False)
    return F.lit(None).cast("string")


@fn("TO_STRING", 1, 1)
def to_string(value: Arg) -> Column:
    return value.text()


@fn("TO_NUMBER", 1, 1)
def to_number(value: Arg) -> Column:
    return value.number()


@fn("TO_DATE", 1, 1)
def to_date(value: Arg) -> Column:
    return F.date_format(parsed(value), "yyyy-MM-dd")


@fn("COALESCE", 1, -1)
def coalesce(*values: Arg) -> Column:
    return F.coalesce(*[v.column for v in values])


@fn("NULLIF", 2, 2)
def nullif(a: Arg, b: Arg) -> Column:
    return F.when(~a.column.eqNullSafe(b.column), a.column)
