"""COUNT, SUM, AVG, MIN and MAX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FunctionProblem

NAMES = frozenset(["COUNT", "SUM", "AVG", "MIN", "MAX"])


def aggregate(name: str, column: Column | None, kind: T.DataType | None) -> Column:
    """``column`` is None for COUNT(*).  Numbers, also numbers in text, are summed as double.

    MIN and MAX of text that SUM would reject, of times and booleans keep their type.
    """
    name = name.upper()
    if name == "COUNT":
        return F.count(F.lit(1)) if column is None else F.count(column)
    if column is None:
        raise FunctionProblem(f"{name}(*) is not supported")
    if name in ("MIN", "MAX") and not isinstance(kind, T.NumericType):
        return F.min(column) if name == "MIN" else F.max(column)
    if kind is not None and not isinstance(kind, T.NumericType | T.StringType | T.NullType):
        raise FunctionProblem(f"{name} needs numbers, not {kind.simpleString()}")
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[name](column.cast("double"))
