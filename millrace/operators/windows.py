"""Window functions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace.errors import FunctionProblem

WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)
ARITY = {"ROW_NUMBER": (0, 0), "RANK": (0, 0), "DENSE_RANK": (0, 0), "NTILE": (1, 1), "FIRST_VALUE": (1, 1), "LAST_VALUE": (1, 1), "NTH_VALUE": (2, 2), "LAG": (1, 3), "LEAD": (1, 3)}


def spec(partition: list[Column], order: list[Column], ordered: bool):
    """A window; functions that need an order get a constant one where the query names none.

    A window without PARTITION BY is one partition for Spark, hence one task: that is what the
    query asks for.
    """
    w = Window.partitionBy(*partition)
    if order:
        return w.orderBy(*order)
    return w.orderBy(F.lit(1)) if ordered else w


def framed(w, by_rows: bool, start: int | None, end: int | None):
    a = Window.unboundedPreceding if start is None else start
    b = Window.unboundedFollowing if end is None else end
    return w.rowsBetween(a, b) if by_rows else w.rangeBetween(a, b)


def ranking(name: str, args: list[Column], literals: list[object], partition: list[Column], order: list[Column], frame: tuple | None) -> Column:
    name = name.upper()
    low, high = ARITY[name]
    if not low <= len(args) <= high:
        raise FunctionProblem(f"{name} takes {low} to {high} arguments, got {len(args)}")
    if name in ("ROW_NUMBER", "RANK", "DENSE_RANK"):
        return {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[name]().over(spec(partition, order, True)).cast("bigint")
    if name == "NTILE":
        n = _whole(literals[0], "NTILE: argument must be positive")
        if n <= 0:
            raise FunctionProblem("NTILE: argument must be positive")
        return F.ntile(n).over(spec(partition, order, True)).cast("bigint")
    if name in ("LAG", "LEAD"):
        n = _whole(literals[1], f"{name}: offset must be a whole number") if len(args) > 1 else 1
        if n < 0:
            raise FunctionProblem(f"{name}: offset must be non-negative")
        default = None
        if len(args) > 2:
            default = literals[2]
            if default is ...:
                raise FunctionProblem(f"{name}: default must be a literal")
        return (F.lag if name == "LAG" else F.lead)(args[0], n, default).over(spec(partition, order, True))
    w = spec(partition, order, False)
    w = framed(w, *frame) if frame else w.rowsBetween(*WHOLE)
    if name == "FIRST_VALUE":
        return F.first(args[0]).over(w)
    if name == "LAST_VALUE":
        return F.last(args[0]).over(w)
    n = _whole(literals[1], "NTH_VALUE: position must be a whole number")
    if n <= 0:
        return F.when(F.lit(False), args[0])
    return F.nth_value(args[0], n).over(w if order else framed(spec(partition, [], True), *(frame or (True, None, None))))


def _whole(value: object, message: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise FunctionProblem(message)
    return int(value)
