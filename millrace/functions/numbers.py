"""Number functions.  Arguments, also numbers in text, are read as double; so are the results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.errors import FunctionProblem
from millrace.functions.registry import BUILT_IN, Arg, failing

fn = BUILT_IN.define
MAX_DIGITS = 308  # fixed value: decimal exponents of a double


@fn("ABS", 1, 1)
def absolute(x: Arg) -> Column:
    return F.abs(x.number())


@fn("ROUND", 1, 2)
def rounded(x: Arg, digits: Arg | None = None) -> Column:
    """Half away from zero, of the scaled double."""
    if digits is None:
        return F.round(x.number())
    if digits.is_literal and (not isinstance(digits.literal, int | float) or abs(digits.literal) > MAX_DIGITS):
        raise FunctionProblem(f"ROUND: digits must be a number from -{MAX_DIGITS} to {MAX_DIGITS}")
    scale = F.pow(F.lit(10.0), digits.whole("digits").cast("double"))
    return F.round(x.number() * scale) / scale


@fn("FLOOR", 1, 1)
def floor(x: Arg) -> Column:
    return F.floor(x.number()).cast("double")


@fn("CEIL", 1, 1)
def ceil(x: Arg) -> Column:
    return F.ceil(x.number()).cast("double")


@fn("MOD", 2, 2)
def mod(a: Arg, b: Arg) -> Column:
    return failing(b.number() == 0, "MOD: division by zero", a.number() % F.nullif(b.number(), F.lit(0.0)))


@fn("SQRT", 1, 1)
def sqrt(x: Arg) -> Column:
    return failing((x.number() < 0) | F.isnan(x.number()), "SQRT: negative number", F.sqrt(x.number()))


@fn("POW", 2, 2)
def power(x: Arg, y: Arg) -> Column:
    return F.pow(x.number(), y.number())


@fn("SIGN", 1, 1)
def sign(x: Arg) -> Column:
    return F.signum(x.number())


@fn("TRUNC", 1, 1)
def trunc(x: Arg) -> Column:
    return F.when(x.number() < 0, F.ceil(x.number())).otherwise(F.floor(x.number())).cast("double")


@fn("RANDOM", 0, 0)
def random() -> Column:
    return F.rand()


@fn("MIN", 2, 2)
def smaller(a: Arg, b: Arg) -> Column:
    return F.when(a.column.isNotNull() & b.column.isNotNull(), F.least(a.number(), b.number()))


@fn("MAX", 2, 2)
def larger(a: Arg, b: Arg) -> Column:
    return F.when(a.column.isNotNull() & b.column.isNotNull(), F.greatest(a.number(), b.number()))
