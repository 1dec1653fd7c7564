"""Date functions.  Dates come as text in one of four layouts, or as date and timestamp columns; results are text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FunctionProblem
from millrace.functions.registry import BUILT_IN, Arg

fn = BUILT_IN.define

# The accepted layouts, and the layout of results.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
RESULT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
TRUNC_UNITS = ("year", "month", "day", "hour")
PART_UNITS = ("year", "month", "day", "hour", "minute", "second")
DAY_MICROS = 86_400_000_000


def parsed(value: Arg, strict: bool = True) -> Column:
    """A timestamp without zone; unreadable text is an error, or null if not ``strict``."""
    if isinstance(value.type, T.DateType | T.TimestampType | T.TimestampNTZType):
        return value.column.cast("timestamp_ntz")
    text = value.text()
    by = {layout: F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz") for layout in LAYOUTS}
    # The length tells the layout of almost all texts, so that no other is tried in vain; years of more digits are left to the rest.
    size, spaced = F.length(text), F.substring(text, 11, 1) == " "
    read = F.when(size == 10, by[LAYOUTS[1]]).when((size == 19) & spaced, by[LAYOUTS[2]]).when(size == 19, by[LAYOUTS[3]]).otherwise(F.coalesce(*by.values()))
    if not strict:
        return read
    wrong = F.raise_error(F.concat(F.lit("cannot parse date: "), text)).cast("string").cast("timestamp_ntz")
    return F.when(text.isNotNull(), F.coalesce(read, wrong))


def printed(ts: Column) -> Column:
    return F.date_format(ts, RESULT)


def _unit(unit: Arg, known: tuple[str, ...], what: str) -> str:
    name = unit.word(f"{what}: unit")
    if name not in known:
        raise FunctionProblem(f"{what}: unknown unit {name!r}; use one of {', '.join(known)}")
    return name


@fn("NOW", 0, 0)
def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


@fn("CURRENT_DATE", 0, 0)
def current_date() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


@fn("CURRENT_TIME", 0, 0)
def current_time() -> Column:
    return F.date_format(F.current_timestamp(), "HH:mm:ss")


@fn("DATE_TRUNC", 2, 2)
def date_trunc(unit: Arg, date: Arg) -> Column:
    return printed(F.date_trunc(_unit(unit, TRUNC_UNITS, "DATE_TRUNC"), parsed(date)).cast("timestamp_ntz"))


@fn("DATE_PART", 2, 2)
def date_part(unit: Arg, date: Arg) -> Column:
    name = _unit(unit, PART_UNITS, "DATE_PART")
    return F.floor(F.extract(F.lit(name), parsed(date))).cast("bigint")


def _moved(date: Arg, n: Arg, unit: Arg, sign: int, what: str) -> Column:
    """Days beyond a month's end go on into the next month: one month after 31 January is 2 or 3 March."""
    name = _unit(unit, TRUNC_UNITS, what)
    ts, count = parsed(date), n.whole(f"{what}: amount") * sign
    if name == "day":
        return printed(ts + F.make_dt_interval(days=count))
    if name == "hour":
        return printed(ts + F.make_dt_interval(hours=count))
    months = count * (12 if name == "year" else 1)
    day = F.date_add(F.add_months(F.trunc(ts.cast("date"), "MM"), months), F.dayofmonth(ts) - 1)
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return printed(day.cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")))


@fn("DATE_ADD", 3, 3)
def date_add(date: Arg, n: Arg, unit: Arg) -> Column:
    return _moved(date, n, unit, 1, "DATE_ADD")


@fn("DATE_SUB", 3, 3)
def date_sub(date: Arg, n: Arg, unit: Arg) -> Column:
    return _moved(date, n, unit, -1, "DATE_SUB")


@fn("DATE_DIFF", 2, 2)
def date_diff(a: Arg, b: Arg) -> Column:
    """Whole days of 24 hours from b to a, rounded down."""
    micros = F.unix_micros(parsed(a).cast("timestamp")) - F.unix_micros(parsed(b).cast("timestamp"))
    return F.floor(micros / F.lit(float(DAY_MICROS))).cast("bigint")


@fn("YEAR", 1, 1)
def year(date: Arg) -> Column:
    return F.year(parsed(date)).cast("bigint")


@fn("MONTH", 1, 1)
def month(date: Arg) -> Column:
    return F.month(parsed(date)).cast("bigint")
