"""Text functions.  Arguments of any scalar type are read as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.registry import BUILT_IN, Arg

BLANKS = " \t\n\r"
ALL_BLANKS = " \t\n\r\x0b\x0c\x85\xa0"
MAX_REPEAT_BYTES = 10 * 1024 * 1024  # fixed value: limit of the dialect

fn = BUILT_IN.define


@fn("UPPER", 1, 1)
def upper(s: Arg) -> Column:
    return F.upper(s.text())


@fn("LOWER", 1, 1)
def lower(s: Arg) -> Column:
    return F.lower(s.text())


@fn("CONCAT", 1, -1)
def concat(*parts: Arg) -> Column:
    return F.concat(*[p.text() for p in parts])


@fn("LENGTH", 1, 1)
def length(s: Arg) -> Column:
    """Bytes, not characters."""
    return F.octet_length(s.text()).cast("bigint")


@fn("TRIM", 1, 1)
def trim(s: Arg) -> Column:
    return F.btrim(s.text(), F.lit(ALL_BLANKS))


@fn("LTRIM", 1, 1)
def ltrim(s: Arg) -> Column:
    return F.ltrim(s.text(), F.lit(BLANKS))


@fn("RTRIM", 1, 1)
def rtrim(s: Arg) -> Column:
    return F.rtrim(s.text(), F.lit(BLANKS))


def substring(s: Arg, start: Arg, size: Arg | None = None) -> Column:
    """From a 1-based character on; a start before the first is the first."""
    first = F.greatest(start.whole("start"), F.lit(1))
    count = F.greatest(size.whole("length"), F.lit(0)) if size else F.lit(2**31 - 1)
    return F.substring(s.text(), first, count)


fn("SUBSTRING", 2, 3)(substring)
fn("SUBSTR", 2, 3)(substring)


@fn("REPLACE", 3, 3)
def replace(s: Arg, old: Arg, new: Arg) -> Column:
    return F.replace(s.text(), old.text(), new.text())


@fn("SPLIT", 2, 2)
def split(s: Arg, delimiter: Arg) -> Column:
    """At a literal delimiter; an empty one separates all characters."""
    if delimiter.is_literal:
        return F.split(s.text(), re.escape(str(delimiter.literal)) if delimiter.literal != "" else "", -1)
    quoted = F.concat(F.lit("\\Q"), delimiter.text(), F.lit("\\E"))
    return F.when(delimiter.text() == "", F.split(s.text(), F.lit(""), -1)).otherwise(F.split(s.text(), quoted, -1))


@fn("REVERSE", 1, 1)
def reverse(s: Arg) -> Column:
    return F.reverse(s.text())


@fn("CONTAINS", 2, 2)
def contains(s: Arg, part: Arg) -> Column:
    return F.contains(s.text(), part.text())


@fn("STARTS_WITH", 2, 2)
def starts_with(s: Arg, part: Arg) -> Column:
    return F.startswith(s.text(), part.text())


@fn("ENDS_WITH", 2, 2)
def ends_with(s: Arg, part: Arg) -> Column:
    return F.endswith(s.text(), part.text())


@fn("REPEAT", 2, 2)
def repeat(s: Arg, times: Arg) -> Column:
    n, text = times.whole("count"), s.text()
    wrong = lambda why: F.raise_error(F.lit(f"REPEAT: {why}")).cast("string")
    return (
        F.when(n < 0, wrong("count must be non-negative"))
        .when(F.octet_length(text).cast("bigint") * n > MAX_REPEAT_BYTES, wrong("result too large"))
        .otherwise(F.repeat(text, n))
    )
