"""CSV with a header, columns in order, and a guard against formulas in spreadsheets."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.registry import as_text
from millrace.sinks.jsonl import quoted

# First characters that spreadsheets take for a formula.
RISKY = ("=", "+", "-", "@", "\t", "\r", "\n", "|")


def guarded(text: Column) -> Column:
    """Risky text gets a leading quote, and its own quotes doubled."""
    return F.when(F.substring(text, 1, 1).isin(*RISKY), F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")))).otherwise(text)


def cell(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return guarded(column)
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return column.cast("string")
    return as_text(column, kind)


def escaped(text: Column) -> Column:
    """Quoted where a separator, quote, line break or leading blank asks for it; null is empty."""
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike(r'[",\r\n]|^[ \t]'), doubled).otherwise(text), F.lit(""))


def header(df: DataFrame) -> str:
    names = sorted(df.columns)
    plain = lambda s: '"' + s.replace('"', '""') + '"' if any(ch in s for ch in '",\r\n') or s[:1] in (" ", "\t") else s
    return ",".join(plain(n) for n in names)


def lines(df: DataFrame) -> DataFrame:
    """One column ``line``, without the header."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return df.select(F.concat_ws(",", *[escaped(cell(quoted(c), kinds[c])) for c in sorted(df.columns)]).alias("line"))


def iterate(df: DataFrame) -> Iterator[str]:
    """Header and rows; nothing at all for an empty result."""
    first = True
    for row in lines(df).toLocalIterator():
        if first:
            yield header(df)
            first = False
        yield row["line"]


def write(df: DataFrame, out: TextIO) -> None:
    for line in iterate(df):
        out.write(line + "\n")


def save(df: DataFrame, path: str) -> None:
    """To files by all executors, each with a header."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    df.select(*[cell(quoted(c), kinds[c]).alias(c) for c in sorted(df.columns)]).write.option("header", True).option("quoteAll", False).csv(path)
