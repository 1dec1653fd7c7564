"""JSON Lines: one object per row, nulls included, keys in order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def lines(df: DataFrame) -> DataFrame:
    """One column ``line``."""
    row = F.struct(*[quoted(c).alias(c) for c in sorted(df.columns)])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))


def write(df: DataFrame, out: TextIO) -> None:
    """To a text stream, a partition at a time."""
    for row in lines(df).toLocalIterator():
        out.write(row["line"] + "\n")


def save(df: DataFrame, path: str) -> None:
    """To files, by all executors."""
    lines(df).write.text(path)


def iterate(df: DataFrame) -> Iterator[str]:
    return (row["line"] for row in lines(df).toLocalIterator())
