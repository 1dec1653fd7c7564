"""ORDER BY, LIMIT, OFFSET and DISTINCT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def sort_column(column: Column, descending: bool = False, nulls_first: bool | None = None) -> Column:
    """Nulls come first in ascending and last in descending order, unless said otherwise."""
    first = not descending if nulls_first is None else nulls_first
    if descending:
        return column.desc_nulls_first() if first else column.desc_nulls_last()
    return column.asc_nulls_first() if first else column.asc_nulls_last()


def cut(df: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    """Directly after a sort, so that a limited sort is planned as a top-k."""
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)
