"""Single steps of a query on any DataFrame, with the dialect's expressions as text."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.dialect.grammar import parse
from millrace.engine import Engine
from millrace.operators.ordering import cut


def _run(df: DataFrame, text: str) -> DataFrame:
    engine = Engine(df.sparkSession)
    engine.register_table("t", df)
    return engine.run(parse(text))


def apply_filter(df: DataFrame, condition: str) -> DataFrame:
    """Rows for which a condition holds."""
    return _run(df, f"SELECT * FROM t WHERE {condition}")


def apply_select_list(df: DataFrame, items: str) -> DataFrame:
    """A projection, with window functions where named."""
    return _run(df, f"SELECT {items} FROM t")


apply_window_functions = apply_select_list


def apply_order_by(df: DataFrame, keys: str) -> DataFrame:
    return _run(df, f"SELECT * FROM t ORDER BY {keys}")


def apply_limit_offset(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    return cut(df, limit, offset)


def apply_distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def apply_group_by(df: DataFrame, keys: str, items: str, having: str = "") -> DataFrame:
    """Groups and aggregates; no keys is one group of all rows."""
    return _run(df, f"SELECT {items} FROM t" + (f" GROUP BY {keys}" if keys else "") + (f" HAVING {having}" if having else ""))


def column_names(df: DataFrame) -> list[str]:
    return df.columns
