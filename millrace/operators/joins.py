"""Joins of two relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def joined(left: DataFrame, right: DataFrame, kind: str, on: Column | None) -> DataFrame:
    """Equalities in ``on`` are null-safe and still join by hash or by merge; no side is hinted, sizes decide."""
    if kind == "cross" or on is None:
        return left.crossJoin(right)
    return left.join(right, on, HOW[kind])
