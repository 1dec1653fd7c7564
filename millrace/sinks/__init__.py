"""Output formats."""

from __future__ import annotations

from typing import Protocol, TextIO

from pyspark.sql import DataFrame

from millrace.errors import QueryError
from millrace.sinks import csvlines, jsonl


class Formatter(Protocol):
    def write(self, df: DataFrame, out: TextIO) -> None: ...


def formatter(name: str) -> Formatter:
    """``json`` and ``jsonl`` are JSON Lines; ``csv`` is CSV."""
    match name:
        case "json" | "jsonl":
            return jsonl
        case "csv":
            return csvlines
    raise QueryError(f"unsupported format: {name}; use json, jsonl or csv")
