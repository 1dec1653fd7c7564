"""The library's front door: ``Engine(spark).sql(text)`` is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from millrace.dialect.grammar import parse
from millrace.dialect.tree import Query
from millrace.functions import BUILT_IN, Registry, ScalarFunction
from millrace.functions.registry import Arg
from millrace.plans.lowering import Lowering
from millrace.session import build_session
from millrace.sources import parquet


class Engine:
    """Runs the dialect on a session.  ``base`` is where relative table names that aren't files here are looked up."""

    def __init__(self, spark: SparkSession | None = None, base: str | None = None) -> None:
        self.spark = spark or build_session()
        self.base = base.rstrip("/") if base else None
        self.functions = Registry(BUILT_IN)
        self._tables: dict[str, DataFrame] = {}

    def sql(self, text: str) -> DataFrame:
        """The result of a query; names and types are checked now, rows are read when they are asked for."""
        return self.run(parse(text))

    def run(self, query: Query) -> DataFrame:
        return Lowering(self.table, self.functions).query(query)

    def table(self, name: str) -> DataFrame:
        """A registered table, or a Parquet file, folder or glob."""
        if name in self._tables:
            return self._tables[name]
        path = f"{self.base}/{name}" if self.base and not name.startswith("/") and "://" not in name else name
        return parquet.read(self.spark, path)

    def register_table(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame, also a streaming one, known under a name."""
        self._tables[name] = df

    def register_function(self, name: str, build: Callable[..., Column], least: int = 1, most: int | None = None) -> None:
        """A scalar function: ``build`` gets Columns and returns one (a Spark function, or a pandas UDF)."""
        most = least if most is None else most
        self.functions.register(ScalarFunction(name.upper(), least, most, lambda *args: build(*[a.column if isinstance(a, Arg) else a for a in args])))
