"""Scalar functions by name: each builds a Column from its arguments, so none runs in Python."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import FunctionProblem


@dataclass(frozen=True)
class Arg:
    """An argument: its column, its type where known, and its value where it is a literal."""

    column: Column
    type: T.DataType | None = None
    literal: object = None
    is_literal: bool = False

    def text(self) -> Column:
        return as_text(self.column, self.type)

    def number(self) -> Column:
        return self.column.cast("double")

    def whole(self, what: str) -> Column:
        """A count: a fraction is cut off."""
        if self.is_literal and not isinstance(self.literal, int | float):
            raise FunctionProblem(f"{what} must be a number")
        return self.column.cast("double").cast("int")

    def word(self, what: str) -> str:
        if not self.is_literal or not isinstance(self.literal, str):
            raise FunctionProblem(f"{what} must be a string literal")
        return self.literal.lower()


def as_text(column: Column, kind: T.DataType | None) -> Column:
    """Text of a value; whole numbers of a floating type are written without a fraction."""
    if isinstance(kind, T.StringType):
        return column
    if isinstance(kind, T.DoubleType | T.FloatType):
        whole = (column == F.floor(column)) & (F.abs(column) < F.lit(1e15))
        return F.when(whole, column.cast("bigint").cast("string")).otherwise(column.cast("string"))
    return column.cast("string")


@dataclass(frozen=True)
class ScalarFunction:
    """A function; ``most`` arguments of -1 is any number."""

    name: str
    least: int
    most: int
    build: Callable[..., Column]

    def __call__(self, args: list[Arg]) -> Column:
        if len(args) < self.least:
            raise FunctionProblem(f"{self.name} expected at least {self.least} arguments, got {len(args)}")
        if 0 <= self.most < len(args):
            raise FunctionProblem(f"{self.name} expected at most {self.most} arguments, got {len(args)}")
        return self.build(*args)


class Registry:
    """Functions by name, in any case.  A child registry sees its parent's functions."""

    def __init__(self, parent: Registry | None = None) -> None:
        self._own: dict[str, ScalarFunction] = {}
        self._parent, self._lock = parent, threading.Lock()

    def register(self, function: ScalarFunction) -> None:
        with self._lock:
            self._own[function.name.upper()] = function

    def define(self, name: str, least: int, most: int) -> Callable:
        """A decorator that registers a builder."""

        def add(build: Callable[..., Column]) -> Callable[..., Column]:
            self.register(ScalarFunction(name.upper(), least, most, build))
            return build

        return add

    def get(self, name: str) -> ScalarFunction:
        found = self._own.get(name.upper())
        if found is None and self._parent is not None:
            return self._parent.get(name)
        if found is None:
            raise FunctionProblem(f"unknown function: {name}")
        return found

    def __contains__(self, name: str) -> bool:
        return name.upper() in self._own or self._parent is not None and name in self._parent

    def names(self) -> list[str]:
        return sorted({*self._own, *(self._parent.names() if self._parent else [])})


BUILT_IN = Registry()


def failing(when: Column, message: str, otherwise: Column) -> Column:
    """``otherwise``, or an error in rows for which ``when`` holds."""
    return F.when(when, F.raise_error(F.lit(message)).cast("string").cast("double")).otherwise(otherwise)
