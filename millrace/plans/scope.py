"""What names mean: the columns of the tables in FROM, and the tables that WITH defines."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.errors import BindingProblem
from millrace.sources.parquet import FILE_COLUMN

_serial = itertools.count()


@dataclass(frozen=True)
class Entry:
    """A column: its table's alias, its name, and the unique name it has in the plan."""

    alias: str | None
    name: str
    unique: str
    type: T.DataType

    @property
    def visible(self) -> str:
        return f"{self.alias}.{self.name}" if self.alias and self.name != FILE_COLUMN else self.name


@dataclass
class Relation:
    """A DataFrame whose columns have unique names, and what they are called in the query."""

    df: DataFrame
    entries: list[Entry]

    @classmethod
    def of(cls, df: DataFrame, alias: str | None) -> Relation:
        entries = [Entry(alias, f.name, f"k{next(_serial)}", f.dataType) for f in df.schema.fields]
        columns = [F.col(f"`{e.name.replace('`', '``')}`").alias(e.unique) for e in entries]
        return cls(df.select(*columns), entries)

    def find(self, name: str) -> Entry | None:
        """The column of that visible name; else the only one of that name under any alias."""
        exact = [e for e in self.entries if e.visible == name]
        found = exact or [e for e in self.entries if e.alias and e.name == name]
        if len(found) > 1:
            raise BindingProblem(f"column {name} is ambiguous; use one of {', '.join(e.visible for e in found)}")
        return found[0] if found else None

    def merged(self, other: Relation, df: DataFrame) -> Relation:
        """Both sides' columns; ``_file`` of two globs gets a side's name, other shared names are an error."""
        mine, theirs = {e.visible for e in self.entries}, {e.visible for e in other.entries}
        both = mine & theirs
        if both - {FILE_COLUMN}:
            raise BindingProblem(f"column name collision in JOIN: {', '.join(sorted(both - {FILE_COLUMN}))}; use table aliases")
        left, right = self.entries, other.entries
        if FILE_COLUMN in both:
            left = [replace(e, name="_file_left") if e.name == FILE_COLUMN else e for e in left]
            right = [replace(e, name="_file_right") if e.name == FILE_COLUMN else e for e in right]
        return Relation(df, [*left, *right])


@dataclass
class Tables:
    """WITH tables in scope, innermost first; ``pending`` are named but not yet defined."""

    own: dict[str, DataFrame] = field(default_factory=dict)
    pending: list[str] = field(default_factory=list)
    current: str | None = None
    parent: Tables | None = None

    def find(self, name: str) -> DataFrame | None:
        if name in self.own:
            return self.own[name]
        if name == self.current:
            raise BindingProblem(f"circular CTE dependency: {name} refers to itself")
        if name in self.pending:
            raise BindingProblem(f"forward CTE reference: {name} is defined later")
        return self.parent.find(name) if self.parent else None
