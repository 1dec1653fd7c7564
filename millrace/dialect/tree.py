"""The parsed query: frozen values, so that equal expressions are equal keys."""

from __future__ import annotations

from dataclasses import dataclass


class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Name(Expr):
    text: str


@dataclass(frozen=True)
class Literal(Expr):
    value: str | int | float | bool | None


@dataclass(frozen=True)
class Star(Expr):
    pass


@dataclass(frozen=True)
class Call(Expr):
    name: str  # as typed
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    descending: bool = False
    nulls_first: bool | None = None


@dataclass(frozen=True)
class Frame:
    by_rows: bool
    start: int | None  # None: unbounded; 0: current row; negative: preceding
    end: int | None


@dataclass(frozen=True)
class Over(Expr):
    call: Call
    partition: tuple[Expr, ...]
    order: tuple[SortKey, ...]
    frame: Frame | None


@dataclass(frozen=True)
class Case(Expr):
    operand: Expr | None
    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr
    tight: bool = False  # written without white space, as in a-b


@dataclass(frozen=True)
class Not(Expr):
    inner: Expr


@dataclass(frozen=True)
class Minus(Expr):
    inner: Expr


@dataclass(frozen=True)
class InList(Expr):
    expr: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Expr):
    expr: Expr
    query: Query
    negated: bool


@dataclass(frozen=True)
class Like(Expr):
    expr: Expr
    pattern: Expr
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    expr: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class IsNull(Expr):
    expr: Expr
    negated: bool


@dataclass(frozen=True)
class Exists(Expr):
    query: Query
    negated: bool


@dataclass(frozen=True)
class Scalar(Expr):
    query: Query


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str | None = None


@dataclass(frozen=True)
class Source:
    table: str | None
    query: Query | None
    alias: str | None


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, full, cross
    source: Source
    on: Expr | None


@dataclass(frozen=True)
class Cte:
    name: str
    query: Query


@dataclass(frozen=True)
class Query:
    items: tuple[Item, ...]
    source: Source
    ctes: tuple[Cte, ...] = ()
    distinct: bool = False
    joins: tuple[Join, ...] = ()
    where: Expr | None = None
    group_by: tuple[Expr, ...] = ()
    having: Expr | None = None
    order_by: tuple[SortKey, ...] = ()
    limit: int | None = None
    offset: int | None = None


def inner_exprs(e: Expr) -> tuple[Expr, ...]:
    """The expressions directly within one, subqueries aside."""
    match e:
        case Call():
            return e.args
        case Over():
            return (*e.call.args, *e.partition, *(k.expr for k in e.order))
        case Case():
            return tuple(x for x in (e.operand, *(y for b in e.branches for y in b), e.otherwise) if x is not None)
        case Binary():
            return (e.left, e.right)
        case Not() | Minus():
            return (e.inner,)
        case InList():
            return (e.expr, *e.items)
        case InQuery() | IsNull():
            return (e.expr,)
        case Like():
            return (e.expr, e.pattern)
        case Between():
            return (e.expr, e.low, e.high)
    return ()
