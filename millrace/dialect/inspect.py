"""Questions about a parsed query."""

from __future__ import annotations

from collections.abc import Iterator

from millrace.dialect.tree import Exists, Expr, InQuery, Over, Query, Scalar, inner_exprs


def walk(e: Expr) -> Iterator[Expr]:
    """An expression and all within it, subqueries aside."""
    yield e
    for inner in inner_exprs(e):
        yield from walk(inner)


def has_window_function(query: Query) -> bool:
    return any(isinstance(x, Over) for item in query.items for x in walk(item.expr))


def _has_subquery(e: Expr) -> bool:
    return any(isinstance(x, Scalar | InQuery | Exists) for x in walk(e))


def has_subquery_in_where(query: Query) -> bool:
    return query.where is not None and _has_subquery(query.where)


def has_subquery_in_select(query: Query) -> bool:
    return any(_has_subquery(item.expr) for item in query.items)


def table_names(query: Query) -> list[str]:
    """Tables that the query and its subqueries in FROM and WITH read, as written, without those that WITH defines."""
    defined = {c.name for c in query.ctes}
    out: list[str] = []
    for inner in (c.query for c in query.ctes):
        out += table_names(inner)
    for source in (query.source, *(j.source for j in query.joins)):
        if source.query is not None:
            out += table_names(source.query)
        elif source.table is not None:
            out.append(source.table)
    return [n for n in dict.fromkeys(out) if n not in defined]
