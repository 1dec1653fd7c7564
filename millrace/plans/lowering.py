"""Tree to DataFrame: names are bound, nulls get the dialect's meaning, Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.dialect.grammar import AGGREGATES, RANKINGS
from millrace.dialect.tree import (
    Between, Binary, Call, Case, Exists, Expr, InList, InQuery, IsNull, Item, Like, Literal, Minus, Name, Not, Over, Query, Scalar, SortKey, Source, Star, inner_exprs,
)
from millrace.errors import BindingProblem, FunctionProblem
from millrace.functions import Arg, Registry
from millrace.operators import aggregates, joins, ordering, windows
from millrace.operators.predicates import comparable, equal, family, settled, unequal
from millrace.plans.scope import Entry, Relation, Tables

COMPARISONS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b}


def is_aggregate(e: Expr) -> bool:
    """A call of an aggregate; MIN and MAX of two arguments are scalar functions."""
    return isinstance(e, Call) and e.name.upper() in AGGREGATES and len(e.args) == 1


def has_aggregate(e: Expr) -> bool:
    if isinstance(e, Over):
        return any(has_aggregate(x) for x in inner_exprs(e))
    return is_aggregate(e) or any(has_aggregate(x) for x in inner_exprs(e))


@dataclass
class Binder:
    """Expressions to Columns over one relation, within the relations of the queries around it."""

    lowering: Lowering
    relation: Relation
    tables: Tables
    outer: list[Relation] = field(default_factory=list)
    known: dict[Expr, Column] = field(default_factory=dict)  # what grouping has computed
    grouped: bool = False

    # -- values

    def value(self, e: Expr) -> Column:
        if e in self.known:
            return self.known[e]
        match e:
            case Literal():
                return F.lit(e.value)
            case Name():
                return self.name(e.text)
            case Minus():
                return -self.value(e.inner)
            case Binary() if e.op in ARITHMETIC or e.op == "||":
                dashed = self.dashed(e)
                if dashed is not None:
                    return dashed
                if e.op == "||":
                    return F.concat(self.arg(e.left).text(), self.arg(e.right).text())
                a, b = self.arg(e.left), self.arg(e.right)
                number = lambda x: x.column.cast("double") if isinstance(x.type, T.StringType) else x.column
                return ARITHMETIC[e.op](number(a), number(b))
            case Call():
                return self.call(e)
            case Over():
                return self.over(e)
            case Case():
                return self.case(e)
            case Scalar():
                return self.lowering.query(e.query, self.tables, [self.relation, *self.outer]).scalar()
            case Star():
                raise BindingProblem("* can't stand here")
        return self.test(e)

    def name(self, text: str) -> Column:
        entry = self.relation.find(text)
        if entry is not None:
            if self.grouped:
                raise BindingProblem(f"column {text} must appear in GROUP BY clause or be used in an aggregate")
            return F.col(entry.unique)
        for relation in self.outer:
            entry = relation.find(text)
            if entry is not None:
                return F.col(entry.unique).outer()
        have = ", ".join(x.visible for x in self.relation.entries)
        raise BindingProblem(f"column {text} not found; there are: {have}")

    def dashed(self, e: Binary) -> Column | None:
        """``a-b`` without white space is a column's name where there is such a column."""
        text = self._joined(e)
        if text is not None and self.relation.find(text) is not None:
            return self.name(text)
        return None

    def _joined(self, e: Expr) -> str | None:
        if isinstance(e, Name):
            return e.text
        if isinstance(e, Binary) and e.tight and e.op in "-/":
            left, right = self._joined(e.left), self._joined(e.right)
            return None if left is None or right is None else left + e.op + right
        return None

    def type_of(self, e: Expr, column: Column) -> T.DataType | None:
        match e:
            case Literal():
                return {str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(type(e.value))
            case Name():
                for relation in (self.relation, *self.outer):
                    entry = relation.find(e.text)
                    if entry is not None:
                        return entry.type
        try:
            return self.relation.df.select(column).schema[0].dataType
        except AnalysisException:
            return None

    def arg(self, e: Expr) -> Arg:
        column = self.value(e)
        if isinstance(e, Literal):
            return Arg(column, self.type_of(e, column), e.value, True)
        return Arg(column, self.type_of(e, column))

    def call(self, e: Call) -> Column:
        if is_aggregate(e):
            raise BindingProblem(f"aggregate {e.name} can't stand here")
        return self.lowering.functions.get(e.name)([self.arg(a) for a in e.args])

    def case(self, e: Case) -> Column:
        out = None
        for condition, result in e.branches:
            test = self.test(condition) if e.operand is None else self.compared("=", e.operand, condition)
            out = (F if out is None else out).when(test, self.value(result))
        return out if e.otherwise is None else out.otherwise(self.value(e.otherwise))

    def over(self, e: Over) -> Column:
        name = e.call.name.upper()
        partition = [self.value(x) for x in e.partition]
        order = [self.sort(k) for k in e.order]
        frame = (e.frame.by_rows, e.frame.start, e.frame.end) if e.frame else None
        if name in RANKINGS:
            literals = [a.value if isinstance(a, Literal) else ... for a in e.call.args]
            return windows.ranking(name, [self.value(a) for a in e.call.args], literals, partition, order, frame)
        if not is_aggregate(e.call):
            raise FunctionProblem(f"{e.call.name} is no window function")
        w = windows.spec(partition, order, False)
        return self.aggregate(e.call).over(windows.framed(w, *frame) if frame else w)

    def aggregate(self, e: Call) -> Column:
        (inner,) = e.args
        if isinstance(inner, Star):
            return aggregates.aggregate(e.name, None, None)
        column = self.value(inner)
        return aggregates.aggregate(e.name, column, self.type_of(inner, column))

    def sort(self, key: SortKey) -> Column:
        return ordering.sort_column(self.value(key.expr), key.descending, key.nulls_first)

    # -- predicates

    def test(self, e: Expr, under_not: bool = False) -> Column:
        """A condition.  Under NOT, what is unknown counts as false."""
        sure: Callable[[Column], Column] = settled if under_not else lambda p: p
        if e in self.known:
            return sure(self.known[e])
        match e:
            case Binary() if e.op in ("AND", "OR"):
                a, b = self.test(e.left, under_not), self.test(e.right, under_not)
                return a & b if e.op == "AND" else a | b
            case Binary() if e.op in ("=", "!="):
                return self.compared(e.op, e.left, e.right)
            case Binary() if e.op in COMPARISONS:
                return sure(self.compared(e.op, e.left, e.right))
            case Not():
                return ~self.test(e.inner, True)
            case InList():
                own = self.arg(e.expr)
                for x in e.items:
                    if isinstance(x, Literal):
                        comparable(own.type, self.type_of(x, own.column))
                p = own.column.isin(*[x.value if isinstance(x, Literal) else self.value(x) for x in e.items])
                return ~settled(p) if e.negated else sure(p)
            case Like():
                pattern = self.arg(e.pattern)
                p = self.arg(e.expr).text().like(pattern.literal) if pattern.is_literal else F.like(self.arg(e.expr).text(), pattern.column)
                return ~p if e.negated else sure(p)
            case Between():
                a, lo, hi = self.arg(e.expr), self.arg(e.low), self.arg(e.high)
                comparable(a.type, lo.type)
                comparable(a.type, hi.type)
                p = a.column.between(lo.column, hi.column)
                return ~settled(p) if e.negated else sure(p)
            case IsNull():
                column = self.value(e.expr)
                return column.isNotNull() if e.negated else column.isNull()
            case InQuery():
                return self.in_query(e)
            case Exists():
                found = self.lowering.query(e.query, self.tables, [self.relation, *self.outer]).exists()
                return ~found if e.negated else found
        column = self.value(e)
        kind = self.type_of(e, column)
        if kind is not None and family(kind) not in ("bool", None):
            raise BindingProblem(f"a condition must be true or false, not {kind.simpleString()}")
        return sure(column)

    def compared(self, op: str, left: Expr, right: Expr) -> Column:
        a, b = self.arg(left), self.arg(right)
        comparable(a.type, b.type)
        if op == "=":
            return equal(a.column, b.column)
        if op == "!=":
            return unequal(a.column, b.column)
        if isinstance(a.type, T.BooleanType) or isinstance(b.type, T.BooleanType):
            return F.lit(False)  # booleans have no order in comparisons
        return COMPARISONS[op](a.column, b.column)

    def in_query(self, e: InQuery) -> Column:
        """Null is in a list that has a null; a null in the list doesn't spoil NOT IN."""
        inner = Relation.of(self.lowering.query(e.query, self.tables, [self.relation, *self.outer]), None)
        own = e.expr
        outer = Binder(self.lowering, inner, self.tables, [self.relation, *self.outer])
        if isinstance(own, Name) and self.relation.find(own.text) is not None:
            column = F.col(self.relation.find(own.text).unique).outer()
        elif isinstance(own, Literal):
            column = F.lit(own.value)
        else:
            column = outer.value(own)
        if isinstance(own, Name):
            comparable(self.type_of(own, column), inner.entries[0].type)
        found = inner.df.where(F.col(inner.entries[0].unique).eqNullSafe(column)).exists()
        return ~found if e.negated else found


class Lowering:
    """Queries to DataFrames.  ``read`` opens a table that no WITH defines."""

    def __init__(self, read: Callable[[str], DataFrame], functions: Registry) -> None:
        self.read, self.functions = read, functions

    def query(self, q: Query, tables: Tables | None = None, outer: list[Relation] | None = None) -> DataFrame:
        outer = outer or []
        tables = self.with_tables(q, tables)
        relation = self.source(q.source, tables, outer)
        for join in q.joins:
            right = self.source(join.source, tables, outer)
            both = relation.merged(right, relation.df)
            on = None
            if join.on is not None:
                pair = Relation(relation.df.crossJoin(right.df), both.entries)  # for types only
                on = Binder(self, pair, tables, outer).test(join.on)
            relation = Relation(joins.joined(relation.df, right.df, join.kind, on), both.entries)
        if q.where is not None:
            if has_aggregate(q.where):
                raise BindingProblem("aggregates can't stand in WHERE")
            test = Binder(self, relation, tables, outer).test(q.where)
            relation = Relation(relation.df.where(test), relation.entries)
        items = self.expanded(q, relation)
        aggregated = bool(q.group_by) or any(has_aggregate(i.expr) for _, i in items)
        if aggregated:
            if any(isinstance(i.expr, Star) for i in q.items):
                raise BindingProblem("SELECT * can't stand with GROUP BY or aggregates")
            return self.grouped(q, items, relation, tables, outer)
        return self.finished(q, items, Binder(self, relation, tables, outer), q.having)

    def with_tables(self, q: Query, tables: Tables | None) -> Tables:
        names = [c.name for c in q.ctes]
        for i, name in enumerate(names):
            if name in names[:i]:
                raise BindingProblem(f"duplicate CTE name in same WITH clause: {name}")
        own = Tables(parent=tables, pending=list(names))
        for cte in q.ctes:
            own.pending.remove(cte.name)
            own.current = cte.name
            df = self.query(cte.query, own)
            own.own[cte.name] = df
            own.current = None
        return own

    def source(self, s: Source, tables: Tables, outer: list[Relation]) -> Relation:
        if s.query is not None:
            return Relation.of(self.query(s.query, tables, outer), s.alias)
        if not s.table:
            raise BindingProblem("no data source specified")
        df = tables.find(s.table)
        return Relation.of(self.read(s.table) if df is None else df, s.alias)

    def expanded(self, q: Query, relation: Relation) -> list[tuple[str, Item]]:
        """Output names and items, with * spelled out."""
        out: list[tuple[str, Item]] = []
        for item in q.items:
            if isinstance(item.expr, Star):
                out += [(e.visible, Item(Name(e.visible))) for e in relation.entries]
            else:
                out.append((item.alias or self.default_name(item.expr, len(out), relation), item))
        seen: dict[str, int] = {}
        named = []
        for name, item in out:
            seen[name] = seen.get(name, 0) + 1
            named.append((name if seen[name] == 1 else f"{name}_{seen[name]}", item))
        return named

    @staticmethod
    def default_name(e: Expr, n: int, relation: Relation) -> str:
        match e:
            case Name():
                return e.text
            case Over():
                return e.call.name.upper()
            case Call() if is_aggregate(e):
                return e.name.lower()
            case Call():
                return e.name
            case Literal():
                return f"literal_{n}"
            case Binary() if e.tight:
                text = Binder(None, relation, None)._joined(e)
                if text and relation.find(text) is not None:
                    return text
        return f"col_{n}"

    def grouped(self, q: Query, items: list[tuple[str, Item]], relation: Relation, tables: Tables, outer: list[Relation]) -> DataFrame:
        """One hash aggregation, partial before the shuffle; then the items over keys and aggregates."""
        binder = Binder(self, relation, tables, outer)
        aliases = {name: i.expr for name, i in items if i.alias}
        keys: list[Expr] = []
        for k in q.group_by:
            if isinstance(k, Literal) and isinstance(k.value, int) and 1 <= k.value <= len(items):
                k = items[k.value - 1][1].expr
            elif isinstance(k, Name) and relation.find(k.text) is None and k.text in aliases:
                k = aliases[k.text]
            keys.append(k)
        calls: list[Call] = []

        def collect(e: Expr) -> None:
            if isinstance(e, Over):
                for x in inner_exprs(e):
                    collect(x)
            elif is_aggregate(e):
                if e not in calls:
                    calls.append(e)
            else:
                for x in inner_exprs(e):
                    collect(x)

        for e in [*(i.expr for _, i in items), *([q.having] if q.having is not None else []), *(k.expr for k in q.order_by)]:
            collect(e)
        key_columns = [binder.value(k).alias(f"g{i}") for i, k in enumerate(keys)]
        agg_columns = [binder.aggregate(c).alias(f"a{i}") for i, c in enumerate(calls)]
        if not agg_columns:
            df = relation.df.select(*key_columns).distinct()
        elif key_columns:
            df = relation.df.groupBy(*key_columns).agg(*agg_columns)
        else:
            df = relation.df.agg(*agg_columns)
        known: dict[Expr, Column] = {k: F.col(f"g{i}") for i, k in enumerate(keys)} | {c: F.col(f"a{i}") for i, c in enumerate(calls)}
        for i, k in enumerate(keys):  # a key under its other name
            if isinstance(k, Name):
                entry = relation.find(k.text)
                if entry is not None:
                    known[Name(entry.visible)] = F.col(f"g{i}")
                    if relation.find(entry.name) == entry:
                        known[Name(entry.name)] = F.col(f"g{i}")
        over = Binder(self, Relation(df, relation.entries), tables, outer, known, grouped=True)
        return self.finished(q, items, over, q.having)

    def finished(self, q: Query, items: list[tuple[str, Item]], binder: Binder, having: Expr | None) -> DataFrame:
        """HAVING, projection, DISTINCT, ORDER BY, OFFSET and LIMIT."""
        outputs: dict[Expr, Column] = {}
        columns = []
        for name, item in items:
            column = binder.test(item.expr) if _is_test(item.expr) else binder.value(item.expr)
            columns.append(column.alias(name))
            outputs.setdefault(Name(name), column)
        if having is not None:
            named = Binder(self, binder.relation, binder.tables, binder.outer, outputs | binder.known, binder.grouped)
            binder.relation = Relation(binder.relation.df.where(named.test(having)), binder.relation.entries)
        df = binder.relation.df
        names = [name for name, _ in items]
        quoted = [F.col(f"`{n.replace('`', '``')}`") for n in names]
        if q.distinct:
            df = df.select(*columns).distinct()
        if not q.order_by:
            return ordering.cut(df if q.distinct else df.select(*columns), q.limit, q.offset)
        by_name = dict(zip(names, quoted, strict=True))
        keys, hidden = [], []
        for i, k in enumerate(q.order_by):
            if isinstance(k.expr, Name) and k.expr.text in by_name:
                column = by_name[k.expr.text]
            elif isinstance(k.expr, Literal) and isinstance(k.expr.value, int) and 1 <= k.expr.value <= len(quoted):
                column = quoted[k.expr.value - 1]
            elif q.distinct:
                raise BindingProblem("with SELECT DISTINCT, ORDER BY must use output columns")
            else:
                named = Binder(self, binder.relation, binder.tables, binder.outer, binder.known | {x: c for x, c in outputs.items() if binder.relation.find(x.text) is None}, binder.grouped)
                hidden.append(named.value(k.expr).alias(f"__order_{i}"))
                column = F.col(f"__order_{i}")
            keys.append(ordering.sort_column(column, k.descending, k.nulls_first))
        if not q.distinct:
            df = df.select(*columns, *hidden)
        df = ordering.cut(df.orderBy(*keys), q.limit, q.offset)
        return df.select(*quoted) if hidden else df


def _is_test(e: Expr) -> bool:
    return isinstance(e, Not | InList | InQuery | Like | Between | IsNull | Exists) or isinstance(e, Binary) and e.op not in ARITHMETIC and e.op != "||"


__all__ = ["Binder", "Entry", "Lowering", "has_aggregate", "is_aggregate"]
