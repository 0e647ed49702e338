"""Fluent query builder: an immutable description that turns into one DataFrame plan.

Filters, projections, order and paging are kept as Catalyst columns, so they reach the scan
as pushed filters and pruned columns; nothing runs before an action.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_]\w*$")


class QueryError(ValueError):
    """A query that cannot be described: an unknown operator or column, or more rows than asked for."""


def _contains_all(c: Column, needles: Any) -> Column:
    wanted = list(needles) if isinstance(needles, (list, tuple, set)) else [needles]
    have = F.coalesce(c, F.array().cast("array<string>"))
    return reduce(lambda a, b: a & b, (F.array_contains(have, F.lit(n)) for n in wanted), F.lit(True))


def _is(c: Column, v: Any) -> Column:
    return c.isNull() if v is None else c.eqNullSafe(F.lit(v))


OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "eq": lambda c, v: c == F.lit(v),
    "neq": lambda c, v: c != F.lit(v),
    "gt": lambda c, v: c > F.lit(v),
    "gte": lambda c, v: c >= F.lit(v),
    "lt": lambda c, v: c < F.lit(v),
    "lte": lambda c, v: c <= F.lit(v),
    "in": lambda c, v: c.isin(*v) if len(v) else F.lit(False),
    "is": _is,
    "not_is": lambda c, v: ~_is(c, v),
    "like": lambda c, v: c.ilike(v),
    "ilike": lambda c, v: c.ilike(v),
    "cs": _contains_all,
}


def _split_outside(text: str) -> list[str]:
    """Comma-separated parts, commas inside brackets left alone."""
    out, depth, part = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [p.strip() for p in [*out, part] if p.strip()]


def _value(text: str) -> Any:
    low = text.lower()
    if low == "null":
        return None
    if low in ("true", "false"):
        return low == "true"
    return text


def parse_or(expr: str) -> Column | None:
    """'col.op.value,col.in.(a,b)' as a disjunction of eq, neq, is and in; malformed parts are skipped.

    None where no part can be read, which stands for no condition.
    """
    terms = []
    for part in _split_outside(expr):
        m = re.match(r"^(\w+)\.(eq|neq|is|in)\.(.*)$", part, re.S)
        if not m:
            continue
        name, op, raw = m.groups()
        value: Any = [v.strip() for v in _split_outside(raw.strip("()"))] if op == "in" else _value(raw)
        if op in ("eq", "neq") and value is None:
            value = raw
        terms.append(OPERATORS[op](F.col(name), value))
    return reduce(lambda a, b: a | b, terms) if terms else None


@dataclass(frozen=True)
class Query:
    """``Query(df).select('a').eq('b', 1).order('a').range(0, 9).frame()``."""

    source: DataFrame
    columns: tuple[str, ...] = ()
    clauses: tuple[Column, ...] = ()
    orders: tuple[Column, ...] = ()
    offset: int = 0
    length: int | None = None

    def select(self, *names: str) -> Query:
        """Projection; '*' or nothing keeps all columns.  Unknown names are an error, not a silent '*'."""
        names = tuple(n.strip() for part in names for n in part.split(",") if n.strip() and n.strip() != "*")
        bad = [n for n in names if not _NAME.match(n) or n not in self.source.columns]
        if bad:
            raise QueryError(f"no such column: {', '.join(bad)}")
        return replace(self, columns=names)

    def filter(self, name: str, op: str, value: Any) -> Query:
        if op not in OPERATORS:
            raise QueryError(f"no such operator: {op}")
        if name not in self.source.columns:
            raise QueryError(f"no such column: {name}")
        return replace(self, clauses=(*self.clauses, OPERATORS[op](F.col(name), value)))

    def __getattr__(self, op: str):
        op = {"in_": "in", "is_": "is"}.get(op, op)
        if op in OPERATORS:
            return lambda name, value: self.filter(name, op, value)
        raise AttributeError(op)

    def optional(self, name: str, op: str, value: Any) -> Query:
        """The clause only where a value is given."""
        return self if value is None else self.filter(name, op, value)

    def or_(self, expr: str) -> Query:
        c = parse_or(expr)
        return self if c is None else replace(self, clauses=(*self.clauses, c))

    def search(self, text: str | None, *names: str) -> Query:
        """Lower-case substring in any of the columns."""
        if not text or not text.strip():
            return self
        any_of = reduce(lambda a, b: a | b, (F.lower(F.col(n)).contains(text.strip().lower()) for n in names))
        return replace(self, clauses=(*self.clauses, any_of))

    def order(self, name: str, ascending: bool = True) -> Query:
        c = F.col(name)
        return replace(self, orders=(*self.orders, c.asc_nulls_last() if ascending else c.desc_nulls_last()))

    def limit(self, n: int) -> Query:
        return replace(self, length=n)

    def range(self, first: int, last: int) -> Query:
        """Rows first..last, both included; overrides limit."""
        return replace(self, offset=first, length=max(0, last - first + 1))

    def page_after(self, name: str, cursor: Any, size: int) -> Query:
        """Keyset page: rows below the cursor, greatest first; a top-k, never an offset scan."""
        q = self if cursor is None else self.filter(name, "lt", cursor)
        return q.order(name, ascending=False).limit(size)

    def matching(self) -> DataFrame:
        return reduce(lambda df, c: df.where(c), self.clauses, self.source)

    def frame(self) -> DataFrame:
        df = self.matching()
        if self.orders:
            df = df.orderBy(*self.orders)
        if self.offset:
            df = df.offset(self.offset)
        if self.length is not None:
            df = df.limit(self.length)
        return df.select(*self.columns) if self.columns else df

    def count(self) -> int:
        """Rows that match, whatever the page."""
        return self.matching().count()

    def single(self):
        rows = self.frame().limit(2).collect()
        if len(rows) != 1:
            raise QueryError(f"{'no row' if not rows else 'several rows'} where one was expected")
        return rows[0]

    def maybe_single(self):
        rows = self.frame().limit(2).collect()
        if len(rows) > 1:
            raise QueryError("several rows where at most one was expected")
        return rows[0] if rows else None


def union_first(frames: Iterable[DataFrame], key: str) -> DataFrame:
    """Union of frames, one row a key; the frame named first wins, then the smallest row.

    A partial aggregate over structs, so no window sorts the union.
    """
    tagged = [df.withColumn("_src", F.lit(i)) for i, df in enumerate(frames)]
    both = reduce(DataFrame.unionByName, tagged)
    rest = [c for c in both.columns if c not in (key, "_src")]
    best = both.groupBy(key).agg(F.min(F.struct("_src", *rest)).alias("_m"))
    return best.select(key, *(F.col(f"_m.{c}").alias(c) for c in rest))


def may_open(owner: Column, shared_with: Column, user: Column, email: Column) -> Column:
    """Whether a user owns a row or finds their e-mail address, in any case, among those it is shared with."""
    mine = F.exists(shared_with, lambda x: F.lower(x) == F.lower(email))
    return F.coalesce(owner == user, F.lit(False)) | (F.coalesce(F.length(email), F.lit(0)) > 0) & F.coalesce(mine, F.lit(False))


def clamp_limit(n: int | None, default: int = 50, least: int = 1, most: int = 100) -> int:
    """A row limit within its bounds; the default where none is given."""
    return default if n is None else max(least, min(most, int(n)))
