"""Projection, joins, aggregation, sorting, paging and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicate import And, Cmp, Col, Or, side, to_column
from ..spec import EntitySpec, quoted

AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}


# projection


def project(df: DataFrame, *columns: str | tuple[str, str] | Column) -> DataFrame:
    """The columns asked for, (name, alias) renamed; without any, all of them."""
    if not columns:
        return df
    return df.select(*[quoted(c[0]).alias(c[1]) if isinstance(c, tuple) else F.col(c) if isinstance(c, str) else c for c in columns])


def split_entities(df: DataFrame, **entities: Sequence[str]) -> DataFrame:
    """Several entities out of one row: a struct column for each name and its list of columns."""
    return df.select(*[F.struct(*[quoted(c) for c in cs]).alias(name) for name, cs in entities.items()])


def aggregate_column(function: str, column: str, alias: str) -> Column:
    """``FUNCTION(column) AS alias``; ``*`` counts rows, a column's count skips nulls."""
    f = AGGREGATES.get(function.lower())
    if f is None:
        raise ValueError(f"unknown aggregate {function!r}")
    if column == "*":
        if f is not F.count:
            raise ValueError(f"{function}(*) has no meaning")
        return F.count(F.lit(1)).alias(alias)
    return f(F.col(column)).alias(alias)


def scalar(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row of aggregates over everything; sums and extremes of nothing are null."""
    return df.agg(*aggregates)


# joins

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def pairs_condition(pairs: Sequence[tuple[str, str]], left: str, right: str) -> Column:
    """AND of equalities, paired by position, between two aliases."""
    if not pairs:
        raise ValueError("a join needs a column pair")
    return to_column(And(*[F.col(f"{left}.`{a}`") == F.col(f"{right}.`{b}`") for a, b in pairs]))


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] | Any, kind: str = "inner", aliases: tuple[str, str] = ("l", "r"), allow_non_equi: bool = False) -> DataFrame:
    """Join under two aliases, by column pairs or by any condition tree.

    A condition that shows no equality between the sides would compare all pairs of rows; it is refused
    unless ``allow_non_equi``. An equality is shown by column pairs, or in the outer conjunction of a
    tree by ``Cmp(.., "=", Col(..))`` of both aliases; a Column shows nothing of itself.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown join {kind!r}")
    a, b = left.alias(aliases[0]), right.alias(aliases[1])
    if isinstance(on, list | tuple):
        condition = pairs_condition(on, *aliases)
    else:
        if not allow_non_equi and not implies_equality(on, aliases):
            raise ValueError("the condition has no equality between the sides")
        condition = to_column(on)
    return a.join(b, condition, KINDS[kind])


def implies_equality(tree: Any, aliases: tuple[str, str]) -> bool:
    """Whether the tree has, in its outer conjunction, an equality of a column of each side."""
    if isinstance(tree, And):
        return any(implies_equality(p, aliases) for p in tree.parts)
    if not isinstance(tree, Cmp) or tree.op != "=":
        return False
    # a text is a column on the left and a constant on the right, as in where()
    left = tree.left if isinstance(tree.left, str) else getattr(tree.left, "name", "") if isinstance(tree.left, Col) else ""
    right = tree.right.name if isinstance(tree.right, Col) else ""
    return {n.partition(".")[0] for n in (left, right) if "." in n} == set(aliases)


# aggregation


def group(df: DataFrame, by: Sequence[str], aggregates: Sequence[Column], having: Any = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Group, aggregate, then filter groups by a tree over the aliases.

    ``keep`` names the columns of the result, so an aggregate of the condition need not be shown.
    """
    if not by:
        raise ValueError("grouping needs a column; use scalar() for all rows")
    out = df.groupBy(*by).agg(*aggregates)
    for tree in having if isinstance(having, list | tuple) else [having]:
        if tree is not None:
            out = out.filter(to_column(tree))
    return out.select(*keep) if keep else out


def count_by(df: DataFrame, *by: str, alias: str = "n") -> DataFrame:
    """Rows per group, largest first; groups of equal counts by key."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(alias)).orderBy(F.desc(alias), *by)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def as_map(grouped: DataFrame, key: str, value: str, alias: str = "map") -> DataFrame:
    """A small grouped result as one map; entries ordered by key, null keys left out."""
    return grouped.filter(F.col(key).isNotNull()).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(alias))


# sorting and paging


def order(df: DataFrame, *by: str | tuple[str, bool]) -> DataFrame:
    """Sort by columns or aliases, (name, False) descending; nulls first ascending, last descending."""
    return df.orderBy(*[F.col(b).asc() if isinstance(b, str) else F.col(b[0]).asc() if b[1] else F.col(b[0]).desc() for b in by])


def total_order(spec: EntitySpec, by: Sequence[str | tuple[str, bool]]) -> list[str | tuple[str, bool]]:
    """``by`` completed by the entity's key; raises without a key, for then a page is not repeatable."""
    if not spec.key:
        raise ValueError(f"{spec.name} has no key: the order is not total")
    named = {b if isinstance(b, str) else b[0] for b in by}
    return [*by, *[k for k in spec.key if k not in named]]


def first_n(df: DataFrame, spec: EntitySpec, n: int, *by: str | tuple[str, bool]) -> DataFrame:
    return order(df, *total_order(spec, by)).limit(n)


def page(df: DataFrame, spec: EntitySpec, skip: int, take: int, *by: str | tuple[str, bool]) -> DataFrame:
    """Rows ``skip`` to ``skip + take`` of a total order; costs grow with ``skip``, see ``page_after`` and ``paging.page_by_rank``."""
    return order(df, *total_order(spec, by)).offset(skip).limit(take)


def page_after(df: DataFrame, spec: EntitySpec, last: Any, take: int) -> DataFrame:
    """The ``take`` rows after a known key (a value, or a tuple for several columns); the filter reaches the scan."""
    if not spec.key:
        raise ValueError(f"{spec.name} has no key")
    values = last if isinstance(last, tuple) else (last,)
    if len(values) != len(spec.key):
        raise ValueError("as many values as key columns are needed")
    beyond = [And(*[F.col(k) == side(v) for k, v in zip(spec.key[:i], values, strict=False)], F.col(spec.key[i]) > side(values[i])) for i in range(len(values))]
    return df.filter(to_column(Or(*beyond))).orderBy(*spec.key).limit(take)


# set operations


def set_operation(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """union, union all, intersect, except, except all; both sides must have the same columns and types."""
    if left.dtypes != right.dtypes:
        raise ValueError(f"sides differ: {left.dtypes} and {right.dtypes}")
    ops = {
        "union": lambda: left.unionByName(right).distinct(),
        "union all": lambda: left.unionByName(right),
        "intersect": lambda: left.intersect(right),
        "except": lambda: left.subtract(right),
        "except all": lambda: left.exceptAll(right),
    }
    if kind not in ops:
        raise ValueError(f"unknown set operation {kind!r}")
    return ops[kind]()
