"""Condition trees: small immutable values that become one Column.

Comparison with null is ``IS NULL``; comparisons that have no meaning raise, and
nothing is dropped silently.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists longer than this are joined, not written into the expression.
LONG_LIST = 1_000


@dataclass(frozen=True)
class Col:
    """A column by name, with the alias of its frame if there are several: ``o.o_orderkey``."""

    name: str

    def column(self) -> Column:
        return F.col(self.name)


class Tree:
    def __and__(self, other: Tree) -> And:
        return And(self, other)

    def __or__(self, other: Tree) -> Or:
        return Or(self, other)

    def __invert__(self) -> Not:
        return Not(self)


COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
}
OTHERS = ("like", "contains", "in", "between", "is null", "is not null")


@dataclass(frozen=True)
class Cmp(Tree):
    """``left op right``; a side is a column name (left), Col, Column or constant; between: (low, high).

    ``ci`` compares text without case, as a database with such a collation does: both sides are lowered.
    """

    left: Any
    op: str
    right: Any = None
    ci: bool = False


class _Many(Tree):
    def __init__(self, *parts: Any):
        if not parts:
            raise ValueError(f"{type(self).__name__} of nothing")
        self.parts = parts

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.parts == other.parts

    def __hash__(self) -> int:
        return hash((type(self).__name__, self.parts))


class And(_Many):
    """All of the parts."""


class Or(_Many):
    """Any of the parts."""


@dataclass(frozen=True)
class Not(Tree):
    part: Any


def side(x: Any, left: bool = False) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, Col):
        return x.column()
    return F.col(x) if left and isinstance(x, str) else F.lit(x)


def to_column(tree: Any) -> Column:
    """The Column of a tree (a Column is one already)."""
    if isinstance(tree, Column):
        return tree
    if isinstance(tree, Not):
        return ~to_column(tree.part)
    if isinstance(tree, _Many):
        return reduce(and_ if isinstance(tree, And) else or_, [to_column(p) for p in tree.parts])
    if isinstance(tree, Cmp):
        return _compare(tree)
    raise TypeError(f"not a condition: {tree!r}")


def _compare(c: Cmp) -> Column:
    op = c.op.lower()
    if op not in COMPARE and op not in OTHERS:
        raise ValueError(f"unknown operator {c.op!r}")
    if op in ("is null", "is not null"):
        left = side(c.left, True)
        return left.isNull() if op == "is null" else left.isNotNull()
    if c.left is None and c.right is None:
        raise ValueError("null is compared with null")
    if c.left is None or c.right is None:
        if op not in ("=", "<>"):
            raise ValueError(f"{c.op} with null has no meaning")
        one = side(c.left, True) if c.right is None else side(c.right, True)
        return one.isNull() if op == "=" else one.isNotNull()
    fold = F.lower if c.ci else lambda x: x
    left = fold(side(c.left, True))
    if op == "like":
        return left.like(c.right.lower() if c.ci else c.right)
    if op == "contains":
        return left.contains(fold(side(c.right)))
    if op == "in":
        values = list(c.right)
        if any(v is None for v in values):
            raise ValueError("a list for IN holds null")
        return left.isin([v.lower() for v in values] if c.ci else values)
    if op == "between":
        low, high = c.right
        return left.between(fold(side(low)), fold(side(high)))
    return COMPARE[op](left, fold(side(c.right)))


def where(df: DataFrame, *trees: Any) -> DataFrame:
    """Rows for which every tree holds."""
    for t in trees:
        df = df.filter(to_column(t))
    return df


def where_in(df: DataFrame, column: str, values: Iterable[Any]) -> DataFrame:
    """Rows whose column is in the list: an expression if it is short, else a semi join with the distinct values."""
    values = list(values)
    if any(v is None for v in values):
        raise ValueError("a list for IN holds null")
    if len(values) <= LONG_LIST:
        return df.filter(F.col(column).isin(values))
    listed = df.sparkSession.createDataFrame([(v,) for v in set(values)], df.select(F.col(column).alias("_v")).schema)
    return df.join(listed, df[column] == listed["_v"], "left_semi")


def expect_one(df: DataFrame, *trees: Any) -> DataFrame:
    """The one row for which the trees hold; reading the result fails if there is none or are several.

    Two rows are asked for at most, so the check needs no second pass.
    """
    found = where(df, *trees).limit(2)
    names = found.columns
    one = found.agg(F.count("*").alias("_n"), *[F.first(F.col(f"`{c}`")).alias(c) for c in names])
    return one.filter(F.assert_true(F.col("_n") == 1, F.concat(F.lit("expected one row, found "), F.col("_n").cast("string"))).isNull()).select(*[F.col(f"`{c}`") for c in names])


def any_in(array: Any, test: Any) -> Column:
    """Whether an element of the array passes: a constant to be equal to, or a function of the element."""
    array = side(array, True)
    return F.exists(array, test) if callable(test) else F.array_contains(array, test)
