"""Pages far into a total order, without sorting what lies before them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import EntitySpec, quoted
from .select import order, total_order

#: Bounds that a pass counts rows by, and how many rows are sampled for each of them.
BOUNDS, SAMPLED = 31, 40
#: So many rows (or four pages, if that is more) are sorted.
SORTED = 20_000

Order = list[tuple[str, bool]]


def _lit(value: Any, kind: T.DataType) -> Column:
    """A collected value as a literal of its column's type; times without a zone by their text, as Python's own would be taken for local ones."""
    return F.lit(str(value) if isinstance(kind, T.TimestampNTZType) and value is not None else value).cast(kind)


def _beyond(df: DataFrame, by: Order, bound: Sequence[Any]) -> Column:
    """Whether a row comes after ``bound``; nulls first ascending, last descending, as ``select.order`` sorts."""
    out = F.lit(False)
    for (name, ascending), b in reversed(list(zip(by, bound, strict=True))):
        c, value = quoted(name), _lit(b, df.schema[name].dataType)
        if b is None:
            after = c.isNotNull() if ascending else F.lit(False)
        else:
            after = F.coalesce(c > value, F.lit(False)) if ascending else F.coalesce(c < value, F.lit(True))
        out = after | (c.eqNullSafe(value) & out)
    return out


def page_by_rank(df: DataFrame, spec: EntitySpec, skip: int, take: int, *by: str | tuple[str, bool]) -> DataFrame:
    """What ``select.page`` gives, found by counting.

    A pass counts the rows between bounds, sampled from the rows that can still be on the page, and keeps the
    range that holds ranks ``skip`` to ``skip + take``; few passes leave few rows, and only those are exchanged and sorted.
    Rows before the page are read but never moved; the range is a filter on the scan. The key must be one:
    rows that repeat it cannot be told apart, so a range of nothing but such rows ends the passes. Counting runs when called.
    """
    if skip < 0 or take < 0:
        raise ValueError("skip and take must not be negative")
    full = [(b, True) if isinstance(b, str) else b for b in total_order(spec, by)]
    low = high = None  # rows after low, not after high
    left, rows = skip, df.count()
    while rows > max(SORTED, 4 * take) and left < rows:
        here = _range(df, full, low, high)
        share = min(1.0, (BOUNDS + 1) * SAMPLED / rows)
        sample = order(here.select(*[quoted(c) for c, _ in full]).sample(share), *full).collect()  # some thousand keys, whatever the table
        bounds = [tuple(r) for r in sample[SAMPLED::SAMPLED]][: 2 * BOUNDS]
        if not bounds:
            break
        number = reduce(lambda a, b: a + b, [_beyond(here, full, b).cast("int") for b in bounds])
        counts = dict(here.groupBy(number.alias("k")).count().collect())
        before = first = 0
        while first < len(bounds) and before + counts.get(first, 0) <= left:
            before += counts.get(first, 0)
            first += 1
        last, until = first, before + counts.get(first, 0)
        while last < len(bounds) and until < left + take:
            last += 1
            until += counts.get(last, 0)
        if until - before == rows:
            break
        low, high = bounds[first - 1] if first else low, bounds[last] if last < len(bounds) else high
        left, rows = left - before, until - before
    return order(_range(df, full, low, high), *full).offset(left).limit(take)


def _range(df: DataFrame, by: Order, low: Sequence[Any] | None, high: Sequence[Any] | None) -> DataFrame:
    """Rows after ``low`` and not after ``high``; bounds of the first column are said apart, so that a scan can use them."""
    (first, ascending) = by[0]
    for bound, is_low in ((low, True), (high, False)):
        if bound is None:
            continue
        df = df.where(_beyond(df, by, bound) if is_low else ~_beyond(df, by, bound))
        if bound[0] is not None and is_low == ascending:  # where nulls would not be let in either
            df = df.where(quoted(first) >= _lit(bound[0], df.schema[first].dataType))
    return df
