"""Joins by ranges as joins by equality: values and intervals meet in cells.

An interval has a level, the power of two that is its length or the next above, and lies in two
cells of that size, or three. A value is put once on each level that occurs. Both
meet by equality of level, cell and any further columns, so Spark joins them
by sort and hash, and the exact condition is tested there. A pair meets in one cell only.
Cells with at least a ``HOT`` part of all values (so few) are dealt by salts: their
values are spread, and their intervals repeated once a salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from ..spec import quoted

HOT, SALTS = 1 / 256, 16
TIMES = T.TimestampType | T.TimestampNTZType | T.DateType


def _number(df: DataFrame, name: str) -> Column:
    """A column as a double that keeps its order: times in seconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, TIMES):
        return quoted(name).cast("timestamp").cast("double")
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"{name} is neither a number nor a time")
    return quoted(name).cast("double")


def _cell(x: Column, level: Column) -> Column:
    # ascending in x, so whatever lies in an interval lies in a cell between those of its ends
    return F.floor(x / F.pow(F.lit(2.0), level))


def interval_join(points: DataFrame, intervals: DataFrame, value: str, low: str, high: str, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """All columns of points and intervals where ``low <= value <= high`` and the column pairs ``on`` (of points, of intervals) are equal.

    Values are compared as Spark compares them; a null end or value, NaN or an infinity meets nothing; an interval that
    ends before it begins is empty. Names of the two sides must differ. Counts of cells are written on the way, so this runs when called.
    """
    if clash := set(points.columns) & set(intervals.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    ends = intervals.withColumn("_a", _number(intervals, low)).withColumn("_b", _number(intervals, high))
    exact = (quoted(value) >= quoted(low)) & (quoted(value) <= quoted(high))
    return _meet(points, ends, _number(points, value), exact, on)


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, width: float, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """All columns of both sides where ``a`` and ``b`` differ by ``width`` at most (times: seconds) and the pairs ``on`` are equal; else as ``interval_join``."""
    if not width >= 0:
        raise ValueError("the width must be a number from 0 up")
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {sorted(clash)}")
    x = _number(right, b)
    reach = F.lit(float(width)) + F.abs(x) * 4e-16  # a hair more than the width: sums are rounded, the test is not
    ends = right.withColumn("_a", x - reach).withColumn("_b", x + reach)
    timed = isinstance(left.schema[a].dataType, TIMES)
    far = _number(left, a) - _number(right, b) if timed else quoted(a) - quoted(b)
    return _meet(left, ends, _number(left, a), F.abs(far) <= F.lit(width), on)


def _meet(points: DataFrame, ends: DataFrame, x: Column, exact: Column, on: Sequence[tuple[str, str]]) -> DataFrame:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    ends = ends.where(finite(F.col("_a")) & finite(F.col("_b")) & (F.col("_a") <= F.col("_b")))
    fine = F.ceil(F.log2(F.greatest(F.col("_b") - F.col("_a"), F.lit(2.0**-40))))
    # no cell so small that its number has no place in a long
    ends = ends.withColumn("_level", F.greatest(fine, F.ceil(F.log2(F.greatest(F.abs("_a"), F.abs("_b"), F.lit(2.0**-40)))) - 50).cast("int"))
    keys = [f"_k{i}" for i in range(len(on))]
    ends = ends.select("*", *[quoted(b).alias(k) for (_, b), k in zip(on, keys, strict=True)])
    levels = sorted(r[0] for r in ends.select("_level").distinct().collect())  # powers of two between the shortest and the longest
    right_columns = [c for c in ends.columns if not c.startswith("_")]
    if not levels:
        return points.join(ends.select(*[quoted(c) for c in right_columns]), F.lit(False))
    placed = points.withColumn("_x", x).where(finite(F.col("_x"))).select("*", *[quoted(a).alias(k) for (a, _), k in zip(on, keys, strict=True)])
    placed = placed.withColumn("_level", F.explode(F.array(*[F.lit(v) for v in levels]))).withColumn("_cell", _cell(F.col("_x"), F.col("_level")))
    spread = ends.withColumn("_cell", F.explode(F.sequence(_cell(F.col("_a"), F.col("_level")), _cell(F.col("_b"), F.col("_level")))))
    cell = ["_level", "_cell", *keys]
    counts = placed.groupBy(*cell).count()
    total = points.count() * len(levels)
    hot = written(counts.where(F.col("count") >= max(1000, HOT * total)).select(*[F.col(c).alias(f"h{c}") for c in cell]), "hot")  # 256 cells at most
    is_hot = [F.col(c).eqNullSafe(F.col(f"h{c}")) for c in cell]
    salted = lambda df: df.join(F.broadcast(hot), is_hot, "left")
    left = salted(placed).withColumn("_salt", F.when(F.col("h_cell").isNotNull(), F.pmod(F.xxhash64(*[quoted(c) for c in points.columns]), F.lit(SALTS)).cast("int")).otherwise(0))
    right = salted(spread).withColumn("_salt", F.explode(F.when(F.col("h_cell").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    left, right = left.drop(*[f"h{c}" for c in cell], "_x"), right.drop(*[f"h{c}" for c in cell], "_a", "_b")
    met = left.join(right, [*cell, "_salt"]).where(exact)
    return met.select(*[quoted(c) for c in points.columns], *[quoted(c) for c in right_columns])
