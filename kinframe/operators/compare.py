"""Comparing results and merging facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import quoted

NUMERIC = T.DoubleType | T.FloatType | T.DecimalType


def _equal(a: Column, b: Column, kind: T.DataType, tolerance: float) -> Column:
    same = a.eqNullSafe(b)
    return F.coalesce(same | (F.abs(a - b) <= tolerance), same) if tolerance and isinstance(kind, NUMERIC) else same


def _same_shape(left: DataFrame, right: DataFrame) -> None:
    if left.columns != right.columns:
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")


def differences_by_key(left: DataFrame, right: DataFrame, key: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Rows by key that are missing on a side or differ: key, ``only`` (left, right or null) and ``differing`` columns.

    Null equals null, also in keys; keys should be unique.
    """
    _same_shape(left, right)
    values = [f for f in left.schema.fields if f.name not in key]
    a = left.select(*[quoted(c).alias(f"l_{c}") for c in left.columns], F.lit(True).alias("_in_l"))
    b = right.select(*[quoted(c).alias(f"r_{c}") for c in right.columns], F.lit(True).alias("_in_r"))
    met = a.join(b, [quoted(f"l_{k}").eqNullSafe(quoted(f"r_{k}")) for k in key], "full")
    only = F.when(F.col("_in_r").isNull(), "left").when(F.col("_in_l").isNull(), "right")
    differing = F.when(only.isNotNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(~_equal(quoted(f"l_{f.name}"), quoted(f"r_{f.name}"), f.dataType, tolerance), F.lit(f.name)) for f in values]).cast("array<string>")))
    out = met.select(*[F.coalesce(quoted(f"l_{k}"), quoted(f"r_{k}")).alias(k) for k in key], only.alias("only"), differing.alias("differing"))
    return out.filter(F.col("only").isNotNull() | (F.size("differing") > 0))


def _counted(left: DataFrame, right: DataFrame, digits: int | None) -> DataFrame:
    """Distinct rows with their numbers of occurrences ``n_left`` and ``n_right``: one exchange of both sides."""
    _same_shape(left, right)

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*[(F.round(quoted(f.name), digits) if digits is not None and isinstance(f.dataType, NUMERIC) else quoted(f.name)).alias(f.name) for f in df.schema.fields])

    names = [quoted(c) for c in left.columns]
    both = shaped(left).select(*names, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(shaped(right).select(*names, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    return both.groupBy(*names).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))


def differences(left: DataFrame, right: DataFrame, digits: int | None = None) -> DataFrame:
    """As multisets: rows whose numbers of occurrences differ, with ``n_left`` and ``n_right``.

    ``digits`` rounds doubles and decimals before they are compared: the tolerance of rows without a key.
    """
    return _counted(left, right, digits).filter("n_left <> n_right")


def difference_counts(left: DataFrame, right: DataFrame, digits: int | None = None) -> DataFrame:
    """One row (n_left, n_right, n_differences): the rows of both sides, and how many distinct rows ``differences`` has."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_left", "n_right")]
    return _counted(left, right, digits).agg(*sums, F.count_if(F.col("n_left") != F.col("n_right")).alias("n_differences"))


def differences_in_order(left: DataFrame, right: DataFrame, order_by: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """In order: rows are numbered by ``order_by`` on each side and compared position by position."""
    from .integrity import dense_keys

    _same_shape(left, right)
    return differences_by_key(dense_keys(left, order_by, "position"), dense_keys(right, order_by, "position"), ["position"], tolerance)


def merge_facts(facts: DataFrame, subject: Sequence[str] = ("table_name", "column_name", "fact")) -> DataFrame:
    """(subject.., value, source, conflict) of (subject.., value, source, priority): the value of least priority number wins.

    Null values say nothing; conflict: sources give different values. Equal priorities: the least value.
    """
    said = facts.filter(F.col("value").isNotNull())
    best = F.min(F.struct("priority", "value", "source"))
    return said.groupBy(*subject).agg(best.alias("b"), (F.count_distinct("value") > 1).alias("conflict")).select(*subject, F.col("b.value").alias("value"), F.col("b.source").alias("source"), "conflict")
