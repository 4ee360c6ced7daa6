"""Result columns that are no valid property names."""

from __future__ import annotations

from pyspark.sql import DataFrame


def property_name(column: str, prefix: str = "") -> str:
    """The column's name without spaces and without the given prefix: ``WWI Order ID`` is ``OrderID``."""
    return column.replace(" ", "").removeprefix(prefix.replace(" ", ""))


def to_property_names(df: DataFrame, prefix: str = "") -> DataFrame:
    """All columns renamed by ``property_name``; raises if two would be one."""
    new = {c: property_name(c, prefix) for c in df.columns}
    if len(set(new.values())) != len(new):
        raise ValueError("two columns would get one name")
    return df.withColumnsRenamed({a: b for a, b in new.items() if a != b})
