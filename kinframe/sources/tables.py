"""Scan, conform, parameterised SQL, incremental extracts, writing."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import EntitySpec, quoted


def scan(spark: SparkSession, spec: EntitySpec, folder: str | None = None) -> DataFrame:
    """All columns of the entity's table: a Parquet path below ``folder``, or a catalog table."""
    if folder is not None:
        return spark.read.parquet(f"{folder.rstrip('/')}/{spec.table_name}.parquet")
    return spark.table(f"{spec.schema}.{spec.table_name}" if spec.schema else spec.table_name)


def sql_params(spark: SparkSession, text: str, args: dict[str, Any] | None = None, **frames: DataFrame) -> DataFrame:
    """SQL with named parameters (``:t``; arrays too) and frames (``{name}``); values never enter the text."""
    bound = {k: F.array(*[F.lit(x) for x in v]) if isinstance(v, list | tuple) else v for k, v in (args or {}).items()}
    return spark.sql(text, args=bound, **frames)


def conform(df: DataFrame, spec: EntitySpec, lenient: bool = False) -> DataFrame:
    """The entity's properties in order: picked, renamed, cast, defaults for nulls.

    Strict: a value that does not cast fails the read. Lenient: it becomes null, and a last
    column ``conform_errors`` names the properties so affected. A missing column raises, unless
    the property has a default or may be null.
    """
    have = set(df.columns)
    out: list[Column] = []
    errors: list[Column] = []
    for p in spec.properties:
        if p.raw not in have:
            if p.default is None and not p.nullable:
                raise ValueError(f"{spec.name}.{p.name}: no column {p.raw!r}")
            value: Column = F.lit(None).cast(p.type)
        elif lenient:
            value = quoted(p.raw).try_cast(p.type)
            errors.append(F.when(quoted(p.raw).isNotNull() & value.isNull(), F.lit(p.name)))
        else:
            value = quoted(p.raw).cast(p.type)
        if p.default is not None:
            value = F.coalesce(value, F.lit(p.default).cast(p.type))
        out.append(value.alias(p.name, metadata=dict(p.facts)) if p.facts else value.alias(p.name))
    if lenient:
        out.append(F.array_compact(F.array(*errors)).cast(T.ArrayType(T.StringType())).alias("conform_errors"))
    return df.select(*out)


def extract_changes(orders: DataFrame, lines: DataFrame, last: Any, new: Any, *, changed: str, key: tuple[str, str], quantity: str, price: str, tax: str, scale: int = 2) -> DataFrame:
    """Lines of orders changed in the half-open window (last, new], with ``total_including_tax``.

    The bounds are our choice: the first extract's end is the second one's start and no change is
    seen twice. total = quantity * price * (1 + tax), in decimals, rounded to ``scale``. The window is a
    filter on the scan of ``orders``; no row outside it is exchanged.
    """
    span = (F.col(changed) > F.lit(last)) & (F.col(changed) <= F.lit(new))
    money = lambda c: F.col(c).cast("decimal(18,4)")
    total = F.round(F.col(quantity).cast("decimal(12,2)") * money(price) * (F.lit(1) + F.col(tax).cast("decimal(6,4)")), scale)
    joined = orders.filter(span).alias("o").join(lines.alias("l"), F.col(f"o.{key[0]}") == F.col(f"l.{key[1]}"))
    return joined.select("o.*", *[F.col(f"l.`{c}`") for c in lines.columns if c not in orders.columns], total.alias("total_including_tax"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark report as text columns: ``;``-separated, quoted numbers with units; see ``measure.with_unit``."""
    return spark.read.csv(path, sep=";", header=True, quote='"', escape='"')


def write_measurements(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), kind: str = "parquet", mode: str = "error") -> None:
    """Write a measurement table as Parquet or CSV (``;``-separated, with header)."""
    out = df.write.mode(mode)
    if partition_by:
        out = out.partitionBy(*partition_by)
    if kind == "parquet":
        out.parquet(path)
    elif kind == "csv":
        out.option("header", True).option("sep", ";").csv(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def write_clustered(df: DataFrame, path: str, by: Sequence[str], row_group_bytes: int = 32 << 20, page_rows: int = 2_000, bloom: Sequence[str] = ()) -> None:
    """Write Parquet files sorted by ``by``, one range a file, so that a lookup by ``by`` seeks instead of scanning.

    Files and row groups hold ranges that do not overlap, and pages their bounds, so a filter on the
    first columns of ``by`` reads the pages that can hold the value. ``bloom``: further columns to look values up by; a Bloom filter a
    row group tells which groups cannot have them.
    """
    names = [quoted(c) for c in by]
    out = df.repartitionByRange(*names).sortWithinPartitions(*names).write.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.row.count.limit", str(page_rows))
    for c in bloom:
        # filters are not made for columns that dictionaries describe already
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.enable.dictionary#{c}", "false")
    out.parquet(path)
