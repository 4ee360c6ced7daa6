"""Metadata and profiles as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN_ROWS = "table_schema string, table_name string, column_name string, position int, data_type string, nullable boolean"


def column_types(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "") -> DataFrame:
    """A row for each column of each named frame; only schemas are read."""
    rows = [(schema, name, f.name, i, f.dataType.simpleString(), f.nullable) for name, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, COLUMN_ROWS)


def column_facts(spark: SparkSession, tables: dict[str, DataFrame], schema: str = "") -> DataFrame:
    """``column_types`` with n_rows and n_nulls from the data: one aggregate a table."""
    counts = None
    for name, df in tables.items():
        wide = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(df.columns)])
        per = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("v")) for i, c in enumerate(df.columns)])).alias("f")
        one = wide.select("n", per).select(F.lit(name).alias("table_name"), "f.column_name", F.col("n").alias("n_rows"), (F.col("n") - F.col("f.v")).alias("n_nulls"))
        counts = one if counts is None else counts.unionByName(one)
    types = column_types(spark, tables, schema)
    return types if counts is None else types.join(counts, ["table_name", "column_name"], "left")


def find_table(tables: DataFrame, name: str, preferred_schema: str = "") -> DataFrame:
    """The one best match of (table_schema, table_name): exact before with or without a last ``s``, then the preferred schema, then by name.

    Names are compared without case; no match gives no row.
    """
    low, wanted = F.lower("table_name"), name.lower()
    rank = F.when(low == wanted, 0).when((low == wanted + "s") | (F.concat(low, F.lit("s")) == wanted), 1)
    place = F.struct(rank.alias("rank"), (F.col("table_schema") != preferred_schema).cast("int").alias("other"), F.col("table_schema"), F.col("table_name"))
    found = tables.select("table_schema", "table_name").distinct().filter(rank.isNotNull())
    return found.agg(F.min(place).alias("best")).filter("best is not null").select("best.table_schema", "best.table_name")


def profile(df: DataFrame, table: str = "", exact: bool = False) -> DataFrame:
    """Facts of each column from the data, a row a column: (table_name, column_name, n_rows, n_nulls, n_distinct, max_length, max_precision, max_scale, key_candidate).

    One pass, unpivoted after; distinct counts are estimates unless ``exact``, and a key candidate
    (no null, all distinct) is only claimed from exact ones. Exact counts read each column once more, alone, and
    combine its values before they are exchanged. max_length: of text; precision and scale: of decimals.
    """
    apart = None
    per = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        countable = not isinstance(f.dataType, T.MapType | T.VariantType)
        distinct = F.approx_count_distinct(c) if countable and not exact else F.lit(None)
        if countable and exact:
            one = df.select(c.alias("v")).where("v is not null").distinct().agg(F.lit(f.name).alias("_column"), F.count(F.lit(1)).alias("_distinct"))
            apart = one if apart is None else apart.unionByName(one)
        digits = F.abs(c).cast("string") if isinstance(f.dataType, T.DecimalType) else None
        per += [
            F.count(c).alias(f"v{i}"),
            distinct.cast("long").alias(f"d{i}"),
            (F.max(F.length(c)) if isinstance(f.dataType, T.StringType) else F.lit(None)).cast("int").alias(f"l{i}"),
            (F.max(F.length(F.ltrim(F.regexp_replace(digits, r"\.", ""), F.lit("0")))) if digits is not None else F.lit(None)).cast("int").alias(f"p{i}"),
            (F.max(F.length(F.regexp_extract(digits, r"\.(\d*?)0*$", 1))) if digits is not None else F.lit(None)).cast("int").alias(f"s{i}"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *per)
    rows = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f"v{i}").alias("v"), F.col(f"d{i}").alias("d"), F.col(f"l{i}").alias("l"), F.col(f"p{i}").alias("p"), F.col(f"s{i}").alias("s")) for i, f in enumerate(df.schema.fields)])).alias("f")
    out = wide.select("n", rows)
    if apart is None:
        out = out.withColumn("d", F.col("f.d"))
    else:
        out = out.join(F.broadcast(apart), F.col("f.column_name") == F.col("_column"), "left").withColumn("d", F.col("_distinct"))  # a row a column
    key = (F.col("f.v") == F.col("n")) & (F.col("d") == F.col("n")) if exact else F.lit(None).cast("boolean")
    return out.select(F.lit(table).alias("table_name"), F.col("f.column_name"), F.col("n").alias("n_rows"), (F.col("n") - F.col("f.v")).alias("n_nulls"), F.col("d").alias("n_distinct"), F.col("f.l").alias("max_length"), F.col("f.p").alias("max_precision"), F.col("f.s").alias("max_scale"), key.alias("key_candidate"))
