"""Analysis of measurement tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Factors to nanoseconds and to bytes.
UNITS = {"ns": 1.0, "us": 1e3, "μs": 1e3, "µs": 1e3, "ms": 1e6, "s": 1e9, "sec": 1e9, "B": 1.0, "KB": 1024.0, "MB": 1024.0**2, "GB": 1024.0**3}


def with_unit(column: str | Column) -> Column:
    """The number of a text such as ``526,920.3 us`` in base units (ns, bytes); null if it is none."""
    c = F.col(column) if isinstance(column, str) else column
    number = F.replace(F.regexp_extract(c, r"^\s*(-?[\d,]*\.?\d+)\s*\S*\s*$", 1), F.lit(","), F.lit("")).try_cast("double")
    unit = F.regexp_extract(c, r"^\s*-?[\d,]*\.?\d+\s*(\S*)\s*$", 1)
    factor = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])
    return number * F.when(unit == "", 1.0).otherwise(F.try_element_at(factor, unit))


def result_rows(df: DataFrame, stage: str, job: str, params: str, keep: Sequence[str] = ("Result",)) -> DataFrame:
    """Rows of the kept stages, with ``label``: job and parameters, trimmed, missing ones blank."""
    label = F.trim(F.concat_ws(" ", F.coalesce(F.col(job), F.lit("")), F.coalesce(F.col(params), F.lit(""))))
    return df.filter(F.col(stage).isin(list(keep))).withColumn("label", label)


def mean_error(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(n, mean, std_error) by group; the error of one value is null."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sqrt(F.var_samp(v) / F.count(v)).alias("std_error"))


def common_unit(df: DataFrame, value: str, divisions: int = 3) -> DataFrame:
    """``df`` with ``scaled`` and ``unit``: one unit for all rows, a step up while the least value is above 1000.

    The least value is a one-row aggregate, joined to all rows.
    """
    low = df.agg(F.min(value).alias("_low"))
    steps = F.lit(0)
    for k in range(divisions):
        steps = steps + (F.col("_low") > 1000.0 ** (k + 1)).cast("int")
    with_steps = df.crossJoin(F.broadcast(low.select(F.coalesce(steps, F.lit(0)).alias("_steps"))))
    names = F.array(*[F.lit(x) for x in ("ns", "us", "ms", "sec")])
    return with_steps.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("scaled", "unit")], (F.col(value) / F.pow(F.lit(1000.0), F.col("_steps"))).alias("scaled"), F.element_at(names, F.col("_steps") + 1).alias("unit"))


def running_mean(df: DataFrame, series: Sequence[str], order_by: Sequence[str], value: str, alias: str = "running_mean") -> DataFrame:
    """The mean of a series' values up to each row; ``order_by`` should be total within a series."""
    w = Window.partitionBy(*series).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(alias, F.avg(value).over(w))


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """(by.., q1, q2, ...): exact quantiles of each group, interpolated between the two nearest values.

    Values are sorted by range over all tasks and written; a value's rank in its group follows from
    counts per task and group, so no task holds a group. Runs when called; null values have no rank.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = [F.col(b).alias(f"_g{i}") for i, b in enumerate(by)]
    groups = [f"_g{i}" for i in range(len(by))]
    given = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    dealt = given.repartitionByRange(n, *groups, "_v").sortWithinPartitions(*groups, "_v")
    rows = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "quantiles")
    counts = rows.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
    w = Window.partitionBy(*(groups or [F.lit(0)]))
    so_far = F.coalesce(F.sum("n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"{g}p") for g in groups), (so_far - F.col("first")).alias("shift"), F.sum("n").over(w).alias("total"))
    same = [F.col("_part") == F.col("_p"), *(F.col(g).eqNullSafe(F.col(f"{g}p")) for g in groups)]
    ranked = rows.join(places, same).select(*groups, "_v", (F.col("_at") + F.col("shift")).alias("rank"), "total")
    at = [F.lit(q) * (F.col("total") - 1) for q in shares]
    near = [F.when((F.col("rank") == F.floor(x)) | (F.col("rank") == F.ceil(x)), F.col("_v")) for x in at]
    ends = ranked.groupBy(*groups, "total").agg(*[F.min(v).alias(f"lo{i}") for i, v in enumerate(near)], *[F.max(v).alias(f"hi{i}") for i, v in enumerate(near)])
    between = [F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (x - F.floor(x)) for i, x in enumerate(at)]
    return ends.select(*[F.col(g).alias(b) for g, b in zip(groups, by, strict=True)], *[x.alias(f"q{i + 1}") for i, x in enumerate(between)])


def _boxed(df: DataFrame, by: Sequence[str], value: str, whisker: float) -> tuple[DataFrame, Column]:
    """Rows with the quartiles of their group, and whether a row lies within the whiskers."""
    q = quantiles(df, by, value, (0.25, 0.5, 0.75)).select(*[F.col(b).alias(f"_{b}") for b in by], "q1", "q2", "q3")
    reach = (F.col("q3") - F.col("q1")) * whisker
    met = df.join(q, [df[b].eqNullSafe(q[f"_{b}"]) for b in by]).drop(*[f"_{b}" for b in by])
    return met, (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)


def outliers(df: DataFrame, by: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """The rows that ``box_figures`` counts as outliers, with ``side``: low or high. Rows without a value are none."""
    met, inside = _boxed(df, by, value, whisker)
    side = F.when(F.col(value) < F.col("q2"), "low").otherwise("high").alias("side")
    return met.where(~inside).select(*[F.col(f"`{c}`") for c in df.columns], side)


def box_figures(df: DataFrame, by: Sequence[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Box-plot figures by group: quartiles (interpolated), whisker ends, number of outliers.

    Whiskers end at the last values within ``whisker`` times the quartile distance of the box.
    """
    met, inside = _boxed(df, by, value, whisker)
    return met.groupBy(*by, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("n_outliers"))


def histogram(df: DataFrame, by: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Equal bins between a group's least and greatest value: (bin, n, density); empty bins have no row."""
    ends = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    ends = ends.select(*[F.col(b).alias(f"_{b}") for b in by], "lo", "hi", "total")
    met = df.filter(F.col(value).isNotNull()).join(ends, [df[b].eqNullSafe(ends[f"_{b}"]) for b in by])
    width = (F.col("hi") - F.col("lo")) / bins
    number = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counted = met.select(*by, "lo", "hi", "total", number.alias("bin")).groupBy(*by, "lo", "hi", "total", "bin").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, "bin", "n", (F.col("n") / F.col("total")).alias("share"), F.when(width > 0, F.col("n") / (F.col("total") * width)).alias("density"))


def across_options(df: DataFrame, by: Sequence[str], option: str, value: str, options: Sequence) -> DataFrame:
    """One column ``o<option>`` for each known option with its mean value, ``best`` and the option that has it."""
    wide = df.groupBy(*by).pivot(option, list(options)).agg(F.avg(value))
    wide = wide.select(*by, *[F.col(f"`{o}`").alias(f"o{o}") for o in options])
    known = F.filter(F.array(*[F.struct(F.col(f"o{o}").alias("v"), F.lit(str(o)).alias("o")) for o in options]), lambda x: x["v"].isNotNull())
    best = F.array_min(known)
    return wide.select("*", best["v"].alias("best"), best["o"].alias("best_option"))


def ratio_to_best(df: DataFrame, by: Sequence[str], option: str, value: str) -> DataFrame:
    """Mean by group and option with its rank (ties share) and its ratio to the group's best."""
    means = df.groupBy(*by, option).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(*by)
    return means.select(*by, option, "mean", F.rank().over(w.orderBy("mean")).alias("rank"), (F.col("mean") / F.min("mean").over(w)).alias("ratio"))
