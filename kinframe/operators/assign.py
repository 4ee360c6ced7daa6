"""Assignment of weighted queries to options under limits, for many workloads at once.

measurements(workload, query, option, cost, mem), weights(workload, query, weight),
limits(workload, max_options, max_mem). Options and queries are compared as strings or numbers,
whatever they are. One rule for ties: lowest cost, then least memory, then the lowest
options in order of queries. Cells without a cost count as not measured, those without
memory as using none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import optionsets


def weighted(measurements: DataFrame, weights: DataFrame) -> DataFrame:
    """Measurements with weighted cost; a missing weight, or one below 1, counts as 1.

    Several measurements of one cell: the least cost, and of equal ones the least memory.
    """
    cells = measurements.groupBy("workload", "query", "option").agg(F.min(F.struct(F.col("cost").cast("double").alias("cost"), F.col("mem").cast("long").alias("mem"))).alias("c"))
    met = cells.join(weights.groupBy("workload", "query").agg(F.max("weight").alias("weight")), ["workload", "query"], "left")
    weight = F.greatest(F.coalesce("weight", F.lit(1)), F.lit(1))
    return met.select("workload", "query", "option", (F.col("c.cost") * weight).alias("cost"), F.col("c.mem").alias("mem"))


def _answers(measurements: DataFrame, weights: DataFrame, limits: DataFrame) -> DataFrame:
    """(workload, objective, picks) of ``optionsets.solved``; the objective is the sum of the picks' costs in order of queries."""
    cells = weighted(measurements, weights).where("cost is not null")
    return optionsets.solved(cells, limits).withColumn("objective", F.aggregate("picks", F.lit(0.0), lambda a, p: a + p["cost"]))


def cheapest(measurements: DataFrame, weights: DataFrame, limits: DataFrame) -> DataFrame:
    """The cheapest assignment with at most ``max_options`` options and no memory limit.

    One row per (workload, query): option, cost, mem, objective (the workload's sum). Workloads
    without a full assignment have no row; see ``assignment`` for their status.
    """
    free = limits.select("workload", "max_options", F.lit(None).cast("double").alias("max_mem"))
    return _answers(measurements, weights, free).select("workload", "objective", F.explode("picks").alias("p")).select("workload", "p.*", "objective")


def assignment(measurements: DataFrame, weights: DataFrame, limits: DataFrame) -> DataFrame:
    """The cheapest assignment under both limits: (workload, query, option, cost, mem, objective, status).

    status is ok, or infeasible in one row without a query. A null ``max_mem`` or ``max_options`` is no limit.
    """
    asked = limits.select("workload").distinct()
    out = asked.join(_answers(measurements, weights, limits), "workload", "left").select("workload", "objective", F.explode_outer("picks").alias("p"))
    return out.select("workload", "p.*", "objective", F.when(F.col("p").isNull(), "infeasible").otherwise("ok").alias("status"))


def selected_options(answers: DataFrame) -> DataFrame:
    """(workload, option, n_queries, cost, mem): the options that an answer of ``cheapest`` or ``assignment`` uses."""
    return answers.where("query is not null").groupBy("workload", "option").agg(F.count(F.lit(1)).alias("n_queries"), F.sum("cost").alias("cost"), F.sum("mem").alias("mem"))


def everything_on(measurements: DataFrame, weights: DataFrame) -> DataFrame:
    """(workload, option, cost, mem) if all queries used the option; options that lack a query have no row."""
    cells = weighted(measurements, weights)
    needed = cells.groupBy("workload").agg(F.count_distinct("query").alias("needed"))
    sums = cells.groupBy("workload", "option").agg(F.sum("cost").alias("cost"), F.sum("mem").alias("mem"), F.count(F.lit(1)).alias("n"))
    return sums.join(needed, "workload").filter("n = needed").select("workload", "option", "cost", "mem")


def greedy(measurements: DataFrame, weights: DataFrame) -> DataFrame:
    """The cheapest option of each query without limits: a lower bound."""
    cells = weighted(measurements, weights)
    return cells.groupBy("workload", "query").agg(F.min(F.struct("cost", "option", "mem")).alias("b")).select("workload", "query", F.col("b.option").alias("option"), F.col("b.cost").alias("cost"), F.col("b.mem").alias("mem"))


def best_single(measurements: DataFrame, weights: DataFrame) -> DataFrame:
    """The one option that is cheapest for a whole workload."""
    return everything_on(measurements, weights).groupBy("workload").agg(F.min(F.struct("cost", "option", "mem")).alias("b")).select("workload", F.col("b.option").alias("option"), F.col("b.cost").alias("cost"), F.col("b.mem").alias("mem"))
