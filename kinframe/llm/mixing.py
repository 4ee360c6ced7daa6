"""Mixing sources to target weights (operator 5).

Tokens are counted per source, each source gets a share of the token budget by
weight, no source above ``max_rate`` times its own size, and every document is
emitted floor(rate) times plus one copy drawn by a hash of its id and text.

Defined cases: null text has size 0; null source is a source of its own, last in
order; a source of size 0 gets target 0 and rate 0; an empty table gives an empty
result; rows of one source, id and text have one draw, by which they are sampled in steps of the rate, so that together they come
within one copy of their share; other columns pass through untouched, and
the added columns replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, work_dir

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources are broadcast with their targets, a few megabytes.
FEW_SOURCES = 100_000
PLAN = ("size", "source_size", "target", "rate", "copies", "taken")


def unit_draw(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that only the keys and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, max_rate: float) -> DataFrame:
    """(source, source_size, target) from (source, size), one row per source.

    Water filling in closed form: sorted by the level at which a source is full,
    the level after the first k full ones is (budget - their caps) / other weights,
    and the highest of these levels is the one at which no source is above its cap.
    The windows run over one row per source, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    full = F.col("source_size") * F.lit(float(max_rate)) / F.col("weight")
    by_full = everything.orderBy(full, F.col("source").asc_nulls_last())
    per = per.select(
        "*",
        F.coalesce(F.sum("source_size").over(by_full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(by_full.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
        F.sum("source_size").over(everything).alias("total"),
    )
    level = (F.col("total") * F.lit(float(budget)) - F.col("before") * F.lit(float(max_rate))) / F.col("open_weight")
    per = per.withColumn("level", level)
    # the level rises with every full source taken out and falls once one is taken out that is not full
    cap = F.col("source_size") * F.lit(float(max_rate))
    return per.withColumn("final", F.max("level").over(everything)).select("source", "source_size", F.least(cap, F.col("final") * F.col("weight")).alias("target"))


def with_turns(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_turn``: 0, 1, ... among the rows of one source, id and text.

    Only digests are exchanged to find such rows; where there are none, as in most tables, nothing else is done.
    """
    spark = docs.sparkSession
    digest = F.md5(F.col("text").cast("string"))
    keys = ["_source", "_id", "_digest"]
    named = lambda df: df.withColumns({"_source": F.col("source"), "_id": F.col("doc_id"), "_digest": digest})
    several = stash(named(docs.select("source", "doc_id", "text")).groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"{k}2") for k in keys]), f"{work_dir(spark, 'several')}/rows")
    if not several.take(1):
        return docs.withColumn("_turn", F.lit(0).cast("long"))
    met = named(docs).join(several, [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in keys], "left").withColumn("_many", F.col("_source2").isNotNull() | F.col("_id2").isNotNull() | F.col("_digest2").isNotNull())
    # rows that differ in nothing that counts: which is which does not matter
    turn = (F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1).cast("long")
    return met.where("NOT _many").select(*docs.columns, F.lit(0).cast("long").alias("_turn")).unionByName(met.where("_many").select(*docs.columns, turn.alias("_turn")))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_rate: float = 2.0, seed: str = "mix-1") -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken for each row.

    One scan counts words and adds them up per source (combined before the shuffle);
    a second joins the one row per source back, which is written and counted first: up to
    ``FEW_SOURCES`` sources are broadcast, so that documents are not exchanged; more are left to adaptive execution.
    """
    docs = with_turns(docs.drop(*PLAN))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    targets = source_targets(docs.select("source", size.alias("size")), weights, budget, max_rate).select(F.col("source").alias("_source"), "source_size", "target")
    targets = stash(targets, f"{work_dir(docs.sparkSession, 'targets')}/rows")
    # a source with a third of all documents would be one task of an exchange
    small = targets.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    # the draw is made before the join, so that texts pass it only where they are asked for
    draw = unit_draw(seed, F.col("doc_id"), F.md5(F.col("text").cast("string")))
    sized = docs.withColumn("size", size).withColumn("_draw", draw)
    out = sized.join(F.broadcast(targets) if small else targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # floor(rate) copies and one more if the draw is below the fraction; of equal rows each counts on from the one before
    copies = F.ceil((F.col("_turn") + 1) * F.col("rate") - F.col("_draw")) - F.ceil(F.col("_turn") * F.col("rate") - F.col("_draw"))
    return out.withColumn("rate", rate).withColumn("copies", copies.cast("long")).drop("_draw", "_turn").withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: every row of ``docs`` as often as its plan says, same columns."""
    columns = docs.columns
    plan = mix_plan(docs, **options).where("copies > 0")
    return plan.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*[f"`{c}`" for c in columns])
