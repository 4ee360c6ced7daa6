"""Comparing large results: rows without a key within a tolerance, and tables by checksums of ranges.

Within a tolerance: rows of both sides with equal exact columns may be partners if their
values differ by no more than the tolerance. Going up through the values of a group,
each row takes the earliest partner still waiting; on a line that gives the greatest
number of pairs. Rows are put in order by one range exchange, so no group is held in a
task: a task passes through its range with the rows that wait for a partner, and what
waits at its end is handed to the next range, which is gone through again where
something comes in. Rounds end when nothing new is handed on; data with gaps wider than
the tolerance need one or two.

By checksums: both sides are added up by ranges of a hash of the key (count and two sums of
row hashes, in any order of rows, combined before their exchange); only ranges that
differ are split further, and only rows of those left are joined.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written
from ..spec import quoted
from .compare import _same_shape, differences_by_key

#: A table of ranges of up to so many rows is broadcast.
FEW = 100_000


class Sweep:
    """Pairs rows in ascending order of (group, value); ``waiting`` holds [value, number] of one side (1 left, -1 right)."""

    def __init__(self, tolerance: float):
        self.tolerance, self.group, self.side, self.waiting = tolerance, None, 0, deque()

    def start(self, state: tuple | None) -> None:
        self.group, self.side, self.waiting = (None, 0, deque()) if state is None else (state[0], state[1], deque(list(x) for x in state[2]))

    def state(self) -> tuple | None:
        return (self.group, self.side, [tuple(x) for x in self.waiting]) if self.waiting else None

    def leave(self, value: float | None, lone: list) -> None:
        """Give up what is too low for ``value`` (None: everything)."""
        while self.waiting and (value is None or not value - self.waiting[0][0] <= self.tolerance):
            low, n = self.waiting.popleft()
            lone.append((self.group, low, self.side, n))

    def row(self, group: bytes, value: float, left: int, right: int, lone: list) -> None:
        if group != self.group:
            self.leave(None, lone)
            self.group = group
        self.leave(value, lone)
        for side, n in ((1, left), (-1, right)):
            while n and self.waiting and self.side == -side:
                taken = min(n, self.waiting[0][1])
                n -= taken
                self.waiting[0][1] -= taken
                if not self.waiting[0][1]:
                    self.waiting.popleft()
            if n:
                self.side = side
                self.waiting.append([value, n])


LONE = "part int, g binary, v double, side int, n long"
STATE = "part int, g binary, side int, vs array<double>, ns array<long>"


def _swept(rows: DataFrame, tolerance: float, incoming: dict[int, tuple], parts: int) -> DataFrame:
    """Ranges ``rows(part, g, v, n_left, n_right)`` gone through: rows without a partner (``vs`` null), and a row a range with what waits at its end.

    ``incoming``: what waits before a range, by part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, part = Sweep(tolerance), None

        def out(lone: list, ended: int | None) -> pa.RecordBatch:
            state = sweep.state() if ended is not None else None
            n, extra = len(lone), int(ended is not None)
            columns = [
                pa.array([part] * n + [ended] * extra, pa.int32()), pa.array([x[0] for x in lone] + [state and state[0]] * extra, pa.binary()),
                pa.array([x[1] for x in lone] + [None] * extra, pa.float64()), pa.array([x[2] for x in lone] + [state and state[1]] * extra, pa.int32()), pa.array([x[3] for x in lone] + [None] * extra, pa.int64()),
                pa.array([None] * n + [[x[0] for x in state[2]] if state else []] * extra, pa.list_(pa.float64())), pa.array([None] * n + [[x[1] for x in state[2]] if state else []] * extra, pa.list_(pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["part", "g", "v", "side", "n", "vs", "ns"])

        for batch in batches:
            numbers = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if numbers[a] != part:
                    if part is not None:
                        yield out([], part)
                    part = int(numbers[a])
                    sweep.start(incoming.get(part))
                lone: list = []
                some = batch.slice(a, b - a)
                for row in zip(some.column("g").to_pylist(), some.column("v").to_pylist(), some.column("n_left").to_pylist(), some.column("n_right").to_pylist(), strict=True):
                    sweep.row(*row, lone)
                yield out(lone, None)
        if part is not None:
            yield out([], part)

    ordered = rows.select("part", "g", "v", "n_left", "n_right").repartition(parts, "part").sortWithinPartitions("part", "g", "v")
    return ordered.mapInArrow(run, LONE + ", vs array<double>, ns array<long>")


def differences_within(left: DataFrame, right: DataFrame, column: str, tolerance: float, partitions: int | None = None) -> DataFrame:
    """Rows without a partner on the other side: all columns, ``n_left`` and ``n_right`` (how many of them are left over).

    Rows are partners if ``column`` (a number) differs by ``tolerance`` at most, as doubles, and all others are equal;
    as many pairs as possible are made. Null equals null, NaN equals NaN, an infinity itself, within no tolerance of
    anything else. Ranges are written on the way, so this runs when called.
    """
    _same_shape(left, right)
    if not tolerance >= 0:
        raise ValueError("the tolerance must be a number from 0 up")
    spark, kind = left.sparkSession, left.schema[column].dataType
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"{column} is no number")
    exact = [c for c in left.columns if c != column]
    v = quoted(column).cast("double")
    odd = F.when(v.isNull(), "null").when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), v.cast("string"))
    named = [F.struct(quoted(c)).alias(f"e{i}") for i, c in enumerate(exact)]

    def side(df: DataFrame, n_left: int, n_right: int) -> DataFrame:
        return df.select(*[quoted(c) for c in exact], odd.alias("_odd"), F.when(odd.isNull(), v).otherwise(0.0).alias("_v"), F.lit(n_left).cast("long").alias("_l"), F.lit(n_right).cast("long").alias("_r"))

    keys = [quoted(c) for c in exact]
    both = side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(*keys, "_odd", "_v").agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    g = F.unhex(F.sha2(F.to_json(F.struct(*named, F.struct("_odd").alias("odd")), {"ignoreNullFields": "false"}), 256))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = both.withColumn("_g", g).repartitionByRange(parts, "_g", "_v").withColumn("_part", F.spark_partition_id())
    stored = written(ranged, "ranges")
    rows = stored.select(F.col("_part").alias("part"), F.col("_g").alias("g"), F.col("_v").alias("v"), "n_left", "n_right")
    present = sorted(r.part for r in rows.select("part").distinct().collect())  # a row a range
    incoming: dict[int, tuple] = {}
    ends: dict[int, tuple | None] = {}
    results: dict[int, DataFrame] = {}
    todo = present
    while todo:
        out = written(_swept(rows.where(F.col("part").isin(todo)) if todo != present else rows, tolerance, incoming, max(1, min(parts, len(todo)))), "swept")
        for r in out.where("vs is not null").collect():  # a row a range: what waits at its end, values within the tolerance
            ends[r.part] = (bytes(r.g), r.side, list(zip(r.vs, r.ns, strict=True))) if r.vs else None
        for p in todo:
            results[p] = out.where("vs is null")
        following = {b: ends[a] for a, b in zip(present[:-1], present[1:], strict=True)}
        todo = [p for p, state in following.items() if state != incoming.get(p)]
        incoming.update({p: following[p] for p in todo})
    frames: dict[int, tuple[DataFrame, list[int]]] = {}
    for p, df in results.items():
        frames.setdefault(id(df), (df, []))[1].append(p)
    lone = spark.createDataFrame([(g, v, s, n) for g, s, vs in [ends[present[-1]]] for v, n in vs] if present and ends[present[-1]] else [], "g binary, v double, side int, n long")
    for df, of in frames.values():
        lone = lone.unionByName(df.where(F.col("part").isin(of)).select("g", "v", "side", "n"))
    left_over = lone.groupBy(F.col("g").alias("_g"), F.col("v").alias("_v")).agg(*[F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0)).cast("long").alias(n) for s, n in ((1, "n_left"), (-1, "n_right"))])
    met = stored.drop("n_left", "n_right", "_part").join(left_over, ["_g", "_v"])
    value = F.coalesce(F.when(F.col("_odd") == "null", None).when(F.col("_odd") == "nan", F.lit(float("nan"))).otherwise(F.col("_odd").cast("double")), F.when(F.col("_odd").isNull(), F.col("_v")))
    return met.select(*[(value.cast(kind).alias(c) if c == column else quoted(c)) for c in left.columns], "n_left", "n_right")


def _ranged(df: DataFrame, key: Sequence[str], width: int) -> DataFrame:
    place = F.shiftrightunsigned(F.xxhash64(*[quoted(k) for k in key]), 64 - width)
    cols = [quoted(c) for c in df.columns]
    return df.withColumn("_range", place).withColumn("_h", F.xxhash64(*cols)).withColumn("_h2", F.xxhash64(F.lit("second"), *cols))


def _within(df: DataFrame, ranges: DataFrame | None, few: bool, key: Sequence[str], width: int) -> DataFrame:
    if ranges is None:
        return df
    at = df.withColumn("_at", F.shiftrightunsigned(F.xxhash64(*[quoted(k) for k in key]), 64 - width))
    some = ranges.select(F.col("_range").alias("_at"))
    return at.join(F.broadcast(some) if few else some, "_at", "left_semi").drop("_at")


def unequal_ranges(left: DataFrame, right: DataFrame, key: Sequence[str], bits: int = 12, levels: int = 3, enough: int = 1_000_000) -> tuple[DataFrame, int, bool]:
    """(ranges, width, few): ranges (``_range``: the first ``width`` bits of the key's hash) whose rows differ between the sides.

    Ranges are split by ``bits`` more bits, ``levels`` times at most, while more than ``enough`` rows are in unequal ones. few: they can be broadcast.
    """
    ranges, few, width = None, True, 0
    for level in range(1, levels + 1):
        counted = []
        for df, sign in ((left, 1), (right, -1)):
            rows = _ranged(_within(df, ranges, few, key, width), key, level * bits)
            counted.append(rows.select("_range", F.lit(sign).alias("_n"), *[(F.col(h).cast("decimal(38,0)") * sign).cast("decimal(38,0)").alias(h) for h in ("_h", "_h2")]))
        sums = counted[0].unionByName(counted[1]).groupBy("_range").agg(F.sum("_n").alias("_n"), F.sum("_h").alias("_h"), F.sum("_h2").alias("_h2"), F.count("*").alias("_rows"))
        ranges, width = written(sums.where("_n <> 0 or _h <> 0 or _h2 <> 0").select("_range", "_rows"), "unequal"), level * bits
        number, rows = ranges.agg(F.count("*"), F.coalesce(F.sum("_rows"), F.lit(0))).first()
        few = number <= FEW
        if rows <= enough:
            break
    return ranges, width, few


def differences_by_ranges(left: DataFrame, right: DataFrame, key: Sequence[str], tolerance: float = 0.0, **options) -> DataFrame:
    """What ``differences_by_key`` gives, for tables of which little differs: only rows of ranges with unlike checksums are exchanged.

    Two sums of 64-bit hashes and a count stand for the rows of a range. Options: those of ``unequal_ranges``.
    """
    _same_shape(left, right)
    ranges, width, few = unequal_ranges(left, right, key, **options)
    return differences_by_key(_within(left, ranges, few, key, width), _within(right, ranges, few, key, width), key, tolerance)
