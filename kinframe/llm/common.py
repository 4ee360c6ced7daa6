"""Shared helpers: work folders, written intermediate tables, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Where that is not set, a session of one machine (``local[...]``) gets a folder
    there, and any other is refused: executors do not see each other's disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-kinframe-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def by_bytes(batches: Iterator[pa.RecordBatch], column: str | int, most: int, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, dealt anew so that a batch holds up to ``rows`` rows and ``most`` bytes of ``column``, or one longer row."""
    held, size, count = [], 0, 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            n = min(int(np.searchsorted(ends, before + most - size, side="right")) - at, rows - count)
            if n <= 0 and held:
                yield joined()
                held, size, count = [], 0, 0
                continue
            n = max(n, 1)
            held.append(b.slice(at, n))
            size, count = size + int(ends[at + n - 1]) - before, count + n
            at += n
    if held:
        yield joined()


def stash(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet and read it again: lineage ends in shared files."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_or_null(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Only the named columns, cast; a missing one becomes null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def connected_components(edges: DataFrame, folder: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) for ids in ``edges(a, b)``; component = least id reachable, whose own row is left out.

    Alternating large-star and small-star steps: every step hangs neighbours on the
    least neighbour seen, so stars need one round and chains a logarithmic number.
    Each step is one shuffle by node with a combinable minimum, then a join whose hot
    keys adaptive execution may split; nothing is gathered per group.
    Raises if ``max_rounds`` do not suffice rather than return half a result.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    cur = stash(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/cc0")
    for k in range(1, max_rounds + 1):
        if not _open_edges(cur).take(1):
            return cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
        nbr = cur.union(cur.select("b", "a")).toDF("a", "b")
        low = nbr.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: greater neighbours hang on the least of a node and its neighbours
        large = nbr.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: the smaller neighbours and the node itself hang on the least one
        hung = large.join(low2, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        cur = stash(hung.select("e.a", "e.b").where("a <> b").distinct(), f"{folder}/cc{k}")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _open_edges(cur: DataFrame) -> DataFrame:
    """Edges (child, parent) that keep a graph from being stars: of children with several parents, or that are parents."""
    nodes = cur.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(cur.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return nodes.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)")


LETTER = re.compile(r"[^\W\d_]")
