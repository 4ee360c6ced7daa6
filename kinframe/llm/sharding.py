"""Sharding by histogram sort (operator 9).

Rows get a 64-bit key (a hash of the text, so equal texts share a key). Splitters
between shards are found by counting exact bytes below candidate boundaries: each
round divides the open key interval of every splitter into ``2**step`` bins and
counts only rows within those intervals, until the bytes below are within the
tolerance or the interval is one key. Then rows are exchanged once, by range of
(shard, key, id), and numbered within their shard.

Defined cases: null text counts as empty (size 1); equal texts share a shard, also
when one group outweighs a shard; repeated and null ids are rows like others; an
empty table gives an empty result; columns added replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, work_dir

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def splitters(keyed: DataFrame, shards: int, tolerance: float, step: int = 10) -> tuple[list[int], int]:
    """Keys that start shards 1.. (unsigned order), and the number of rounds.

    ``keyed`` has (ukey: long as unsigned 64 bits shifted to signed order, size).
    The driver holds 2**step counts for each splitter and round at most.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], 0
    # per splitter: [low end of its interval, width in bits, bytes below the low end]
    open_ = {j: [0, 64, 0] for j in range(1, shards)}
    found: dict[int, int] = {}
    allowed, rounds = tolerance * total / shards, 0
    while open_:
        rounds += 1
        spans = sorted({(lo, bits) for lo, bits, _ in open_.values()})
        counts: dict[tuple[int, int], dict[int, int]] = {s: {} for s in spans}
        cases, which = None, None
        for n, (lo, bits) in enumerate(spans):
            cut = max(0, bits - step)
            inside = F.lit(True) if bits == 64 else F.shiftrightunsigned("ukey", bits) == F.lit(lo >> bits)
            part = F.shiftrightunsigned("ukey", cut).bitwiseAND((1 << min(step, bits)) - 1)
            cases = F.when(inside, part) if cases is None else cases.when(inside, part)
            which = F.when(inside, n) if which is None else which.when(inside, n)
        rows = keyed.select(which.alias("span"), cases.alias("bin"), "size").where("span is not null").groupBy("span", "bin").agg(F.sum("size").alias("size")).collect()
        for r in rows:
            counts[spans[r["span"]]][r["bin"]] = r["size"]
        for j, (lo, bits, below) in list(open_.items()):
            goal, cut, at = total * j / shards, max(0, bits - step), below
            for b in sorted(counts[(lo, bits)]):
                here = counts[(lo, bits)][b]
                if at + here >= goal:
                    start = lo + (b << cut)
                    before, after = goal - at, at + here - goal
                    if before <= allowed and before <= after:
                        found[j] = start
                    elif after <= allowed:
                        found[j] = start + (1 << cut)
                    elif cut == 0:
                        found[j] = start if before <= after else start + 1
                    else:
                        open_[j] = [start, cut, at]
                        break
                    del open_[j]
                    break
                at += here
            else:
                found[j] = lo + (1 << bits)
                del open_[j]
    return [found[j] for j in range(1, shards)], rounds


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, partitions: int | None = None) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard added.

    All columns of ``docs`` are moved, the text too where it is kept (see ``keyed_sizes``).
    """
    spark = docs.sparkSession
    folder = work_dir(spark, "shard")
    base = stash(docs, f"{folder}/keyed")
    # flipping the sign bit makes unsigned order out of the signed hash
    flat = base.withColumn("ukey", F.col("_key").bitwiseXOR(F.lit(-(1 << 63))))
    starts, _ = splitters(flat, shards, tolerance)
    signed = lambda u: u - (1 << 63)
    number = F.lit(0)
    for s in starts:
        if s < 1 << 64:
            number = number + (F.col("_key") >= F.lit(signed(s)).cast("long")).cast("int")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = base.withColumn("law", F.lit("bytes")).withColumn("shard", number.cast("int")).withColumn("grown_shard", F.lit(None).cast("int"))
    tie = F.xxhash64("doc_id", "size")
    ranged = placed.withColumn("_tie", tie).repartitionByRange(n, "shard", "_key", "_tie").sortWithinPartitions("shard", "_key", "_tie", "doc_id")
    done = stash(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), f"{folder}/placed")
    # rows of a (partition, shard) are consecutive: their first position and their number suffice
    runs = done.groupBy("_part", "shard").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    w = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", "shard", (F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).alias("shift"))
    return done.join(runs, ["_part", "shard"]).withColumn("slot", (F.col("_at") + F.col("shift")).cast("long")).drop("_part", "_at", "_tie", "_key", "shift")


def keyed_sizes(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, size in UTF-8 bytes plus one, checksum and key; ``keep``: more columns of ``docs``, but for names that are made here."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = tuple(c for c in keep if c not in (*OUT, "text_crc32", "_key", "_tie", "_part", "_at"))
    return docs.select("doc_id", *keep, (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_key"))


def measured(stored: DataFrame) -> DataFrame:
    """Written shards with size and text_crc32 computed anew from the text that is stored in them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return stored.withColumn("size", (F.octet_length(text) + 1).cast("long")).withColumn("text_crc32", F.crc32(text.cast("binary")))
