"""Near-duplicate vectors by random hyperplanes, every bucket compared whole (operator 7).

Every pass draws its own random hyperplanes and joins the signs of a vector's
projections to a bucket number. All vectors of a bucket are compared with each other,
however many they are: a crowded bucket is dealt into blocks of ``BLOCK`` rows, and each
pair of blocks is a task's unit of work. So a pair at the threshold is missed with
``passes_for``'s probability at most, wherever it lies; vectors in a dense cluster meet
no less often than others.

Pairs are verified by cosine in double precision and never listed. A row carries its
bucket numbers of all passes, and a pair counts only in the first pass where it shares a
bucket; a pair of blocks gives each of its rows one number of links and one link that
keeps the block's components. Only the comparing itself is
quadratic in a cluster's size, for ``n_links`` asks for each link.

The number of hyperplanes and of passes follows the number of vectors by stated rules
(``bits_for``, ``passes_for``).

Defined cases: null, zero or empty vectors and those with null or non-finite
components link with nothing; vectors of different lengths do not link; equal
vectors are one member of the passes and count as links of each other; unlike vectors
of one id are in one component, and each row has the links of its own vector; null ids link with nothing; labels are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stash, work_dir

#: Rows of a block of a crowded bucket; a pair of blocks is compared at once.
BLOCK = 2048


def bits_for(n: int, window: int) -> int:
    """Hyperplanes a pass: buckets of evenly spread vectors hold ``window`` to twice as many."""
    return min(31, math.floor(math.log2(max(1, n / window))))


def passes_for(n: int, window: int, threshold: float, miss: float = 0.002) -> int:
    """Passes after which a pair at the threshold is missed with probability ``miss`` at most.

    Two vectors at angle t agree in a hash with probability 1 - t/pi; to be in one
    bucket they must share ``bits_for``, at most log2(n / window), hashes.
    """
    depth = max(0.0, math.log2(max(1, n) / window))
    meet = (1 - math.acos(threshold) / math.pi) ** depth
    return max(4, math.ceil(math.log(miss) / math.log(1 - meet))) if meet < 1 else 4


def planes(pass_no: int, width: int, bits: int, seed: int) -> np.ndarray:
    """width x bits normal vectors, the same wherever they are drawn."""
    return np.random.default_rng([seed, pass_no, width]).standard_normal((width, bits))


def keyed(vectors: DataFrame) -> DataFrame:
    """(id, vec, same) of every row; same: a digest of vectors that can link, with finite components, not all zero, and an id; else vec and same are null. Floats stay floats, they take half the room."""
    kind = "float" if dict(vectors.dtypes).get("embedding") == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(f"array<{kind}>").alias("vec"))
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    fine = F.coalesce(F.col("id").isNotNull() & (F.size("vec") > 0) & sound, F.lit(False))
    return rows.select("id", F.when(fine, F.col("vec")).alias("vec"), F.when(fine, F.sha2(F.to_json(F.struct("vec")).cast("binary"), 256)).alias("same"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the largest component first, against overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(firsts: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """(pass, bucket, id, copies, width, vec, buckets) for every pass.

    vec: the bytes of the components; buckets: those of the bucket numbers of all passes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        drawn: dict[tuple[int, int], np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids, copies = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                lists = batch.column(1)
                widths = lists.value_lengths().to_numpy()
                flat, ends = lists.flatten().to_numpy(), np.cumsum(widths)
                for width in np.unique(widths):
                    rows = np.flatnonzero(widths == width)
                    x = np.stack([flat[e - width : e] for e in ends[rows]])
                    blobs = pa.array([v.tobytes() for v in x], pa.binary())
                    x = unit(x)
                    n = len(rows)
                    buckets = np.empty((n, passes), np.int32)
                    for p in range(passes):
                        if (p, width) not in drawn:
                            if len(drawn) > 400:
                                drawn.clear()
                            drawn[p, width] = planes(p, int(width), bits, seed)
                        buckets[:, p] = ((x @ drawn[p, width]) > 0) @ weights
                    every = pa.array([r.tobytes() for r in buckets], pa.binary())
                    for p in range(passes):
                        fixed = [pa.array(np.full(n, p, np.int32)), pa.array(np.ascontiguousarray(buckets[:, p]))]
                        yield pa.RecordBatch.from_arrays([*fixed, pa.array(ids[rows]), pa.array(copies[rows]), pa.array(np.full(n, width, np.int32)), blobs, every], names=["pass", "bucket", "id", "copies", "width", "vec", "buckets"])

    return firsts.select("id", "vec", F.col("copies").cast("long")).mapInArrow(run, "pass int, bucket int, id long, copies long, width int, vec binary, buckets binary")


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i[k] and j[k] in ``root``, which leads every place to the least of its set."""
    while True:
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        left = low != high
        if not left.any():
            return
        i, j = i[left], j[left]
        np.minimum.at(root, high[left], low[left])
        while (root[root] != root).any():
            root[:] = root[root]


def block_links(ids: np.ndarray, copies: np.ndarray, mat: np.ndarray, buckets: np.ndarray, side: np.ndarray, pass_no: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(near, root) of rows in their order: copies of the rows each is linked with, and the least place joined with it.

    Only pairs across ``side`` count, where both are met, else all; links shared with an
    earlier pass are that pass's.
    """
    n = len(ids)
    near, root = np.zeros(n, np.int64), np.arange(n)
    across = side.any() and not side.all()
    cut = int((~side).sum()) if across else n  # rows of the first side come first
    for s in range(0, cut, 256):
        e = min(cut, s + 256)
        begin = cut if across else s
        hit = mat[s:e] @ mat[begin:].T >= threshold
        if not across:
            hit &= np.arange(begin, n)[None, :] > np.arange(s, e)[:, None]
        i, j = np.nonzero(hit)
        i, j = i + s, j + begin
        unite(root, i, j)
        if pass_no:
            fresh = np.ones(len(i), bool)
            for p in range(pass_no):
                fresh &= buckets[i, p] != buckets[j, p]
            i, j = i[fresh], j[fresh]
        np.add.at(near, i, copies[j])
        np.add.at(near, j, copies[i])
    return near, root


def compared(blocks: DataFrame, threshold: float, passes: int, kind: str) -> DataFrame:
    """(id, low, near): of each row of a pair of blocks that has links there, their number and the least id joined with it.

    ``blocks`` must have the rows of a (pass, width, bucket, first, second) together in a partition, by side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def flush() -> pa.RecordBatch:
            ids, copies, side = (np.concatenate([h[k] for h in held]) for k in range(3))
            mat, buckets = (np.concatenate([h[k] for h in held]) for k in (3, 4))
            near, root = block_links(ids, copies, mat, buckets, side, held_key[0], threshold)
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, root, ids)
            low = low[root]
            met = (near > 0) | (low != ids)
            return pa.RecordBatch.from_arrays([pa.array(ids[met]), pa.array(low[met]), pa.array(near[met])], names=["id", "low", "near"])

        for whole in batches:
            keys = np.stack([whole.column(k).to_numpy() for k in range(5)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if e <= s:
                    continue
                key = tuple(keys[s].tolist())
                if held and key != held_key:
                    yield flush()
                    held = []
                held_key = key
                part = whole.slice(s, e - s)
                mat = unit(np.frombuffer(b"".join(part.column(8).to_pylist()), dtype=kind).reshape(e - s, key[1]))
                codes = np.frombuffer(b"".join(part.column(9).to_pylist()), dtype=np.int32).reshape(e - s, passes)
                held.append((part.column(5).to_numpy(), part.column(6).to_numpy(), part.column(7).to_numpy() > 0, mat, codes))
        if held:
            yield flush()

    return blocks.select("pass", "width", "bucket", "first", "second", "id", "copies", "side", "vec", "buckets").mapInArrow(run, "id long, low long, near long")


def links(firsts: DataFrame, folder: str, threshold: float, passes: int, bits: int, seed: int, block: int = BLOCK) -> DataFrame:
    """(id, low, near) of ``firsts(id, vec, copies)`` from every pair of blocks; near adds up over the rows of an id.

    A bucket of k blocks sends each row to its block's k pairs, so that no task gets
    more than two blocks of it at once.
    """
    spark = firsts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    kind = "f4" if dict(firsts.dtypes)["vec"] == "array<float>" else "f8"
    place = ["pass", "width", "bucket"]
    placed = stash(coded(firsts, passes, bits, seed), f"{folder}/placed")
    sizes = placed.groupBy(*place).agg(F.count("*").alias("n")).where("n > 1").select(*place, F.ceil(F.col("n") / block).cast("int").alias("k"))
    own = placed.join(sizes, place).withColumn("own", F.pmod(F.xxhash64("id", "pass"), "k").cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    sent = sent.withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("other")).cast("int"))
    unit_of_work = [*place, "first", "second"]
    dealt = sent.repartition(n, *unit_of_work).sortWithinPartitions("pass", "width", "bucket", "first", "second", "side")
    return compared(dealt, threshold, passes, kind)


def near_vectors(vectors: DataFrame, threshold: float = 0.9, window: int = 256, passes: int | None = None, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, ...)``."""
    folder = work_dir(vectors.sparkSession, "vectors")
    every = stash(keyed(vectors), f"{folder}/rows")
    rows = every.where("same is not null")
    firsts = stash(rows.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("vec").alias("vec")), f"{folder}/firsts")
    # a vector goes by its least id; of several that share it, all but one by numbers above all ids
    clash = firsts.groupBy("id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select(F.col("id").alias("of"), "low")
    clash = stash(clash, f"{folder}/clash")
    if clash.take(1):
        top = firsts.agg(F.max("id")).first()[0]
        fresh = F.when(F.col("same") != F.col("low"), F.monotonically_increasing_id() + (top + 1))
        firsts = stash(firsts.join(clash, F.col("id") == F.col("of"), "left").select("same", F.coalesce(fresh, "id").alias("id"), "copies", "vec"), f"{folder}/nodes")
    n = firsts.count()
    bits = bits_for(n, window)
    if passes is None:
        # without hyperplanes all pairs meet in the first pass
        passes = passes_for(n, window, threshold) if bits else 1
    found = stash(links(firsts.select("id", "vec", "copies"), folder, threshold, passes, bits, seed), f"{folder}/links")
    # ids that have several vectors tie these together
    twice = rows.groupBy("id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").select(F.col("id").alias("own"))
    tied = rows.join(twice, rows["id"] == twice["own"]).select("own", "same").join(firsts.select("same", F.col("id").alias("a")), "same").select("own", "a")
    ties = tied.join(tied.groupBy("own").agg(F.min("a").alias("b")), "own").select("a", "b").where("a <> b")
    component = connected_components(found.select(F.col("id").alias("a"), F.col("low").alias("b")).union(ties).distinct(), folder)
    near = found.groupBy("id").agg(F.sum("near").alias("near"))
    per = firsts.select("same", "id", "copies").join(near, "id", "left").join(component, "id", "left")
    per = per.select("same", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    # a row has the links of its own vector; the rows of an id are in one component
    sound = rows.select("id", "same").join(per, "same").select("id", "n_links", "component_id")
    group = sound.groupBy(F.col("id").alias("of")).agg(F.min("component_id").alias("component_id"))
    bare = every.where("same is null").select("id", F.lit(0).cast("long").alias("n_links"))
    named = sound.select("id", "n_links").unionByName(bare.where("id is not null"))
    out = named.join(group, named["id"] == group["of"], "left").select("id", "n_links", F.coalesce("component_id", "id").alias("component_id"))
    out = out.unionByName(bare.where("id is null").select("id", "n_links", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
