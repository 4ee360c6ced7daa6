"""Near-duplicate documents by ProbMinHash (operator 1).

Documents are weighted sets of five-word shingles; the weight of one that occurs c
times is 1 + ln c, so that a line repeated a hundred times does not outweigh the text.
Every shingle is a Poisson process whose rate is its weight; an arrival hits a
random register, and a register keeps the shingle that hit it first. A shingle
stops once its next arrival is later than every register of its document. Two
registers agree with probability equal to the probability Jaccard similarity of the
two documents. Registers are banded into buckets; candidates are verified on their
whole texts.

A pair is linked when its exact probability Jaccard, or its plain Jaccard over
distinct shingles (what it is for equal weights), is at least the threshold.

Within a bucket not all pairs are compared. The member with the least id leads: it
is compared with all others. In buckets that still hold several components, members
outside the leader's lead in turn, those that share most with others first, eight
times as many each round, and are compared with all members outside their component
that they can be similar to: the shingles that a document shares with any other
candidate bound its similarity from above (a document with a fifth of shingles of its
own has no partner), and the signatures must allow the threshold within five standard
deviations. So after the last round every pair of a bucket is linked, was compared,
was ruled out by that, or lies within one component. Texts equal word for word are
one member.

Defined cases: words are lower-cased and split at white space; a text of one to four
words is one shingle; a text that is null or has no word links with nothing; null
ids get a null component and are kept; repeated rows give repeated result rows; unlike
texts of one id are one member of the graph, linked to whatever one of them is like (in
a bucket that stays crowded their shingles are counted together); an
empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, connected_components, stash, work_dir

SHINGLE, THRESHOLD = 5, 0.8
#: Registers of the signature of common shingles.
COMMON = 128
#: Texts, and bytes of text, that are shingled at once; a longer text is taken alone.
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 20
#: The share of weight by repeats up to which a text has one set of bands.
ALIKE = 0.02
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word to 64-bit hash, kept for words seen; emptied when large."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


def shingles(texts: list[list[str]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count) of the distinct shingles, by text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    words = np.fromiter((hashes[w] for t in texts for w in t), dtype=np.uint64, count=int(lengths.sum()))
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    left = np.repeat(lengths, lengths) - place
    whole = (left >= SHINGLE) | ((place == 0) & (left < SHINGLE))
    total = np.zeros(len(words), dtype=np.uint64)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            part = mix64(padded[j : j + len(words)] + GOLDEN * np.uint64(j + 1))
            total += np.where(left > j, part * np.uint64(2 * j + 1), np.uint64(j))
        keys = mix64(total[whole])
    owner = owner[whole]
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return owner[at], keys[at], np.diff(np.append(at, len(keys)))


def weigh(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log(counts)


def prob_min_hash(owner: np.ndarray, keys: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """n x registers shingle hashes: who hit each register first. Texts without a shingle have zeros."""
    first = np.full(n * registers, np.inf)
    holder = np.zeros(n * registers, dtype=np.uint64)
    live, t, step = np.arange(len(keys)), np.zeros(len(keys)), 0
    rate = weights.astype(np.float64)
    with np.errstate(over="ignore"):
        while len(live):
            step += 1
            draw = mix64(keys[live] + GOLDEN * np.uint64(2 * step))
            t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate[live]
            slot = owner[live] * registers + (mix64(draw + GOLDEN) % np.uint64(registers)).astype(np.int64)
            hits = np.flatnonzero(t < first[slot])
            hits = hits[np.argsort(-t[hits], kind="stable")]  # of several assignments the last stays: the earliest
            first[slot[hits]] = t[hits]
            holder[slot[hits]] = keys[live[hits]]
            latest = first.reshape(n, registers).max(axis=1)
            on = t < latest[owner[live]]
            live, t = live[on], t[on]
    return holder.reshape(n, registers)


def band_hashes(registers: np.ndarray, bands: int) -> np.ndarray:
    """n x bands: a hash of each band's registers and its number."""
    n, m = registers.shape
    rows = registers.reshape(n, bands, m // bands)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), (n, bands)).copy()
        for j in range(rows.shape[2]):
            out = mix64(out + rows[:, :, j])
    return out


def lanes(registers: np.ndarray) -> np.ndarray:
    """n x 8 numbers that hold the low four bits of up to 128 registers each."""
    n, m = registers.shape
    nibbles = np.zeros((n, 128), dtype=np.uint64)
    nibbles[:, :m] = registers & np.uint64(15)
    return (nibbles.reshape(n, 8, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def lists(table: np.ndarray, has: np.ndarray, more: np.ndarray | None = None, also: np.ndarray | None = None) -> pa.ListArray:
    """An Arrow list for each row of the table, null where ``has`` is false; a row in ``also`` goes on with that of ``more``."""
    size = has * table.shape[1]
    if more is None:
        flat = table[has].ravel()
    else:
        size = size + also * table.shape[1]
        both = np.concatenate([table, more], axis=1)
        flat = both[np.repeat(np.stack([has, has & also], axis=1), table.shape[1], axis=1)]
    offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), mask=np.append(~has, False))
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()))


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, words_md5, bands, lanes) for each row; null but for the id where a text has no word.

    A text whose shingles repeat has a second set of bands, made with equal weights: they find pairs
    of high plain Jaccard. Without repeats all weights are equal and the two sets are one; where weights
    exceed equal ones by ``ALIKE`` at most, one set does for both (a plain Jaccard of 0.8 is then one of
    0.78 between weighted sets at least, which 24 bands of 5 miss with probability 3e-4).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in by_bytes(batches, 1, BATCH_BYTES, BATCH_ROWS):
            texts = [(t or "").lower().split() for t in batch.column(1).to_pylist()]
            owner, keys, counts = shingles(texts, hashes)
            registers = prob_min_hash(owner, keys, weigh(counts), len(texts), bands * rows)
            has = np.array([bool(t) for t in texts])
            repeats = np.zeros(len(texts), bool)
            many = np.bincount(owner, minlength=len(texts))
            repeats[:] = np.bincount(owner, weights=weigh(counts), minlength=len(texts)) > (1 + ALIKE) * many
            some = repeats[owner]
            number = np.cumsum(repeats) - 1
            plain = np.zeros_like(registers)
            if some.any():
                plain[repeats] = prob_min_hash(number[owner[some]], keys[some], np.ones(int(some.sum())), int(repeats.sum()), bands * rows)
            md5 = pa.array([hashlib.md5(" ".join(t).encode("utf-8", "replace")).digest() if t else None for t in texts], pa.binary())
            marks = lists(band_hashes(registers, bands).view(np.int64), has, band_hashes(plain, bands).view(np.int64), repeats)
            yield pa.RecordBatch.from_arrays([batch.column(0), md5, marks, lists(lanes(registers), has)], names=["doc_id", "words_md5", "bands", "lanes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, words_md5 binary, bands array<long>, lanes array<long>")


def similarity(a: list[str], b: list[str], hashes: WordHashes) -> float:
    """The larger of probability Jaccard and plain Jaccard of two word lists."""
    owner, keys, counts = shingles([a, b], hashes)
    cut = int(np.searchsorted(owner, 1))
    ka, kb = keys[:cut], keys[cut:]
    if not len(ka) or not len(kb):
        return 0.0
    both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    plain = len(both) / (len(ka) + len(kb) - len(both))
    x, y = weigh(counts[:cut]), weigh(counts[cut:])
    xs, ys = x[ia], y[ib]
    only = x.sum() - xs.sum(), y.sum() - ys.sum()
    ratio = xs / ys
    # shingles of one ratio r share their denominator: the sum of max(x, r y) over all shingles
    got = 0.0
    for r in np.unique(ratio):
        got += xs[ratio == r].sum() / (np.maximum(xs, r * ys).sum() + only[0] + r * only[1])
    return max(plain, got)


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole ``texts(doc_id, text)`` are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            keep = [similarity((x.as_py() or "").lower().split(), (y.as_py() or "").lower().split(), hashes) >= threshold for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def shared_mass(texts: DataFrame, folder: str) -> DataFrame:
    """(id, n, s, w, sw, common_lanes): a text's distinct shingles, those that another text has too, both by weight, and a signature of the common ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in by_bytes(batches, 1, BATCH_BYTES, BATCH_ROWS):
            owner, keys, counts = shingles([(t or "").lower().split() for t in batch.column(1).to_pylist()], hashes)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[owner]), pa.array(keys.view(np.int64)), pa.array(weigh(counts))], names=["id", "shingle", "c"])

    grams = stash(texts.select("doc_id", "text").mapInArrow(run, "id long, shingle long, c double"), folder)
    shared = grams.groupBy("shingle").agg((F.min("id") < F.max("id")).alias("both")).where("both")
    met = grams.join(shared, "shingle", "left").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.count("both").alias("s"), F.sum("c").alias("w"), F.sum(F.when(F.col("both"), F.col("c")).otherwise(0.0)).alias("sw"), F.collect_list(F.when(F.col("both"), F.col("shingle"))).alias("common")
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = batch.column(5)
            length = common.value_lengths().to_numpy().astype(np.int64)
            keys = mix64(common.flatten().to_numpy().view(np.uint64))  # other hashes than those of the first signature
            registers = prob_min_hash(np.repeat(np.arange(len(length)), length), keys, np.ones(len(keys)), len(length), COMMON)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], lists(lanes(registers), np.ones(len(length), bool))], names=["id", "n", "s", "w", "sw", "common_lanes"])

    return met.mapInArrow(sign, "id long, n long, s long, w double, sw double, common_lanes array<long>")


def unlike(a: str, b: str) -> Column:
    """How many of the four-bit registers in two lists of lanes differ."""
    out = F.lit(0)
    for k in range(8):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        some = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        out = out + F.bit_count(some.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def plausible(differing: Column, similarity: Column, registers: int) -> Column:
    """Whether so many differing registers go with the similarity: within five standard deviations (one pair in 3 million is not)."""
    return differing <= registers * (1 - similarity) * 15 / 16 + 5 * F.sqrt(registers * similarity * (1 - similarity)) + 2


def may_link(threshold: float, registers: int) -> Column:
    """Whether two texts can be similar, from what is known of each (``a_n`` and ``n``, and so on).

    Plain Jaccard asks for ``need`` shingles in common. They are among those that both share with others,
    so the lesser s bounds them, and these parts must resemble each other closely, the more the nearer
    s is to ``need``. Where shingles repeat, the probability Jaccard is at most either share of weight
    in common, and is estimated by the first signature.
    """
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("a_n") + F.col("n")) - 1e-9)
    close = F.least(F.lit(1.0), need / F.greatest(F.col("a_s") + F.col("s") - need, F.lit(1)))
    plain = (F.least("a_s", "s") >= need) & plausible(unlike("a_common_lanes", "common_lanes"), close, COMMON)
    repeats = (F.col("a_w") > F.col("a_n") + 0.5) | (F.col("w") > F.col("n") + 0.5)
    heavy = (F.col("a_sw") + 1e-6 >= threshold * F.col("a_w")) & (F.col("sw") + 1e-6 >= threshold * F.col("w"))
    return plain | (repeats & heavy & plausible(unlike("a_lanes", "lanes"), F.lit(threshold), registers))


def first_common(a: str, b: str) -> Column:
    """The least bucket that two texts share, by their lists of buckets; a pair is compared there only."""
    return F.array_min(F.array_intersect(a, b))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = 24, rows: int = 5) -> DataFrame:
    """(doc_id, component_id, kept) for every row of ``docs(doc_id, text, ...)``.

    component_id is the least doc_id reachable over verified links, kept marks that document.
    24 bands of 5 registers miss a pair of similarity 0.8 with probability 7e-5, be it a
    probability Jaccard or, by the bands with equal weights, a plain one.
    Texts leave their scan once, for documents that share a bucket; later rounds read those.
    """
    folder = work_dir(docs.sparkSession, "neardup")
    signed = stash(signatures(docs, bands, rows), f"{folder}/signatures")
    members = signed.where("words_md5 is not null and doc_id is not null")
    firsts = stash(members.groupBy("words_md5").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "lanes"), "doc_id").alias("made")), f"{folder}/firsts")
    hits = firsts.select(F.col("rep").alias("id"), F.explode("made.bands").alias("bucket"))
    crowded = hits.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    shared = stash(hits.join(crowded, "bucket"), f"{folder}/shared")
    wanted = shared.select(F.col("id").alias("doc_id")).distinct()
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # unlike texts of one id are all compared; equal ones once
    texts = plain.join(wanted, "doc_id", "left_semi").withColumn("digest", F.md5("text")).dropDuplicates(["doc_id", "digest"])
    texts = stash(texts.select("doc_id", "text"), f"{folder}/texts")

    pairs = shared.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    tested = stash(pairs, f"{folder}/pairs0")
    edges = stash(verify(tested, texts, threshold), f"{folder}/edges0")
    component = connected_components(edges, f"{folder}/round0")
    of = lambda c: component.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    several = shared.where("n > 2").select("bucket", "lead", "id")
    split = several.join(of("id"), "id", "left").join(of("lead"), "lead", "left").where(F.coalesce("id_part", "id") != F.coalesce("lead_part", "lead")).select("bucket").distinct()
    several = stash(several.join(split, "bucket", "left_semi"), f"{folder}/several")
    if several.take(1):
        mass = shared_mass(texts.join(several.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"), f"{folder}/shingles")
        mass = mass.where((F.col("s") >= threshold * F.col("n")) | (F.col("sw") + 1e-6 >= threshold * F.col("w")))
        known = stash(mass.join(firsts.select(F.col("rep").alias("id"), "made.lanes", "made.bands"), "id"), f"{folder}/mass")
        rows_left = several.join(known, "id")
        # where the least id is out of the running, the member that shares most leads instead, and first
        best = F.min_by("id", F.struct((-F.col("s") / F.col("n")).alias("x"), "id"))
        bucket = rows_left.groupBy("bucket").agg(F.max(F.col("id") == F.col("lead")).alias("whole"), best.alias("best"), F.count(F.lit(1)).alias("left")).where("left > 1")
        again = F.when(F.col("whole"), F.col("lead")).otherwise(F.col("best"))
        left = stash(rows_left.join(bucket, "bucket").select("bucket", "id", "n", "s", "w", "sw", "lanes", "common_lanes", "bands", again.alias("lead"), (~F.col("whole") & (F.col("id") == F.col("best"))).alias("ahead")), f"{folder}/left")
        led = None
        for k in range(1, 12):
            state = stash(left.join(of("id"), "id", "left").join(of("lead"), "lead", "left").withColumn("part", F.coalesce("id_part", "id")).withColumn("lead_part", F.coalesce("lead_part", "lead")), f"{folder}/state{k}")
            outside = state.where((F.col("part") != F.col("lead_part")) | (F.col("ahead") if k == 1 else F.lit(False)))
            if led is not None:
                outside = outside.join(led, ["bucket", "id"], "left_anti")
            turn = Window.partitionBy("bucket").orderBy(F.desc("ahead"), F.desc(F.col("s") / F.col("n")), "id")
            chosen = outside.withColumn("k", F.row_number().over(turn)).where(F.col("k") <= 8**k).drop("k")
            leads = stash(chosen.select("bucket", *[F.col(c).alias(f"a_{c}") for c in ("id", "part", "n", "s", "w", "sw", "lanes", "common_lanes", "bands")]), f"{folder}/leads{k}")
            if not leads.take(1):
                break
            done = leads.select("bucket", F.col("a_id").alias("id"))
            led = done if led is None else led.union(done)
            fresh = leads.join(state, (leads["bucket"] == state["bucket"]) & (F.col("part") != F.col("a_part")) & (first_common("a_bands", "bands") == leads["bucket"]) & may_link(threshold, bands * rows)).select(F.least("a_id", "id").alias("a"), F.greatest("a_id", "id").alias("b")).distinct()
            fresh = stash(fresh.join(tested, ["a", "b"], "left_anti"), f"{folder}/pairs{k}")
            tested = tested.union(fresh)
            found = stash(verify(fresh, texts, threshold), f"{folder}/edges{k}")
            # what is linked so far is a star around each least id: new links join stars
            component = connected_components(component.select(F.col("id").alias("a"), F.col("component").alias("b")).union(found), f"{folder}/round{k}")
            of = lambda c, component=component: component.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
        else:
            raise RuntimeError("a bucket has more members than eleven rounds can lead")
    reach = firsts.select("words_md5", F.col("rep").alias("id")).join(component, "id", "left").select("words_md5", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "words_md5").join(reach, "words_md5", "left")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", group.alias("component_id"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))
