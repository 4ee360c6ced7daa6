"""Audit of text filters and of what they do to each other, over a document-term matrix (operator 11).

Texts are cut into chunks; a chunk numbers its own words, so that only its list of
distinct words has to meet the global dictionary, not every occurrence. These lists are
dealt into parts by checksums of the words and travel as one row a chunk and part. The
dictionary gives each distinct word of the corpus a dense number; the numbers go back to
the chunks, in rows of the same kind, which write their rows of the matrix: one row a document, word numbers in
ascending order and counts, so that a Parquet or Arrow batch of them is a compressed
sparse row shard (list offsets, numbers, counts). Sums of counts and numbers of entries
read back from the shards decide filters A and B.

Failure conditions: A: fewer than ``min_words`` words; B: distinct words below
``min_distinct`` percent of the words; C: letters A to Z above ``max_capitals`` percent
of the code points; D: any character of ``marks``; E: the text of a document with a
smaller id, removed or not. ``audit`` counts them per source in every order of
application from one count per (source, set of failed filters).

Nothing is gathered by text or source: minima of equal texts are combined before their
exchange, those of texts with a thousandth of all rows or more (a thousand at most) are
broadcast, the others joined; rows of one source are added up where they are.

Defined cases: a null text is empty, and equal to an empty one; an empty text has no
words and fails A only (and E, where a smaller id has one); a null source counts as the
empty source; rows without an id fail E never, are no smaller id to others and have no
label; equal rows count each, and do not fail E through each other; several labels of
one id: 1 if any is; other columns are not read; no documents, no rows.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, columns_or_null, stash, work_dir
from .pieces import bucketed
from .words import split_words

FILTERS = "ABCDE"
#: Bytes of text whose words are numbered together; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Parts of the dictionary, by checksums of the words; one part, of all chunks, is held at once where words are numbered.
PARTS = 4096
#: Bytes of words that are numbered together, or the words of one part.
PART_BYTES = 8 << 20
#: Texts with at least this part of all rows are hot: at most as many texts as 1 / HOT.
HOT = 0.001

ABOUT = "doc_id long, source string, digest binary, c boolean, d boolean"


def numbers(blobs: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The numbers in all of the blobs, one after another."""
    return np.frombuffer(b"".join(x.as_buffer() for x in blobs), dtype)


def blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Blobs with the bytes of ``values`` up to each of ``ends``, which count values."""
    offsets = (np.concatenate([[0], ends]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def spelled(words: bytes, lengths: np.ndarray) -> pa.Array:
    """The words that lie in ``words`` one after another."""
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(words)])


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, length of each)."""
    return np.frombuffer(b"".join(words.to_numpy(zero_copy_only=False)), np.uint8), pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)


def cut(docs: DataFrame, max_capitals: int, marks: bytes) -> DataFrame:
    """Chunks: a row a document with numbers of the chunk's own, and a row for each part of the dictionary with the words and the numbers that they have here."""
    marked = np.zeros(256, dtype=bool)
    marked[list(marks)] = True

    def one(batch: pa.RecordBatch, chunk: int) -> Iterator[pa.RecordBatch]:
        texts = batch.column("raw")
        bytes_of = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(bytes_of)])
        data = np.frombuffer(b"".join(t.as_buffer() for t in texts), np.uint8)
        per_text = lambda hit: np.diff(np.searchsorted(np.flatnonzero(hit), ends))
        capitals, points = per_text((data >= ord("A")) & (data <= ord("Z"))), bytes_of - per_text((data & 0xC0) == 0x80)
        words, sizes = split_words(texts)
        coded = words.dictionary_encode()
        own = coded.dictionary.view(pa.binary())
        width = max(1, len(own))
        entries, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy().astype(np.int64), return_counts=True)
        last = np.cumsum(np.bincount(entries // width, minlength=len(sizes)))
        n, none = batch.num_rows, pa.nulls
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, chunk)), none(n, pa.int32()), none(n, pa.binary()), none(n, pa.binary()), none(n, pa.binary()),
             batch.column("doc_id"), batch.column("source"), batch.column("digest"), pa.array(100 * capitals > max_capitals * points), pa.array(per_text(marked[data]) > 0),
             blobs((entries % width).astype(np.int32), last), blobs(counts.astype(np.int32), last)],
            names=names,
        )
        part = (np.fromiter(map(zlib.crc32, own.to_numpy(zero_copy_only=False)), np.uint32, len(own)) % PARTS).astype(np.uint16)
        at = np.argsort(part, kind="stable").astype(np.int32)
        used, sizes = np.unique(part, return_counts=True)
        spelling, lengths = letters(own.take(pa.array(at)))
        n, last = len(used), np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, chunk)), pa.array(used.astype(np.int32)), blobs(at, last), blobs(lengths, last), blobs(spelling, np.cumsum(lengths, dtype=np.int64)[last - 1]),
             none(n, pa.int64()), none(n, pa.string()), none(n, pa.binary()), none(n, pa.bool_()), none(n, pa.bool_()), none(n, pa.binary()), none(n, pa.binary())],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a chunk is written whole by one attempt of one task, so its number needs to be unique only there
        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(by_bytes(batches, "raw", CHUNK_BYTES)):
            yield from one(batch, first + k)

    names = ["chunk", "part", "at", "lengths", "words", "doc_id", "source", "digest", "c", "d", "terms", "counts"]
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    plain = columns_or_null(docs, {"doc_id": "long", "source": "string", "text": "string"})
    return plain.select("doc_id", "source", raw.alias("raw"), F.unhex(F.sha2(raw, 256)).alias("digest")).mapInArrow(run, f"chunk long, part int, at binary, lengths binary, words binary, {ABOUT}, terms binary, counts binary")


def number_words(lists: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(places, words) of ``lists(chunk, part, at, lengths, words)``: (of, at, seq, start) where start + seq are dense numbers from 0 of the words there, and (word, term), each distinct word once.

    One exchange by part; the tasks number the words that they have, some parts at a
    time, and a row a task says where its numbers start among all.
    """

    def some(rows: list[pa.RecordBatch], task: int, first: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(rows)
        coded = spelled(b"".join(x.as_buffer() for x in table.column("words")), numbers(table.column("lengths"), np.int32)).dictionary_encode()
        last = np.cumsum(pc.binary_length(table.column("lengths")).to_numpy().astype(np.int64) // 4)
        spelling, lengths = letters(coded.dictionary)
        n, after = table.num_rows, first + len(lengths)
        # the distinct words lie in a row of their own, behind those of the chunks
        fixed = [pa.array(np.full(n + 1, x)) for x in (task, first, after)]
        empty = pa.array([b""], pa.binary())
        columns = [pa.concat_arrays([*table.column("chunk").chunks, pa.nulls(1, pa.int64())]), pa.concat_arrays([*table.column("at").chunks, empty]),
                   pa.concat_arrays([blobs(first + coded.indices.to_numpy().astype(np.int64), last), empty]),
                   *[pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([x.tobytes()], pa.binary())]) for x in (lengths, spelling)]]
        return pa.RecordBatch.from_arrays([*fixed, *columns], names=names), after

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first, held, size, last = TaskContext.get().partitionId(), 0, [], 0, None
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False).astype(np.int64))
            part = batch.column("part").to_numpy()
            for lo, hi in itertools.pairwise([*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]):  # a part's rows
                if held and part[lo] != last and size >= PART_BYTES:
                    out, first = some(held, task, first)
                    yield out
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size, last = size + int(ends[hi - 1]) - (int(ends[lo - 1]) if lo else 0), part[lo]
        if held:
            yield some(held, task, first)[0]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, spelling, lengths in zip(*(batch.column(c).to_pylist() for c in ("at", "words", "lengths")), strict=True):
                word = spelled(spelling, np.frombuffer(lengths, np.int32))
                yield pa.RecordBatch.from_arrays([word.cast(pa.binary()), pa.array(at + np.arange(len(word)))], names=["word", "term"])

    names = ["task", "first", "after", "of", "at", "seq", "lengths", "words"]
    dealt = lists.repartition("part").sortWithinPartitions("part")
    placed = stash(dealt.mapInArrow(run, "task long, first long, after long, of long, at binary, seq binary, lengths binary, words binary"), f"{folder}/places")
    order = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    starts = placed.groupBy("task").agg(F.max("after").alias("n")).select("task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("start"))
    met = placed.join(F.broadcast(starts), "task")
    words = met.where("of is null").select((F.col("start") + F.col("first")).alias("at"), "lengths", "words")
    return met.where("of is not null").select("of", "at", "seq", "start"), words.mapInArrow(spell, "word binary, term long")


def renumber(rows: pa.Table, places: pa.Table) -> pa.Table:
    """Rows of a chunk with the global numbers of their words, in ascending order within a row."""
    at, seq = numbers(places.column("at"), np.int32), numbers(places.column("seq"), np.int64)
    new = np.empty(len(at), dtype=np.int64)
    new[at] = seq + np.repeat(places.column("start").to_numpy(), pc.binary_length(places.column("at")).to_numpy() // 4)
    if not rows.num_rows:
        return rows.select(OUT[:-2]).append_column("terms", pa.array([], pa.list_(pa.int64()))).append_column("counts", pa.array([], pa.list_(pa.int32()))).cast(OUT_TYPES)
    sizes = pc.binary_length(rows.column("terms")).to_numpy() // 4
    own, counts = numbers(rows.column("terms"), np.int32), numbers(rows.column("counts"), np.int32)
    # ranks instead of numbers: a row and a rank fit one key
    ascending = np.argsort(new)
    rank = np.empty(len(new), dtype=np.int64)
    rank[ascending] = np.arange(len(new))
    order = np.argsort(np.repeat(np.arange(len(sizes)) * max(1, len(new)), sizes) + rank[own])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(values)) for values in (new[own[order]], counts[order])]
    return pa.Table.from_arrays([*[rows.column(c) for c in OUT[:-2]], *lists], schema=OUT_TYPES)


OUT = ["doc_id", "source", "digest", "c", "d", "terms", "counts"]
OUT_TYPES = pa.schema(list(zip(OUT, [pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32())], strict=True)))


def term_matrix(docs: DataFrame, max_capitals: int = 5, marks: bytes = b"#$%&*|") -> tuple[DataFrame, DataFrame]:
    """(rows, words), both written: a row a document of ``docs(doc_id, source, text)`` with ``terms`` and ``counts``, its digest and flags c and d; (word, term)."""
    spark, folder = docs.sparkSession, work_dir(docs.sparkSession, "term-matrix")
    chunks = bucketed(cut(docs, max_capitals, marks), f"{folder}/chunks", int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    lists = spark.read.schema(chunks.schema).parquet(f"{folder}/chunks").where("part is not null").select("chunk", "part", "at", "lengths", "words")
    places, words = number_words(lists, folder)
    # the documents' rows lie in buckets by chunk: only the words' numbers are exchanged
    rows = chunks.where("part is null").drop("part", "at", "lengths", "words")
    coded = rows.groupBy("chunk").cogroup(places.groupBy("of")).applyInArrow(renumber, f"{ABOUT}, terms array<long>, counts array<int>")
    return stash(coded, f"{folder}/rows"), words


def length_flags(rows: DataFrame, min_words: int = 50, min_distinct: int = 65) -> DataFrame:
    """doc_id, source, digest, a, b, c, d: the sums and numbers of entries of the matrix's rows decide a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("counts")
            offsets = counts.offsets.to_numpy().astype(np.int64)
            before = np.concatenate([[0], np.cumsum(counts.values.to_numpy(), dtype=np.int64)])
            total, distinct = before[offsets[1:]] - before[offsets[:-1]], np.diff(offsets)
            ab = [pa.array(total < min_words), pa.array(100 * distinct < min_distinct * total)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("digest"), *ab, batch.column("c"), batch.column("d")], names=["doc_id", "source", "digest", *"abcd"])

    return rows.select("doc_id", "source", "digest", "c", "d", "counts").mapInArrow(run, "doc_id long, source string, digest binary, a boolean, b boolean, c boolean, d boolean")


def later_copies(flagged: DataFrame, folder: str) -> DataFrame:
    """``flagged`` with e: a row with the same digest and a smaller id exists. ``flagged`` is read several times."""
    groups = flagged.where("doc_id is not null").groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    groups = stash(groups.where("first < last").select("digest", "n", "first"), f"{folder}/copies")
    hot = groups.where(F.col("n") >= F.lit(max(2.0, HOT * flagged.count())))
    met = flagged.join(F.broadcast(hot.select("digest", F.col("first").alias("_hot"))), "digest", "left")
    rest = groups.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select("digest", F.col("first").alias("_rest"))
    cold = met.where("_hot is null").join(rest, "digest", "left")
    later = lambda first: F.coalesce(F.col("doc_id") > F.col(first), F.lit(False)).alias("e")
    keep = flagged.columns
    return met.where("_hot is not null").select(*keep, later("_hot")).unionByName(cold.select(*keep, later("_rest")))


def failed_sets(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents by source and set of failed filters (bit k: filter k); 32 rows a source at most."""
    marks = columns_or_null(labels, {"doc_id": "long", "quality": "int", "toxic": "int"}).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    bits = sum((F.col(c).cast("int") * (1 << k) for k, c in enumerate("abcde")), F.lit(0))
    rows = flagged.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), bits.alias("failed"))
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    # rows without an id meet no label, and would all meet in one task of a join
    met = rows.where("doc_id is not null").join(marks, "doc_id", "left").select("part", "failed", "good", "toxic")
    rest = rows.where("doc_id is null").select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return met.unionByName(rest).groupBy("part", "failed").agg(F.count("*").alias("n"), one("good"), one("toxic"))


def audit_sets(sets: DataFrame) -> DataFrame:
    """Counts in every order of the filters, from ``failed_sets``: 600 rows a source, each from at most 32."""
    steps = [
        (order, k + 1, 1 << FILTERS.index(letter), sum(1 << FILTERS.index(x) for x in order[:k]))
        for order in ("".join(p) for p in itertools.permutations(FILTERS))
        for k, letter in enumerate(order)
    ]
    table = sets.sparkSession.createDataFrame(steps, "filter_order string, step int, bit int, earlier int")  # 600 rows, whatever the data
    here, before = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("earlier")) != 0
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    per = sets.crossJoin(F.broadcast(table)).groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~here & ~before).alias("kept"), total("n", here & ~before).alias("removed"), total("n", here & before).alias("redundant"),
        total("n", F.col("failed") == F.col("bit")).alias("unique_fails"), total("good", here & ~before).alias("good_lost"), total("toxic", here & ~before).alias("toxic_lost"),
    )
    return per.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_flags(docs: DataFrame) -> DataFrame:
    """Flags a to e of every row of ``docs``, with doc_id, source and digest."""
    folder = work_dir(docs.sparkSession, "filter-flags")
    rows, _ = term_matrix(docs)
    return later_copies(stash(length_flags(rows), f"{folder}/flags"), folder)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (see the contract of op11)."""
    return audit_sets(failed_sets(filter_flags(docs), labels))
