"""SentencePiece encoding and decoding as a relational lattice (operator 6).

Spaces become U+2581 and a text gets one in front, as the model's own normaliser
does. Texts are cut into units where no piece of the model can lie across (letters,
single digits, other signs, each with the spaces before it; checked against every
piece when the model is loaded), so the best path of a text is that of its units.

Each distinct unit is segmented once: its substrings of bounded length are exploded,
equi-joined to the piece table, edges are grouped by unit, and a fold over edges in
order of their ends finds the best path (highest sum of scores; of equal ones the
one with the longest last piece). The fold goes slice by slice, for it copies its
state at every step: a unit of 200,000 letters takes seconds.
Characters without a piece become byte pieces.

Texts are cut once, in chunks of some megabytes. A chunk is written as numbers into its
own list of distinct units, in a table bucketed by chunk; the lists are dealt by a
hash of the unit, a unit once a chunk however often it occurs, looked up there, and
the ids come back to the chunk, whose numbers never move. Nothing is collected or
broadcast but the piece table.

Defined cases: null and empty texts have no pieces; a literal U+2581 decodes to a
space, so such a text does not survive the round trip; lone invalid byte pieces
decode to U+FFFD; a unit of any length is one unit; null ids stay null and repeated
rows give repeated result rows; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, work_dir

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: A unit, in the syntax of Arrow's regular expressions.
UNIT = rf"{SPACE}*(?:\p{{L}}+|\p{{Nd}}|[^\p{{L}}\p{{Nd}}{SPACE}]+)|{SPACE}+"
#: Spaces that no word begins with once a text is cut at its other spaces.
FURTHER = re.compile("(?<= ) |^ ")
#: Products of positions and codes are taken modulo this prime, so that sums stay within 64 bits.
PRIME = 2_147_483_647
MAX_PIECES = 1_000_000
#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 8 << 20
#: Characters of a unit that one row of the lattice starts from.
PART = 64
#: Units of a chunk's documents that are filled in at once; a longer document is taken alone.
FILL_UNITS = 250_000
#: Units of chunks that a task looks up.
TASK_UNITS = 60_000
#: Entries of an array that one inner fold goes through.
SLICE = 512


@dataclass(frozen=True)
class Pieces:
    """(text, id, score) of ordinary pieces; all pieces by id; the id of byte 0; the longest piece; the score of a byte path."""

    table: tuple[tuple[str, int, float], ...]
    by_id: tuple[str, ...]
    byte0: int
    longest: int
    unknown: float

    @property
    def spelled(self) -> pa.Array:
        """The bytes of each piece by id."""
        byte = lambda i: self.byte0 <= i < self.byte0 + 256
        return pa.array([bytes([i - self.byte0]) if byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.by_id)], pa.binary())


@lru_cache(maxsize=4)
def load_pieces(path: str = MODEL) -> Pieces:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    names = tuple(p.id_to_piece(i) for i in range(n))
    table = tuple((names[i], i, p.get_score(i)) for i in range(n) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i)))
    units, offsets = split_units(pa.array([t for t, _, _ in table], pa.string()))
    across = [table[i][0] for i in np.flatnonzero(np.diff(offsets) != 1)]
    if across:
        raise ValueError(f"pieces lie across units: {across[:5]}")
    byte0 = p.piece_to_id("<0x00>")
    if not p.is_byte(byte0):
        raise ValueError("the model has no byte pieces")
    return Pieces(table, names, byte0, max(len(t) for t, _, _ in table), min(s for _, _, s in table) - 10)


def free_sign(strings: pa.Array) -> str:
    """A character that occurs in none of the strings."""
    for code in (*range(0x1F, 0, -1), *range(0xF0000, 0xFFFFE), *range(0x100000, 0x10FFFE)):
        if not pc.any(pc.match_substring(strings, chr(code)), min_count=0).as_py():
            return chr(code)
    raise ValueError("every private character occurs")


def split_units(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all strings one after the other, and where those of each begin."""
    sign = free_sign(strings)
    lists = pc.split_pattern(pc.replace_substring_regex(strings, UNIT, sign + r"\0"), sign)
    parts, offsets = lists.flatten(), np.asarray(lists.offsets)
    keep = np.ones(len(parts), bool)
    keep[offsets[:-1]] = False  # nothing stands before a string's first unit
    return parts.filter(pa.array(keep)), offsets - np.arange(len(offsets))


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[0], starts[0] + 1, ... sizes[0] of them, then those of starts[1], and so on."""
    total = int(sizes.sum())
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 31) else np.int64
    out = np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct units by falling count, the unit numbers of all texts in order, and how many each text has."""
    full = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
    some = texts.filter(full) if pc.any(pc.invert(full), min_count=0).as_py() else texts
    counts = np.zeros(len(texts), np.int64)
    if not len(some):
        return pa.array([], pa.string()), np.zeros(0, np.int64), counts
    odd = pc.or_(pc.match_substring(some, SPACE), pc.or_(pc.match_substring(some, "  "), pc.starts_with(some, " ")))
    if pc.any(odd).as_py():
        some = pc.replace_with_mask(some, odd, pa.array([FURTHER.sub(SPACE, t.replace(SPACE, " ")) for t in some.filter(odd).to_pylist()], pa.string()))
    lists = pc.split_pattern(some, " ")
    words = lists.flatten().dictionary_encode()
    units, begin = split_units(pc.binary_join_element_wise(pa.scalar(SPACE), words.dictionary, ""))
    distinct = units.dictionary_encode()
    word = words.indices.to_numpy()
    sizes = np.diff(begin)[word]
    codes = distinct.indices.to_numpy()[gather(begin[:-1][word], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.asarray(lists.offsets)]
    counts[full.to_numpy(zero_copy_only=False)] = np.diff(ends)
    order = np.argsort(-np.bincount(codes, minlength=len(distinct.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return distinct.dictionary.take(pa.array(order)), rank[codes], counts


def units_of(text: str | None) -> list[str]:
    """The units of one text."""
    units, codes, _ = cut(pa.array([text], pa.string()))
    return units.take(pa.array(codes)).to_pylist()


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte by byte of their places, compressed."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def mark_of(text: bytes) -> bytes:
    """A 128-bit checksum of a text."""
    return hashlib.blake2b(text, digest_size=16).digest()


#: A chunk has one row of documents, and one for each group that some of its distinct units go to: ``n`` of them, with ``sign`` between.
CHUNK_ROWS = "chunk long, docs array<long>, counts array<long>, marks binary, codes binary, dealt binary, grp int, n int, sign string, units string"


def chunks(docs: DataFrame, groups: int) -> DataFrame:
    """CHUNK_ROWS of ``docs(doc_id, text)``; ``dealt``: the group of each unit by its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        names = [c.split()[0] for c in CHUNK_ROWS.split(", ")]
        for b in by_bytes(batches, "text", CHUNK):
            chunk += 1
            texts = b.column("text")
            units, codes, counts = cut(texts)
            marks = b"".join(mark_of(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts)
            dealt = np.array([zlib.crc32(u) % groups for u in units.cast(pa.binary()).to_pylist()], np.int64)
            head = [[chunk], [b.column("doc_id").to_pylist()], [counts], [marks], [squeezed(codes)], [squeezed(dealt)], [None], [None], [None], [None]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(head, kinds, strict=True)], names=names)
            if len(units):
                order = np.argsort(dealt, kind="stable")
                ends = np.append(np.flatnonzero(np.append(True, np.diff(dealt[order]) != 0)), len(order))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), units.take(pa.array(order)))
                sign, m = free_sign(units), len(lists)
                rest = [pa.nulls(m, k) for k in kinds[1:6]]
                own = [pa.array(dealt[order][ends[:-1]], pa.int32()), pa.array(np.diff(ends), pa.int32()), pa.array([sign] * m, pa.string()), pc.binary_join(lists, sign)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), *rest, *own], names=names)
            del texts, units, codes
            pa.default_memory_pool().release_unused()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, CHUNK_ROWS)


def best_path(edges: Column, pieces: Pieces) -> Column:
    """Ids of the best path over ``edges`` (sorted array of (end, start, id, score)); id -k stands for the bytes of code point k - 1.

    A fold copies its state at every step, so both ways are folded slice by slice: within
    a slice the state is bounded, and what a slice has finished is appended once. ``done`` are
    the best ways to the ends from ``base`` on; a piece reaches back no further than the
    ``longest`` that a slice hands on. A finished way is one number of its start and id.
    """
    wide, byte0 = pieces.longest, pieces.byte0
    way_type = "struct<score:double,start:int,id:int>"
    way = lambda score, start, id_: F.struct(score.cast("double").alias("score"), start.cast("int").alias("start"), id_.cast("int").alias("id"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    coded = lambda w: w["start"].cast("long") * F.lit(1 << 32) + w["id"] + F.lit(1 << 31)
    int0 = F.lit(0).cast("int")

    def in_slices(array: Column, init: Column, run: Callable[[Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
        count = F.greatest(F.ceil(F.size(array) / F.lit(SLICE)), F.lit(1)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), count), init, lambda acc, k: run(acc, F.slice(array, (k - 1) * SLICE + 1, F.lit(SLICE))), finish)

    def step(acc: Column, e: Column) -> Column:
        state = lambda done, best: F.struct(done.alias("done"), acc["base"].alias("base"), e["end"].alias("end"), best.alias("best"))
        before = F.when(e["start"] == acc["end"], acc["best"]["score"]).otherwise(F.element_at(acc["done"], e["start"] - acc["base"] + 1)["score"])
        new = way(before + e["score"], e["start"], e["id"])
        again = state(acc["done"], F.when(acc["best"]["score"] >= new["score"], acc["best"]).otherwise(new))
        return F.when(e["end"] == acc["end"], again).otherwise(state(F.concat(acc["done"], F.array(acc["best"])), new))

    def forth(acc: Column, part: Column) -> Column:
        def laid_away(i: Column) -> Column:
            over = F.greatest(F.size(i["done"]) - wide, int0)
            laid = F.concat(acc["laid"], F.transform(F.slice(i["done"], F.lit(1), over), coded))
            return F.struct(laid.alias("laid"), F.slice(i["done"], over + 1, F.lit(wide)).alias("done"), (i["base"] + over).alias("base"), i["end"].alias("end"), i["best"].alias("best"))

        return F.aggregate(part, F.struct(*(acc[c].alias(c) for c in ("done", "base", "end", "best"))), step, laid_away)

    def back(acc: Column, part: Column) -> Column:
        state = lambda ids, at, k: F.struct(ids.alias("ids"), at.cast("int").alias("at"), k.cast("int").alias("k"))

        def walk(a: Column, code: Column) -> Column:
            on = (a["at"] == a["k"]) & (a["k"] > 0)
            id_ = (code.bitwiseAND((1 << 32) - 1) - F.lit(1 << 31)).cast("int")
            return F.when(on, state(F.concat(a["ids"], F.array(id_)), F.shiftright(code, 32), a["k"] - 1)).otherwise(state(a["ids"], a["at"], a["k"] - 1))

        return F.aggregate(part, state(none("int"), acc["at"], acc["k"]), walk, lambda a: state(F.concat(acc["ids"], a["ids"]), a["at"], a["k"]))

    def ids_of(acc: Column) -> Column:
        ways = F.reverse(F.concat(acc["laid"], F.transform(F.concat(acc["done"], F.array(acc["best"])), coded)))
        start = F.struct(none("int").alias("ids"), acc["end"].alias("at"), acc["end"].alias("k"))
        return in_slices(ways, start, back, lambda a: F.reverse(a["ids"]))

    init = F.struct(none("bigint").alias("laid"), none(way_type).alias("done"), int0.alias("base"), int0.alias("end"), way(F.lit(0.0), F.lit(0), F.lit(0)).alias("best"))

    def in_bytes(i: Column) -> Column:
        code, tail = -i - 1, lambda x: F.lit(128) + x.bitwiseAND(63)
        up = lambda n: F.shiftright(code, n)
        utf8 = (
            F.when(code < 0x80, F.array(code))
            .when(code < 0x800, F.array(up(6) + 192, tail(code)))
            .when(code < 0x10000, F.array(up(12) + 224, tail(up(6)), tail(code)))
            .otherwise(F.array(up(18) + 240, tail(up(12)), tail(up(6)), tail(code)))
        )
        return F.when(i >= 0, F.array(i)).otherwise(F.transform(utf8, lambda x: x + F.lit(byte0)))

    found = in_slices(edges, init, forth, ids_of)
    return F.when(F.exists(edges, lambda e: e["id"] < 0), F.flatten(F.transform(found, in_bytes))).otherwise(found)


def segment(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(grp, name, ids) of the best path of every distinct (grp, unit) of ``units(chunk, grp, unit)``; name: the unit, or the digest of one above PART characters.

    The piece table is bounded by ``MAX_PIECES`` and broadcast. Units dealt by grp are
    segmented where they are; a long one is cut into parts first, so that no row but the last holds all of it.
    """
    table = units.sparkSession.createDataFrame(list(pieces.table), "piece string, id int, score double")
    reach = PART + pieces.longest - 1
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length("unit") - 1) / PART).cast("int")), lambda k: F.substring(F.col("unit"), k * PART + 1, F.lit(reach)))
    short = F.length("unit") <= PART
    # chunk is asked for so that the exchange below equals the one that looked_up reads, and is made once
    distinct = units.groupBy("grp", "unit").agg(F.max("chunk").alias("seen")).where("seen is not null")
    named = distinct.select("grp", F.when(short, F.col("unit")).otherwise(F.sha2("unit", 256)).alias("name"), F.posexplode(F.when(short, F.array("unit")).otherwise(parts)).alias("part", "body"))
    at = named.select("grp", "name", "part", "body", F.explode(F.sequence(F.lit(0), F.least(F.lit(PART), F.length("body")) - 1)).alias("start"))
    spans = at.select("grp", "name", "part", "body", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("body") - F.col("start")))).alias("size"))
    start = (F.col("part") * PART + F.col("start")).cast("int")
    pieces_of = spans.select("grp", "name", start.alias("start"), "size", F.substring("body", F.col("start") + 1, F.col("size")).alias("piece"))
    met = pieces_of.join(F.broadcast(table), "piece", "left").where("id is not null or size = 1")
    edge = F.struct((F.col("start") + F.col("size")).alias("end"), "start", F.coalesce("id", -(F.ascii("piece") + 1)).alias("id"), F.coalesce("score", F.lit(float(pieces.unknown))).alias("score"))
    return met.groupBy("grp", "name").agg(F.sort_array(F.collect_list(edge)).alias("edges")).select("grp", "name", best_path(F.col("edges"), pieces).alias("ids"))


def looked_up(dealt: DataFrame, known: DataFrame) -> DataFrame:
    """(chunk, grp, ids, sizes): the ids of ``dealt(chunk, grp, sign, units)``, all of a row in one blob, and how many each unit has."""

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        signs = left.column("sign").to_pylist()
        if len(set(signs)) == 1:
            lists = pc.split_pattern(left.column("units").combine_chunks(), signs[0])
        else:
            lists = pa.concat_arrays([pc.split_pattern(left.column("units").slice(k, 1).combine_chunks(), s) for k, s in enumerate(signs)])
        names = lists.flatten()
        long = pc.greater(pc.utf8_length(names), PART)
        if pc.any(long, min_count=0).as_py():
            names = pc.replace_with_mask(names, long, pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names.filter(long).to_pylist()], pa.string()))
        found = pc.index_in(names, right.column("name").combine_chunks())
        if found.null_count:
            raise ValueError("units without a path")
        ids = right.column("ids").combine_chunks()
        at, begin = found.to_numpy(), np.asarray(ids.offsets) - np.asarray(ids.offsets)[0]
        sizes = np.diff(begin)[at]
        flat = ids.flatten().to_numpy()[gather(begin[at], sizes)]
        rows = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
        ends = np.concatenate([[0], np.cumsum(sizes)])[rows]
        blobs = lambda x, e: pa.array([squeezed(x[a:b]) for a, b in zip(e[:-1], e[1:], strict=True)], pa.binary())
        return pa.table([left.column("chunk"), left.column("grp"), blobs(flat, ends), blobs(sizes, rows)], names=["chunk", "grp", "ids", "sizes"])

    return dealt.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(together, "chunk long, grp int, ids binary, sizes binary")


def joined_texts(ids: pa.ListArray, spelled: pa.Array) -> pa.Array:
    """The text of each list of ids, its leading space taken off."""
    pieces_of = pa.ListArray.from_arrays(ids.offsets, spelled.take(ids.values))
    raw = pc.binary_join(pieces_of, b"")
    try:
        texts = raw.cast(pa.string())
    except pa.ArrowInvalid:
        texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
    return pc.replace_substring_regex(texts, "^ ", "", max_replacements=1)


ENCODED = "doc_id long, ids array<int>, decoded string, n_units long, n_pieces long, ids_digest long, round_trip boolean"


def filled(left: pa.Table, right: pa.Table, spelled: pa.Array) -> pa.Table:
    """ENCODED rows of the documents of one chunk from its numbers and the ids of its units; some documents at a time."""
    row = {c: left.column(c)[0] for c in ("docs", "counts", "marks", "codes", "dealt")}
    codes, dealt = unsqueezed(row["codes"].as_py()), unsqueezed(row["dealt"].as_py())
    counts, marks, docs = row["counts"].values.to_numpy(), row["marks"].as_py(), row["docs"].values
    right = right.sort_by("grp")
    flat, sizes = (np.concatenate([np.zeros(0, np.uint32), *(unsqueezed(x) for x in right.column(c).to_pylist())]) for c in ("ids", "sizes"))
    if len(sizes) != len(dealt):
        raise ValueError("units of a chunk are missing")
    order = np.argsort(dealt, kind="stable")
    begin, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    begin[order], size[order] = np.cumsum(sizes, dtype=np.int64) - sizes, sizes
    units, names, out, at = np.concatenate([[0], np.cumsum(counts)]), [c.split()[0] for c in ENCODED.split(", ")], [], 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(units, units[at] + FILL_UNITS, side="right")) - 1)
        own = codes[units[at] : units[to]]
        n = size[own]
        ids = flat[gather(begin[own], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[units[at : to + 1] - units[at]]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
        texts = joined_texts(lists, spelled)
        place = np.arange(len(ids)) - np.repeat(ends[:-1], np.diff(ends)) + 1
        sums = np.concatenate([[0], np.cumsum((ids.astype(np.int64) + 1) * place % PRIME)])[ends]
        trips = [mark_of(t.as_buffer().to_pybytes()) == marks[16 * k : 16 * k + 16] for k, t in enumerate(texts, at)]
        columns = [docs.slice(at, to - at), lists, texts, pa.array(counts[at:to]), pa.array(np.diff(ends)), pa.array(np.diff(sums) % PRIME), pa.array(trips, pa.bool_())]
        out.append(pa.table(columns, names=names))
        at = to
    return pa.concat_tables(out)


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """ENCODED rows, one of every row of ``docs(doc_id, text, ...)``.

    decoded is the text of the ids. ids_digest is the sum of id plus one times one-based
    place, modulo PRIME; round_trip: decoded has the checksum (128 bits) of the text.
    Groups number eight times the shuffle partitions, so a group shrinks as partitions are added;
    tasks are made for about ``TASK_UNITS`` units of chunks each, so that their edges are sorted in memory.
    """
    spark = docs.sparkSession
    pieces = load_pieces(model)
    spelled = pieces.spelled
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    folder = work_dir(spark, "chunks")
    stored = bucketed(chunks(docs, 8 * n), folder, n)
    # read past the buckets, which nothing here needs: both readers of the exchange then have one plan
    lists = spark.read.schema(stored.schema).parquet(folder).where("grp is not null").select("chunk", "grp", "n", "sign", "units")
    total = lists.agg(F.sum("n")).first()[0] or 0
    lists = lists.drop("n")
    dealt = lists.repartition(max(n, min(8 * n, total // TASK_UNITS)), "grp")
    known = segment(dealt.select("chunk", F.col("grp").alias("g"), F.explode_outer(F.split("units", F.col("sign"))).alias("unit")).withColumnRenamed("g", "grp"), pieces)
    back = looked_up(dealt, known)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        return filled(left, right, spelled)

    whole = stored.where("docs is not null").select("chunk", "docs", "counts", "marks", "codes", "dealt")
    return whole.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(together, ENCODED)


def bucketed(rows: DataFrame, folder: str, n: int) -> DataFrame:
    """``rows`` written to ``folder`` in ``n`` buckets by chunk and read again; no name stays in the catalog."""
    spark, name = rows.sparkSession, f"chunks_{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").option("path", folder).bucketBy(n, "chunk").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"drop table {name}")  # the files of a table with a path of its own stay
    return stored


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) of every row of ``docs(doc_id, text, ...)``."""
    return encoded(docs, model).select("doc_id", "ids")


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of every row of ``rows(doc_id, ids)``; null ids give null."""
    spelled = load_pieces(model).spelled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                lists = part.column(1)
                known = lists.is_valid()
                texts = joined_texts(pc.fill_null(lists, pa.scalar([], lists.type)), spelled)
                yield pa.RecordBatch.from_arrays([part.column(0), pc.if_else(known, texts, pa.scalar(None, pa.string()))], names=["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
