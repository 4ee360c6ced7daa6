"""Token ids in Parquet files (operator 13).

Documents are put in order of id by one range exchange; each task of it encodes its
documents and writes them as one shard: a row a document with its id, its number of
tokens, its start within the shard and a list column of token ids. Spark's own writer
makes the files, so they lie in any store it knows and lost executors cost a task:

* ids are dictionary-encoded (a vocabulary fits a dictionary page), the ascending
  columns delta-encoded (version 2 of the format), all in row groups of a stated size,
  so that no reader decodes more at once than that or one document;
* pages hold a stated number of documents and have page indexes, so that a search for
  ids or starts reads the pages that can hold them, and metadata is read without tokens.

A small table beside them has a row a shard: its first token within the corpus, its
numbers of tokens and documents, its least and greatest id. Starts in the corpus are
those within the shard plus the shard's.

Words between white space are encoded once a batch and dealt out to their places: the
vocabulary's normaliser and pattern keep nothing across white space, so a text's ids are
those of its words one after another. Files of another kind encode whole texts. Strings of special tokens in a text are what the
library makes of them (a special id).

Defined cases: a null text is empty and has the end id only; documents without an id
come first; rows of one id are in order of a hash of their text, and equal rows are
alike, so that any order of them gives the same result; other columns are not read;
an empty table gives no files' rows and an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, columns_or_null
from .words import split_words

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
END_ID = 1
#: Bytes of text encoded at once, or one longer text.
BATCH_BYTES = 8 << 20
#: Words handed to the library at once.
BATCH_WORDS = 8192
#: Pieces of words that a worker keeps the ids of.
MOST_PIECES = 1 << 18
ROW_GROUP_BYTES = 16 << 20
PAGE_ROWS = 512

#: The normaliser and pattern of the vocabulary file, for which words can be encoded one by one.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
LATIN = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PLAIN = re.compile(rf"[!-~{LATIN}]*")
#: That pattern on lower-case words of the plain alphabet.
PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}]+")

SHARD_ROW = "shard int, doc_id long, start_in_shard long, n_tokens long, ids array<int>"


class Words:
    """Ids of words by the library, each piece of a word looked up once.

    Where the file's normaliser and pattern are ``KNOWN``, a text's ids are those of its words, and a
    word of the plain alphabet (printable ASCII and the letters of Latin-1, which
    composition leaves alone and lower case maps one to one) those of its matches of the
    pattern, which the library's model then merges. Other words, and those with a
    special token's string, go through the whole library.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        file = json.loads(spec)
        self.by_words = {"normalizer": file["normalizer"], "pre_tokenizer": file["pre_tokenizer"]} == KNOWN
        self.special = [t["content"] for t in file["added_tokens"]]
        self.by_words = self.by_words and all("<" in c for c in self.special)
        self.pieces: dict[str, bytes] = {}
        if self.by_words:  # the model's spelling of a letter's bytes, as the library gives it
            self.spelled = {ord(c): "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in LATIN}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as little-endian 32-bit integers."""
        out = []
        for at in range(0, len(texts), BATCH_WORDS):
            out += [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + BATCH_WORDS], add_special_tokens=False)]
        return out

    def piece(self, text: str) -> bytes:
        """Ids of a piece that is not held yet."""
        if len(self.pieces) >= MOST_PIECES:
            self.pieces.clear()
        spelled = text if text.isascii() else text.translate(self.spelled)
        ids = self.pieces[text] = array("i", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        return ids

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words without white space."""
        out: list[bytes] = [b""] * len(words)
        rest, held, plain, pieces = [], self.pieces.get, PLAIN.fullmatch, PATTERN.findall
        special = re.compile("|".join(map(re.escape, self.special)) or "(?!)").search
        for k, w in enumerate(words):
            if plain(w) and not ("<" in w and special(w)):
                out[k] = b"".join([held(p) or self.piece(p) for p in pieces(w.lower())])
            else:
                rest.append(k)
        for k, ids in zip(rest, self.whole([words[k] for k in rest]), strict=True):
            out[k] = ids
        return out


@lru_cache(maxsize=1)
def words_of(spec: str) -> Words:
    return Words(spec)


def spelled(values: pa.Array) -> list[str]:
    """Strings of a binary array; what is no UTF-8 becomes the replacement character."""
    try:
        return values.cast(pa.string()).to_pylist()
    except pa.ArrowInvalid:
        return [w.as_buffer().to_pybytes().decode("utf-8", "replace") for w in values]


def encode_batch(texts: pa.Array, spec: str, end_id: int = END_ID) -> pa.ListArray:
    """Lists of ids of a binary array of texts, each with ``end_id`` behind it."""
    library = words_of(spec)
    if library.by_words:
        words, per_text = split_words(texts)
        coded = words.dictionary_encode()
        parts, which = library.words(spelled(coded.dictionary.cast(pa.binary()))), coded.indices.to_numpy()
    else:
        parts, which, per_text = library.whole(spelled(pc.fill_null(texts, b""))), np.arange(len(texts)), np.ones(len(texts), dtype=np.int64)
    flat = np.frombuffer(b"".join(parts), dtype=np.int32)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
    first = np.cumsum(size) - size
    sizes = size[which]
    before = np.cumsum(sizes) - sizes
    ids = flat[np.repeat(first[which] - before, sizes) + np.arange(int(sizes.sum()))]
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(per_text)]
    offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.insert(ids, ends, end_id).astype(np.int32)))


def encode_in_order(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Rows of shards in ascending order of doc_id, one shard a task of a range exchange."""
    with open(tokenizer, encoding="utf-8") as f:  # the vocabulary: a few megabytes, whatever the corpus
        spec = f.read()
    plain = columns_or_null(docs, {"doc_id": "long", "text": "string"})
    plain = plain.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"), F.xxhash64("text").alias("_tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ranged = plain.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = 0
        for batch in by_bytes(batches, "raw", BATCH_BYTES):
            ids = encode_batch(batch.column("raw"), spec, end_id)
            sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
            ends = start + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), pa.array(ends - sizes), pa.array(sizes), ids], names=["shard", "doc_id", "start_in_shard", "n_tokens", "ids"])
            start = int(ends[-1]) if len(ends) else start

    return ranged.select(F.spark_partition_id().alias("shard"), "doc_id", "raw").mapInArrow(run, SHARD_ROW)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Write ``path/tokens`` (rows of shards) and ``path/shards`` (a row a shard)."""
    writer = encode_in_order(docs, tokenizer, end_id).write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for column in ("shard", "doc_id", "start_in_shard", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")  # delta in version 2
    # sizes are looked at from the tenth document on, as documents can be long
    writer = writer.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.row.count.limit", str(page_rows)).option("parquet.page.size.row.check.min", "10")
    writer.parquet(f"{path}/tokens")
    spark = docs.sparkSession
    shards = shard_rows(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"), F.min("doc_id").alias("least_id"), F.max("doc_id").alias("greatest_id"))
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    shards.withColumn("first_token", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(f"{path}/shards")


def shard_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_ROW).parquet(f"{path}/tokens")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, start, n_tokens, ids; only the columns asked for are read, and only pages that filters on doc_id can meet."""
    shards = spark.read.parquet(f"{path}/shards").select("shard", "first_token")  # as many rows as the exchange had partitions
    return shard_rows(spark, path).join(F.broadcast(shards), "shard").select("shard", "doc_id", (F.col("first_token") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, path: str, first: int, stop: int) -> DataFrame:
    """(doc_id, start, ids): the parts of documents that make up tokens ``first`` to ``stop - 1`` of the corpus.

    The shards that hold them are looked up first (a filter on at most all shards'
    rows), so the files are read by pushed filters on shard and start.
    """
    shards = spark.read.parquet(f"{path}/shards").where((F.col("first_token") < stop) & (F.col("first_token") + F.col("n_tokens") > first))
    bounds = shards.agg(F.min("shard"), F.max("shard"), F.min("first_token"), F.max("first_token")).first()
    rows = shard_rows(spark, path)
    if bounds[0] is None:
        return rows.where("false").select("doc_id", F.col("start_in_shard").alias("start"), "ids")
    low, high, low_first, high_first = bounds
    # pushed: other shards, and in the last one what starts too late
    near = rows.where(F.col("shard").between(low, high) & ((F.col("shard") < high) | (F.col("start_in_shard") < stop - high_first)))
    near = near.where((F.col("shard") > low) | (F.col("start_in_shard") + F.col("n_tokens") > first - low_first))
    placed = near.join(F.broadcast(shards.select("shard", "first_token")), "shard").withColumn("start", F.col("first_token") + F.col("start_in_shard"))
    placed = placed.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0))
    size = F.least(F.col("start") + F.col("n_tokens"), F.lit(stop)) - F.col("start") - skip
    return placed.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), size.cast("int")).alias("ids"))


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read from files; counts and checksums are of the ids that are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pc.list_value_length(ids).cast(pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
