"""Language identification by compression (operator 2).

Each language gets a zstandard raw-content dictionary made of sample texts; a text
belongs to the language whose dictionary makes it smallest, and is rejected when
the runner-up is nearly as good. Whole texts are coded, block by block, so that a
long text is judged by the dictionaries to its end and not by its own beginning.

Bounds: at most ``sample_docs`` texts of ``sample_chars`` characters at most per
language are gathered for fitting (a pure function of the hash of doc_id), and
``dict_bytes`` of them are kept; more than ``max_languages`` languages raise.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; with no labelled row at all every text is ``und``; equal sizes go to the
first language in code-point order with score 0; rows with null doc_id count as not
held out; input columns other than the ones named pass through unless an added
column has their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LETTER, by_bytes

#: Bytes of text that are judged at once; a longer text is taken alone.
BATCH_BYTES = 2 << 20

ADDED = "lang_pred string, score double, rejected boolean"


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_dictionaries(labelled: DataFrame, sample_docs: int = 64, sample_chars: int = 20_000, dict_bytes: int = 110_000, max_languages: int = 500) -> dict[str, bytes]:
    """Per language the lower-cased sample texts, cut to ``dict_bytes``; from (text, lang), distinct texts drawn by a hash of the text."""
    rows = labelled.select("text", "lang").where("lang is not null and text is not null")
    usable = rows.where(f"length(text) between 1 and {int(sample_chars)}")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return {}
    draw = F.xxhash64("text")
    # keep about four times the sample by a threshold on the draw, so that ranking is small
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 4.0 * sample_docs / n))])
    near = usable.withColumn("draw", draw).where((F.shiftrightunsigned("draw", 11).cast("double") / F.lit(float(1 << 53))) <= F.element_at(share, F.col("lang")))
    # copies have one draw and go before they are dealt: a language's window has some hundred rows
    near = near.groupBy("lang", "draw").agg(F.min("text").alias("text"))
    best = Window.partitionBy("lang").orderBy("draw")
    chosen = near.withColumn("k", F.row_number().over(best)).where(F.col("k") <= sample_docs).select("lang", "k", "text").collect()
    out: dict[str, bytes] = {}
    for lang in sorted({r["lang"] for r in chosen}):
        texts = [r["text"].lower() for r in sorted(chosen, key=lambda r: r["k"]) if r["lang"] == lang]
        out[lang] = "\n".join(texts).encode("utf-8", "replace")[:dict_bytes]
    return out


def coders(dictionaries: list[bytes], level: int) -> list:
    """One compressor per dictionary; each indexes its dictionary once."""
    import zstandard as zstd

    out = []
    for content in dictionaries:
        known = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        out.append(zstd.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False))
    return out


def sizes(texts: list[bytes], compressors: list, block: int):
    """A row per text and a column per compressor: compressed bytes, summed over blocks."""
    import numpy as np

    blocks, starts = [], []
    for t in texts:
        starts.append(len(blocks))
        blocks += [t[i : i + block] for i in range(0, len(t), block)]
    out = np.zeros((len(texts), len(compressors)), dtype=np.int64)
    for k, c in enumerate(compressors):
        got = np.fromiter((len(c.compress(b)) for b in blocks), dtype=np.int64, count=len(blocks))
        if len(texts):
            out[:, k] = np.add.reduceat(got, starts)
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.005, level: int = 6, block: int = 1024) -> DataFrame:
    """``docs`` with lang_pred, score (the runner-up's excess, 0 to 1) and rejected.

    One pass over the rows without a shuffle; the dictionaries, of bounded size, travel with the tasks.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    langs, contents = list(dictionaries), list(dictionaries.values())
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in names), ADDED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        compressors = coders(contents, level)
        for batch in by_bytes(batches, names.index("text"), BATCH_BYTES, 500):
            texts = batch.column(names.index("text")).to_pylist()
            good = [i for i, t in enumerate(texts) if langs and t is not None and LETTER.search(t)]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if good:
                table = sizes([texts[i].lower().encode("utf-8", "replace") for i in good], compressors, block)
                best = table.argmin(axis=1)
                low = table.min(axis=1)
                rest = np.partition(table, 1, axis=1)[:, 1] if len(langs) > 1 else low * 2
                margin = np.clip((rest - low) / np.maximum(rest, 1), 0, 1)
                for i, b, m in zip(good, best, margin, strict=True):
                    pred[i], score[i] = langs[b], float(m)
            rejected = [p == "und" or s < min_margin for p, s in zip(pred, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, "lang_pred", "score", "rejected"])

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)
