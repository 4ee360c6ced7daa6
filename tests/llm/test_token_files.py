"""op13: ids against the library on whole texts, the files' layout, selective reads."""

from __future__ import annotations

import glob
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinframe.llm import queries
from kinframe.llm import token_files as t

WHOLE = Tokenizer.from_file(t.TOKENIZER)
with open(t.TOKENIZER, encoding="utf-8") as f:
    SPEC = f.read()


def plain(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, t.END_ID]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 ́'aAßéΣς1२<|>endoftx.,!日本", max_size=60), st.sampled_from(["a <|endoftext|> b", "x<|startoftext|>y", "it's they'LL é ́e"])), max_size=6))
def test_words_one_by_one_are_the_text(texts):
    raw = [None if x is None else x.encode("utf-8", "replace") for x in texts]
    assert t.encode_batch(pa.array(raw, pa.binary()), SPEC).to_pylist() == [plain(None if x is None else x.decode()) for x in raw]


def test_every_character_of_the_plain_alphabet():
    chars = [chr(k) for k in range(0x21, 0x180)] + ["'S", "'ll", "''d", "a'", "x1é", "É.", ".é", "≠", "é̀", "ªº", "²", "İI", "…", "ﬁ"]
    words = chars + [a + b for a in chars[::7] for b in chars[::5]] + ["a" * 3000, "é" * 2000 + "1" * 50]
    raw = pa.array([w.encode() for w in words] + [" ".join(words).encode()], pa.binary())
    assert t.encode_batch(raw, SPEC).to_pylist() == [plain(w) for w in words] + [plain(" ".join(words))]


def test_files_of_another_kind_encode_whole_texts():
    path = t.TOKENIZER.replace("word_bpe_49k", "byte_bpe_50k")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    texts = ["two  words \n", "", None, "Ünïcode's"]
    library = Tokenizer.from_file(path)
    want = [[*library.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]
    assert t.encode_batch(pa.array([x if x is None else x.encode() for x in texts], pa.binary()), spec).to_pylist() == want


DOCS = [(i * 3 % 101, f"document {i} " * (i % 7) + "Ünïcode's end", "s") for i in range(101)] + [(None, "no id", "s"), (7, "again, of id 7", "s"), (7, "again, of id 7", "s"), (500, None, "s"), (501, "", "s"), (502, "very long text " * 90_000, "s")]


def written(spark, path, **options):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, ids string").repartition(5)
    t.write_tokens(docs, path, **options)
    return {(r.doc_id, r.start): r for r in t.read_documents(spark, path).collect()}


def test_files_hold_the_corpus_in_order(spark, tmp_path):
    path = str(tmp_path / "tokens")
    got = written(spark, path, row_group_bytes=1 << 16, page_rows=8)
    assert len(got) == len(DOCS)
    corpus, at = [], 0
    for (d, start), r in sorted(got.items(), key=lambda kv: kv[0][1]):
        assert start == at and r.n_tokens == len(r.ids)
        corpus.append((d, r.ids))
        at += r.n_tokens
    assert [d for d, _ in corpus] == sorted((d for d, _, _ in DOCS), key=lambda d: (d is not None, d))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(corpus, key=key) == sorted([(d, plain(x)) for d, x, _ in DOCS], key=key)
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in t.checksums(t.read_documents(spark, path)).collect()}
    assert sums == {k: (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for k, r in got.items()}
    flat = [i for _, ids in corpus for i in ids]
    for first, stop in ((0, 5), (3, 40), (0, len(flat)), (len(flat) - 3, len(flat) + 9), (50, 51), (200, 200), (10**9, 10**9 + 5)):
        rows = sorted(t.read_span(spark, path, first, stop).collect(), key=lambda r: r.start)
        assert [i for r in rows for i in r.ids] == flat[first:stop]
        assert all(r.ids == flat[r.start : r.start + len(r.ids)] for r in rows)


def test_encodings_row_groups_and_page_indexes(spark, tmp_path):
    path = str(tmp_path / "tokens")
    written(spark, path, row_group_bytes=1 << 14, page_rows=4)
    for name in glob.glob(f"{path}/tokens/part-*.parquet"):
        meta = pq.ParquetFile(name).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_offset_index for c in columns.values())
            assert columns["doc_id"].has_column_index and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert {"DELTA_BINARY_PACKED"} <= set(columns["start_in_shard"].encodings) and "RLE_DICTIONARY" in columns["ids.list.element"].encodings


def scan_metrics(df):
    """(output rows, plan text) of the only scan of shard rows, once ``df`` has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    nodes = [plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    rows = []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan parquet") and "start_in_shard" in node.simpleString(1000) + "n_tokens":
            rows.append(node.metrics().apply("numOutputRows").value())
        children = node.children() if "QueryStage" not in node.nodeName() else None
        nodes += [node.plan()] if children is None else [children.apply(i) for i in range(children.size())]
    return rows, plan.toString()


def test_selective_reads(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.range(40_000).selectExpr("id as doc_id", "concat('text of number ', id) as text")
    t.write_tokens(docs, path, row_group_bytes=1 << 16, page_rows=128)
    largest = [pq.ParquetFile(name).metadata for name in glob.glob(f"{path}/tokens/part-*.parquet")]
    assert all(m.num_row_groups > 1 and max(m.row_group(g).total_byte_size for g in range(m.num_row_groups)) < 1 << 17 for m in largest)
    rows, plan = scan_metrics(t.shard_rows(spark, path).where("doc_id = 12345").select("doc_id", "ids"))
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,12345)]" in plan
    assert sum(rows) <= 256  # pages of 128 documents, not row groups of thousands
    meta = t.read_documents(spark, path).select("doc_id", "start", "n_tokens")
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split(">")[0]
    assert meta.agg({"n_tokens": "sum"}).first()[0] == t.shard_rows(spark, path).selectExpr("sum(size(ids))").first()[0]


def test_nothing_to_write(spark, tmp_path):
    t.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none"))
    assert t.checksums(t.read_documents(spark, str(tmp_path / "none"))).count() == 0
    assert t.read_span(spark, str(tmp_path / "none"), 0, 9).count() == 0


def test_query_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = set(), 0
    for d, text in texts:
        ids = plain(text)
        want.add((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in queries.op13_token_files(spark, sf).collect()} == want
