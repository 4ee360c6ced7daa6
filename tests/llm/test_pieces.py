"""op6: best paths against the library's own search, round trip, digests."""

from __future__ import annotations

import pytest
import sentencepiece

from kinframe.llm import pieces as p

TEXTS = ["Hello  world\nthis\t is é日本𠮷 12", "", None, " a ", "   lead", "x" * 130, "a_b(c){d}; foo->bar == baz   \n    indent", "naïve café ½ x² 10³ ², हिन्दी", "thatanentsh, Iononble!!", "ends with space "]


@pytest.fixture(scope="module")
def model(tmp_path_factory):
    """The piece table as a unigram model; two forbidding scores are lifted, for the library adds in 32 bits."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(p.MODEL, "rb").read())
    m.trainer_spec.model_type = 1
    for x in m.pieces:
        x.score = max(x.score, -40_000.0)
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


def frame(spark, texts):
    return spark.createDataFrame([(t, i, 0) for i, t in enumerate(texts)], "text string, doc_id long, ids int")


def test_paths_equal_the_library(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = TEXTS + [x for t in docs[:60] for x in t.split("\n") if len(x) < 1500][:150]
    got = {r.doc_id: r.ids for r in p.encode(frame(spark, texts), model).collect()}
    assert [got[i] for i in range(len(texts))] == [sp.encode(t or "") for t in texts]


def test_round_trip_and_figures(spark):
    texts = [*TEXTS, "▁literal", TEXTS[0], "日本𠮷 " * 300, "".join(chr(i) for i in range(1, 0x2000))]
    rows = p.encoded(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r for r in rows}
    back = {r.doc_id: r.text for r in p.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in rows], "doc_id long, ids array<int>")).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert r.decoded == back[i] and r.round_trip == (r.decoded == (t or "")) == (i != len(TEXTS))
        assert r.n_pieces == len(r.ids) and r.n_units == len(p.units_of(t)) and r.ids_digest == sum((x + 1) * k for k, x in enumerate(r.ids, 1)) % p.PRIME
    assert got[0].ids == got[len(TEXTS) + 1].ids


def test_null_and_repeated_ids_and_clashing_columns(spark):
    rows = [(None, "one two", "x", 1), (None, "one two", "y", 2), (3, "three", "z", 3), (3, "other", "z", 3), (4, None, None, None)]
    got = p.encoded(spark.createDataFrame(rows, "doc_id long, text string, unit string, chunk int")).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == [(0, "one two"), (0, "one two"), (3, "other"), (3, "three"), (4, "")]


def test_chunks_of_any_size_give_equal_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    whole = sorted(map(tuple, p.encoded(docs).select("doc_id", "ids_digest", "n_units").collect()))
    import pyarrow as pa

    from kinframe.llm.common import by_bytes

    batch = pa.RecordBatch.from_pydict({"text": [None, "", "ab" * 40, "c" * 500, "d", "e"], "k": list(range(6))})
    for most in (1, 40, 10_000):
        parts = list(by_bytes([batch.slice(0, 4), batch.slice(4, 0), batch.slice(4)], "text", most))
        assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist() and len(parts) == {1: 6, 40: 4, 10_000: 1}[most]
    assert whole == sorted(map(tuple, p.encoded(docs.repartition(7)).select("doc_id", "ids_digest", "n_units").collect()))


@pytest.mark.parametrize("size", [64, 65, 81, 2_000, 200_000])
def test_long_units(spark, model, size):
    word = ("thatanentshionononblequedoosäöü日本" * (size // 30 + 1))[:size]
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    r = p.encoded(frame(spark, [word]), model).collect()[0]
    assert r.n_units == 1 and r.round_trip
    if size <= 2_000:
        assert r.ids == sp.encode(word)


def test_empty_table(spark):
    df = frame(spark, ["a"]).filter("false")
    assert p.encode(df).count() == 0 and p.decode(p.encode(df)).count() == 0


def test_units_cover_texts():
    for t in TEXTS:
        assert "".join(p.units_of(t)) == ("▁" + t.replace(" ", "▁") if t else "")


def test_the_query_returns_ids_and_their_text(spark):
    from kinframe.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op6_pieces(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.decoded == (texts[r.doc_id] or "") and r.round_trip for r in rows)
