"""op2: held-out accuracy and defined cases."""

from __future__ import annotations

import zlib

from kinframe.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = queries.op2_language(spark, SF).join(docs, "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in test) / len(test) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) / len(rows) < 0.02


def test_defined_cases(spark):
    known = {"a": b"lorem ipsum dolor sit amet " * 20, "b": b"quux frobnicate wibble wobble " * 20}
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "lorem ipsum dolor sit amet", "x"), (4, "wibble wobble frobnicate quux " * 9000, "x"), (None, "x", None)], "doc_id long, text string, score string")
    got = language.identify(df, known).collect()
    assert [r.lang_pred for r in got[:5]] == ["und", "und", "und", "a", "b"]
    assert [r.rejected for r in got[:5]] == [True, True, True, False, False]
    assert got[0].score == 0.0 and got[5].lang_pred == "a" and got[5].rejected
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}
    assert language.identify(df.filter("false"), known).count() == 0
    assert language.learn_dictionaries(spark.createDataFrame([(1, "t", None), (2, None, "a")], "doc_id long, text string, lang string")) == {}


def test_dictionaries_are_bounded_and_repeatable(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = language.learn_dictionaries(docs, dict_bytes=5000)
    assert sorted(one) == ["de", "en", "es", "fr"] and all(len(d) <= 5000 for d in one.values())
    assert one == language.learn_dictionaries(docs.repartition(3), dict_bytes=5000)


def test_ids_are_no_input_of_learning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    moved = docs.selectExpr("doc_id + 1000003 as doc_id", "text", "lang")
    assert language.learn_dictionaries(docs) == language.learn_dictionaries(moved.repartition(5))


def test_copies_do_not_flood_the_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    hot = docs.where("lang = 'en' and length(text) < 20000").orderBy("text").limit(1).collect()[0]
    # the text that the sample has anyway, or would have had: dictionaries of the distinct texts stay as they are
    flooded = docs.unionByName(spark.range(3000).selectExpr("id").crossJoin(spark.createDataFrame([hot], docs.schema)).select("text", "lang"))
    assert language.learn_dictionaries(flooded) == language.learn_dictionaries(docs)
    # ties and too many languages
    same = spark.createDataFrame([("one two three four", "b"), ("one two three four", "a")], "text string, lang string")
    known = language.learn_dictionaries(same)
    row = language.identify(same, known).first()
    assert (row.lang_pred, row.score, row.rejected) == ("a", 0.0, True)
    try:
        language.learn_dictionaries(same, max_languages=1)
        raise AssertionError
    except ValueError:
        pass
