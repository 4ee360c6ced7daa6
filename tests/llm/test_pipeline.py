"""The pipeline stage by stage: columns, and what each decision does."""

from __future__ import annotations

import corpus_pipeline as c
from kinframe.llm import secrets
from kinframe.llm.common import connected_components, stash, work_dir

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder, kept = work_dir(spark, "test"), []
    for k, (name, stage) in enumerate(c.STAGES):
        docs = stash(stage(spark, docs, SF), f"{folder}/{k}")
        kept.append((name, docs))
        if k < len(c.STAGES) - 1:
            assert docs.columns == list(c.DOCUMENTS)
    count = {n: d.count() for n, d in kept}
    assert count["language"] >= 190 and count["near_dups"] < count["language"] and count["secrets"] == count["near_dups"]
    assert count["pieces"] == count["mixing"]
    by = dict(kept)
    assert by["near_dups"].select("text").distinct().count() == count["near_dups"]
    assert not any(secrets.base_spans(r.text) for r in by["secrets"].collect())
    assert by["pieces"].filter("not round_trip").count() == 0
    assert by["mixing"].join(by["secrets"].select("doc_id"), "doc_id", "left_anti").count() == 0


def test_odd_documents_pass(spark):
    rows = [(1, None, None, None, None), (None, "some plain words here", "en", "s", 21), (2, "some plain words here", "en", None, 21), (2, "some plain words here", "en", None, 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        df = docs.filter("false") if empty else docs
        for k, (_, stage) in enumerate(c.STAGES):
            df = stash(stage(spark, df, SF), work_dir(spark, f"odd{k}"))
        if empty:
            assert df.count() == 0
        else:
            rows = df.collect()
            # one row of document 2 stays (both rows of the text may be emitted more than once), and the one without an id
            assert {r.doc_id for r in rows} == {None, 2} and all(r.round_trip and r.decoded == "some plain words here" for r in rows)


def test_unlike_texts_of_one_id_are_documents(spark):
    words = [f"word{i}" for i in range(400)]
    a, other, third = " ".join(words[:120]), " ".join(words[150:270]), " ".join(words[280:])
    rows = [(1, a), (2, a + " end"), (2, other), (2, other), (3, other + " end"), (4, third), (4, third + " end"), (None, a), (5, None), (5, third[:900] + " x")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in c.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert len(got) == len(set(got))
    texts = {t for _, t in got}
    assert (1, a) in got and (None, a) in got and (2, a + " end") not in got
    assert (5, None) in got
    # one of each group of near copies is left, and no group is lost
    groups = [{other, other + " end"}, {third, third + " end", third[:900] + " x"}]
    assert all(len(texts & g) >= 1 for g in groups) and len(texts & groups[0]) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, k) for k in range(8, 40)] + [(5, 5), (200, 201), (201, 202), (202, 200), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), work_dir(spark, "cc")).collect())
    assert got == {i: 100 for i in range(101, 131)} | {k: 7 for k in range(8, 40)} | {k: 200 for k in (201, 202)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), work_dir(spark, "cc")).count() == 0
