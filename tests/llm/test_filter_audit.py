"""op11: flags and counts against a plain count, the matrix against dictionaries of words."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import duckdb

from kinframe.llm import filter_audit as f
from kinframe.llm import queries

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_flags(docs):
    ids = {}
    for d, t, _ in docs:
        if d is not None:
            ids.setdefault(t or "", []).append(d)
    out = []
    for d, t, _ in docs:
        t = t or ""
        w = WORD.findall(t.encode())
        flags = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and min(ids[t]) < d)
        out.append((d, flags))
    return out


def plain_audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, x in labels if x == 1 and d is not None}
    rows = [(s or "", d, {x for x, hit in zip("ABCDE", flags, strict=True) if hit}) for (d, flags), (_, _, s) in zip(plain_flags(docs), docs, strict=True)]
    out, removed = {}, Counter()
    for part in {p for p, _, _ in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                mine = [(d, failed) for p, d, failed in rows if p == part]
                here = [d for d, failed in mine if x in failed and not failed & set(order[:k])]
                removed[part, x] += len(here)
                out[part, order, k + 1] = [sum(not failed & set(order[: k + 1]) for _, failed in mine), len(here), sum(x in failed and bool(failed & set(order[:k])) for _, failed in mine),
                                           sum(failed == {x} for _, failed in mine), sum(d in good for d in here), sum(d in toxic for d in here)]
    return {(*key, *v, removed[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def some_docs():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)] + ["BIG", "Über", "a#b", " ", "\x1c", "é|"]
    docs = [(i, " ".join(rng.choices(words[: rng.choice([5, 60, 80, 86])], k=rng.choice([0, 1, 49, 50, 51, 120]))), rng.choice(["s", "t", "", None])) for i in range(250)]
    docs += [(i, "copy of one text " * 20, "s") for i in range(300, 340)]  # a hot text
    docs += [(400, None, "s"), (401, "", None), (402, " \t\n\x0b\x0c\r", "t"), (None, "copy of one text " * 20, "t"), (None, None, None), (403, "x", "s"), (403, "x", "s"), (404, "x", "t"), (405, "Z" * 300_000 + " y", "s")]
    return docs


LABELS = [(i, i % 3 == 0, i % 5) for i in range(0, 420, 2)] + [(4, 1, 1), (4, 0, None), (None, 1, 1), (999_999, 1, 1)]
LABELS = [(d, int(q), None if x is None else int(x)) for d, q, x in LABELS]


def frames(spark, docs):
    with_extra = [(*d, "kept out", 7, 8) for d in docs]
    return spark.createDataFrame(with_extra, "doc_id long, text string, source string, digest string, e int, part int"), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit_equals_a_plain_count(spark):
    docs = some_docs()
    got = f.audit(*frames(spark, docs))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 3 * 600 and set(rows) == plain_audit(docs, LABELS)


def test_flags_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(f, "CHUNK_BYTES", 700)  # also: no text is hot by a part of the rows
    monkeypatch.setattr(f, "HOT", 0.9)
    docs = some_docs()
    rows = f.filter_flags(frames(spark, docs)[0].repartition(3)).collect()
    assert Counter((r.doc_id, (r.a, r.b, r.c, r.d, r.e)) for r in rows) == Counter(plain_flags(docs))


def test_matrix_rows(spark, monkeypatch):
    monkeypatch.setattr(f, "CHUNK_BYTES", 2000)
    docs = some_docs()
    rows, words = f.term_matrix(frames(spark, docs)[0])
    number = {r.term: bytes(r.word) for r in words.collect()}
    assert sorted(number) == list(range(len(number))) and len(set(number.values())) == len(number)
    got = Counter()
    for r in rows.collect():
        assert r.terms == sorted(set(r.terms))
        got[r.doc_id, frozenset((number[t], n) for t, n in zip(r.terms, r.counts, strict=True))] += 1
    assert got == Counter((d, frozenset(Counter(WORD.findall((t or "").encode())).items())) for d, t, _ in docs)


def test_words_travel_by_parts(spark, monkeypatch):
    monkeypatch.setattr(f, "PARTS", 7)
    monkeypatch.setattr(f, "PART_BYTES", 1)  # each part is numbered alone
    docs = [(i, " ".join([f"w{k}é" for k in range(i * 500, i * 500 + 1500)] + ["x" * 70_000, "w1", "w1"]), "s") for i in range(9)]
    df = frames(spark, docs)[0].repartition(3)
    lists = f.cut(df, 5, b"#").where("part is not null").collect()
    # a row a chunk and part, not a row a word: these are what is exchanged
    assert len(lists) <= 3 * 7 and sum(len(r.at) // 4 for r in lists) > 5000 and max(Counter((r.chunk, r.part) for r in lists).values()) == 1
    rows, words = f.term_matrix(df)
    number = {r.term: bytes(r.word) for r in words.collect()}
    assert sorted(number) == list(range(5502)) and len(set(number.values())) == 5502
    for r in rows.collect():
        assert r.terms == sorted(r.terms) and {number[t]: n for t, n in zip(r.terms, r.counts, strict=True)} == Counter(docs[r.doc_id][1].encode().split())


def test_no_documents_no_labels(spark):
    docs, labels = frames(spark, some_docs())
    assert f.audit(docs.filter("false"), labels).count() == 0
    assert f.audit(docs, labels.filter("false")).where("good_lost > 0 or toxic_lost > 0").count() == 0
    alone = f.audit(spark.createDataFrame([(1,)], "doc_id long"), labels)  # no text, no source: an empty text
    assert {(r.part, r.removed) for r in alone.where("step = 1").collect()} == {("", 0), ("", 1)}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = queries.op11_filter_audit(spark, "/root/testdata/sf0.001")
    want = con.sql(queries.ORACLE_SQL["op11_filter_audit"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
