"""op7: links against brute force, excluded vectors, copies."""

from __future__ import annotations

import numpy as np

from kinframe.llm import queries
from kinframe.llm import vectors as v


def brute(x, threshold=0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= threshold
    np.fill_diagonal(links, False)
    of = np.arange(len(x))
    while True:
        new = np.array([min([of[i], *of[links[i]]]) for i in range(len(x))])
        if (new == of).all():
            return links.sum(axis=1), of
        of = new


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 32))
    x = np.concatenate([base[rng.integers(0, 40, 600)] + 0.25 * rng.standard_normal((600, 32)), rng.standard_normal((300, 32))]).astype(np.float32)
    df = spark.createDataFrame([(i, row.tolist(), 1) for i, row in enumerate(x)], "vec_id long, embedding array<float>, n_links int")
    got = sorted(tuple(r) for r in v.near_vectors(df, window=64).collect())
    links, of = brute(x.astype(float))
    found = np.array([r[1] for r in got])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()
    assert np.mean([r[2] == c for r, c in zip(got, of, strict=True)]) >= 0.99
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_excluded_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (11, [1e200, 1e199]), (12, [0.0, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in v.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {k: got[k][:2] for k in (1, 2, 3, 11)} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 11: (3, 1)}
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 12))
    assert v.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_window_borders_do_not_matter(spark):
    x = np.random.default_rng(1).standard_normal((200, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = []
    for n in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(tuple(r) for r in v.near_vectors(df, window=40, passes=3).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_more_vectors_more_passes():
    assert v.passes_for(100, 256, 0.9) == 4
    assert v.passes_for(10**6, 256, 0.9) < v.passes_for(10**9, 256, 0.9)


def test_dense_cluster_keeps_its_links(spark):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(64)
    members = centre / np.linalg.norm(centre) + 0.0287 * rng.standard_normal((1500, 64))
    x = np.concatenate([members, rng.standard_normal((3000, 64))]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in v.near_vectors(df, window=32).collect())
    links, of = brute(x.astype(float))
    found = np.array([r[1] for r in got])
    assert (found <= links).all() and found.sum() >= 0.998 * links.sum()
    assert [r[2] for r in got] == of.tolist()


def test_blocks_of_a_bucket_do_not_matter(spark):
    x = np.random.default_rng(3).standard_normal((300, 4)).astype(np.float32)
    rows = [(i, r.tolist(), i % 3 + 1) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, vec array<float>, copies long")
    got = []
    for k, block in enumerate((2048, 7)):
        found = v.links(df, v.work_dir(spark, f"blocks{k}"), 0.9, 3, 1, 7, block=block)
        got.append(sorted(tuple(r) for r in found.groupBy("id").sum("near").where("`sum(near)` > 0").collect()))
    assert got[0] == got[1] and got[0]


def test_null_and_repeated_ids(spark):
    e = lambda *x: [float(v) for v in x]
    rows = [(1, e(1, 0, 0)), (2, e(1, 0.01, 0)), (5, e(0, 1, 0)), (6, e(0, 1, 0.01)), (2, e(0, 1, 0)), (2, e(0, 1, 0)), (None, e(1, 0, 0)), (9, e(0, 0, 1))]
    got = sorted(tuple(r) for r in v.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() if r.vec_id)
    # id 2 has a vector of each group, so both are one component
    assert [(v, c, k) for v, _, c, k in got] == [(1, 1, True), *[(2, 1, False)] * 3, (5, 1, False), (6, 1, False), (9, 9, True)]
    assert dict((v, n) for v, n, _, _ in got)[9] == 0 and dict((v, n) for v, n, _, _ in got)[6] == 3


def test_unlike_vectors_of_one_id_have_their_own_links(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.02]), (3, [0.0, 1.0]), (3, None), (4, [0.01, 1.0]), (5, [0.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in v.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    # id 3: two links by its first vector, one by its second, none without a vector; its row ties both groups
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 1, 1, False), (3, 0, 1, False), (4, 1, 1, False), (5, 0, 5, True), (-1, 0, None, True)], key=str)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in table], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in queries.op7_vectors(spark, sf).collect()}
    assert got == {r.vec_id: int(k) for r, k in zip(table, near, strict=True)}
