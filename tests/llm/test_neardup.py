"""op1: signatures, similarity and components against brute force."""

from __future__ import annotations

import math
import random

import numpy as np

from kinframe.llm import neardup as n

WORDS = [f"w{i}" for i in range(400)]


def text(rng, k):
    return " ".join(rng.choice(WORDS) for _ in range(k))


def changed(rng, t, k):
    words = t.split()
    for _ in range(k):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def brute(texts, threshold=0.8):
    """Least id reachable over pairs whose shingle sets, or weighted sets, are similar enough."""
    h, ids = n.WordHashes(), sorted(texts)
    split = {d: (texts[d] or "").lower().split() for d in ids}
    of = {d: d for d in ids}

    def root(d):
        while of[d] != d:
            d = of[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if split[a] and split[b] and n.similarity(split[a], split[b], h) >= threshold:
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_probability_jaccard_by_definition():
    rng, h = random.Random(1), n.WordHashes()
    for _ in range(20):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
        b = [rng.choice("abc") for _ in range(rng.randint(1, 40))]
        bags = []
        for words in (a, b):
            bag = {}
            for g in [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or [tuple(words)]:
                bag[g] = bag.get(g, 0) + 1
            bags.append({g: 1 + math.log(c) for g, c in bag.items()})
        x, y = bags
        both = x.keys() & y.keys()
        slow = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys()) for d in both)
        plain = len(both) / len(x.keys() | y.keys())
        assert abs(n.similarity(a, b, h) - max(slow, plain)) < 1e-12


def test_registers_agree_as_often_as_the_similarity():
    rng, h = random.Random(2), n.WordHashes()
    base = text(rng, 300)
    texts = [base.split()] + [changed(rng, base, k).split() for k in (2, 5, 10, 20)]
    owner, keys, counts = n.shingles(texts, h)
    found = n.prob_min_hash(owner, keys, counts, len(texts), 2000)
    for k in range(1, len(texts)):
        assert abs((found[0] == found[k]).mean() - n.similarity(texts[0], texts[k], h)) < 0.05
    again = n.prob_min_hash(owner, keys, counts * 3, len(texts), 2000)
    assert (again == found).all()  # weights matter up to a factor


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    texts, k = {}, 0
    for g in range(12):
        base = text(rng, rng.choice([3, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 9])):
            texts[k] = changed(rng, base, rng.choice([0, 0, 1, 2, 3]))
            k += 1
    texts |= {k: None, k + 1: "", k + 2: " \n ", k + 3: "One two", k + 4: "one  TWO", k + 5: texts[5].upper()}
    df = spark.createDataFrame([(t, d, "x") for d, t in texts.items()], "text string, doc_id long, kept string")
    got = {r.doc_id: (r.component_id, r.kept) for r in n.near_duplicates(df).collect()}
    want = brute(texts)
    assert {d: c for d, (c, _) in got.items()} == want
    assert all(kept == (d == c) for d, (c, kept) in got.items())


def test_empty_repeated_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert n.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = sorted(tuple(r) for r in n.near_duplicates(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (2, "a b")], schema)).collect() if r.doc_id)
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False)]


def test_plain_jaccard_pairs_and_unlike_texts_of_one_id(spark):
    rng, texts = random.Random(5), {}
    for g in range(40):  # the same distinct shingles, one block repeated 1 or 50 times: plain Jaccard is near 1, probability Jaccard is not
        block, rest = text(rng, 24), text(rng, 100)
        texts |= {2 * g: f"{block} {rest}", 2 * g + 1: f"{' '.join([block] * 50)} {rest}"}
    other = text(rng, 80)
    rows = [*texts.items(), (500, text(rng, 80)), (500, other), (501, other + " end")]
    got = {r.doc_id: r.component_id for r in n.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2 * g + k: 2 * g for g in range(40) for k in (0, 1)} | {500: 500, 501: 500}


def test_long_text_is_not_cut():
    h = n.WordHashes()
    a = ["x", *[str(i) for i in range(60_000)]]
    assert n.similarity(a, [*a, "tail"], h) > 0.99
    assert n.similarity(a, [*a[:30_000], *[f"z{i}" for i in range(30_000)]], h) < 0.5
    assert np.unique(n.shingles([a], h)[1]).size == len(a) - 4


def test_large_loose_group_equals_brute_force(spark):
    rng = random.Random(9)
    base, common = text(rng, 150), text(rng, 8)
    texts = {d: changed(rng, base, rng.choice([0, 1, 2, 3, 3, 4, 5, 8, 12])) for d in range(110)}
    texts |= {200 + d: " ".join([common] * rng.choice([5, 60]) + [text(rng, rng.randint(5, 60))]) for d in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in n.near_duplicates(df).collect()}
    assert got == brute(texts)
