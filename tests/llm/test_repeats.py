"""op8: removal against brute force; arrays and intervals against definitions."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from kinframe.llm import repeats as r


def brute(docs):
    first, out = {}, []
    for d, t in sorted(docs, key=lambda x: x[0]):
        t = (t or "").encode()
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            s = t[i : i + 50]
            if first.setdefault(s, d) < d:
                cover[i : i + 50] = True
        kept = np.frombuffer(t, np.uint8)[~cover].tobytes()
        spans = int((cover[1:] & ~cover[:-1]).sum() + (cover[0] if len(t) else 0))
        out.append((d, len(t), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_removal_equals_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    docs = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        docs.append((d * 3 - 20, "".join(parts)))
    docs += [(500, None), (501, ""), (502, docs[3][1]), (503, docs[3][1]), (504, "a" * 3000), (505, "a" * 49), (506, "a" * 50), (507, "ab" * 400), (508, docs[5][1][:70])]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, mark int")
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.remove_repeats(df).collect())
    assert got == brute(docs)


def test_real_texts(spark):
    from kinframe.llm import queries

    docs = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(x) for x in queries.op8_repeats(spark, "/root/testdata/sf0.001").collect()) == brute(docs)


def test_empty_repeated_and_null_ids(spark):
    schema, long = "doc_id long, text string", "some text of more than fifty bytes, " * 3
    assert r.remove_repeats(spark.createDataFrame([], schema)).count() == 0
    got = r.remove_repeats(spark.createDataFrame([(1, long), (1, long), (None, long), (2, long + "x")], schema)).collect()
    assert sorted((x.doc_id or -1, x.n_removed) for x in got) == [(-1, 0), (1, 0), (1, 0), (2, 108)]


def test_a_passage_of_very_many_documents_and_very_long_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage, other = (" ".join(word() for _ in range(60)) for _ in range(2))
    docs = [(d, f"{word()} {passage} {word()} {other[d % 40 :]}") for d in range(3000)]
    docs += [(4000, " ".join(word() for _ in range(150_000))), (4001, "x " + passage * 4000)]  # beyond the size of a part
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.remove_repeats(df).collect())
    assert got == brute(docs)
    snippets = r.prepared(df)[2].where("place is not null")
    most = max(sum(len(b) // 8 for b in x.all) for x in snippets.groupBy("place").agg({"ids": "collect_list"}).withColumnRenamed("collect_list(ids)", "all").collect())
    assert most < 30_000  # 4,001 repeats one passage in itself; 3,000 documents count once a home


def test_equal_runs_are_found_byte_by_byte():
    data = np.frombuffer(b"abcabdabcabcd", np.uint8)
    at, size = np.array([0, 3, 6, 9, 9]), np.array([3, 3, 3, 3, 4])
    value, ids = np.zeros(5, np.uint64), np.array([5, 4, 3, 2, 1])  # one hash for all: only equal bytes count
    got = r.least_of_equals(data, at, size, value, ids)
    assert got.tolist() == [5, 4, 3, 2, 1]
    same = r.run_hashes(data, at, size)
    assert same[0] == same[2] == same[3] != same[1] and same[4] not in same[:4]
    assert r.least_of_equals(data, at, size, same, ids).tolist() == [2, 4, 2, 2, 1]


def test_runs_cover_every_window_once():
    data = np.random.default_rng(2).integers(97, 100, 5000).astype(np.uint8)
    lengths = np.array([0, 49, 50, 51, 1000, 3850])
    owner, start, count, _ = r.runs_of(data, lengths)
    for k, n in enumerate(lengths):
        covered = sorted(s + j for o, s, c in zip(owner, start, count, strict=True) if o == k for j in range(c))
        assert covered == list(range(max(0, n - 49)))


def test_suffix_array_and_intervals():
    data = np.frombuffer(b"banana$banana#an\0a", np.uint8)
    at = np.arange(len(data))
    order, common = r.suffix_array(data, at, len(data) - at)
    text = data.tobytes()
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert common.tolist() == [0, *(lcp(text[a:], text[b:]) for a, b in zip(order[:-1], order[1:], strict=True))]
    got = set(r.common_prefix_intervals(common.tolist(), 2))
    want = set()
    for i in range(len(order)):
        for j in range(i + 1, len(order)):
            m = min(common[i + 1 : j + 1])
            if m >= 2 and (i == 0 or common[i] < m) and (j + 1 == len(order) or common[j + 1] < m):
                want.add((int(m), i, j))
    assert got == want


def test_groups_hold_all_occurrences(spark):
    shared = "the same passage of well over fifty bytes in three places; "
    docs = [(1, "a" + shared + "x"), (2, "b" + shared + "y"), (3, "c" + shared + "z"), (4, "nothing of the kind")]
    rows = r.repeat_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert rows and all(x.n_occurrences == 3 for x in rows)
    text = dict(docs)
    for g in {x.repeat_id for x in rows}:
        own = [x for x in rows if x.repeat_id == g]
        assert {x.doc_id for x in own} == {1, 2, 3} and len({text[x.doc_id][x.start : x.start + x.n_bytes] for x in own}) == 1


def lines_between_unlike_texts(n, seed=4):
    """Texts of two common lines, shorter than a run, each between unlike words, and now and then a longer repeat over a line's border."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    words = lambda k: " ".join(word() for _ in range(k))
    lines, around = [words(11), words(14)], [words(9) for _ in range(30)]
    side = lambda: rng.choice(around) if rng.random() < 0.2 else words(9)
    return [(d, f"{side()}\n{lines[0]}\n{side()}\n{lines[1]}\n{side()}") for d in range(n)]


def test_runs_of_crowded_minimisers_are_cut(spark):
    docs = lines_between_unlike_texts(1500)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    windows = lambda crowded: sum(sum(x["count"]) for x in r.prepared(df, crowded=crowded)[2].where("place is not null").collect())
    assert windows(100) < windows(1 << 40) / 2
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in r.remove_repeats(df, crowded=100).collect())
    assert got == brute(docs)


def test_few_unlike_sections_meet():
    texts = [t.encode() for _, t in lines_between_unlike_texts(1500)]
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    owner, start, count, value, reach = r.anchored_runs(data, lengths)
    at = (np.cumsum(lengths) - lengths)[owner] + start
    whole, cut = {}, {}
    for v, a, n in zip(value.tolist(), at.tolist(), count.tolist(), strict=True):
        whole.setdefault(v, set()).add(data[a : a + n + 49].tobytes())
    run, low, windows, core, size = (x.tolist() for x in r.sections(count, reach))
    for a, w, n, c, m in zip(at[run].tolist(), low, windows, core, size, strict=True):
        cut.setdefault(data[a + c : a + c + m].tobytes(), set()).add(data[a + w : a + w + n + 49].tobytes())
    assert max(map(len, whole.values())) > 1000 and max(map(len, cut.values())) < 200


def test_sections_depend_on_their_windows_alone():
    texts = [t.encode() for _, t in lines_between_unlike_texts(200)]
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    owner, start, count, _, reach = r.anchored_runs(data, lengths)
    at = (np.cumsum(lengths) - lengths)[owner] + start
    seen, total = {}, 0
    for i, w, n, c, m in zip(*(x.tolist() for x in r.sections(count, reach)), strict=True):
        same = data[at[i] + c : at[i] + c + m].tobytes()
        total += n
        for x in range(w, w + n):
            window = data[at[i] + x : at[i] + x + 50].tobytes()
            assert same in window and seen.setdefault(window, (same, c - x)) == (same, c - x)
    assert total == int(count.sum()) > len(seen) > 1000


def place_of(texts):
    """Bytes, starts, windows and ids of the runs of all texts."""
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    owner, start, count, _ = r.runs_of(data, lengths)
    at = (np.cumsum(lengths) - lengths)[owner] + start
    joined = np.frombuffer(b"".join(data[a : a + n + 49].tobytes() for a, n in zip(at.tolist(), count.tolist(), strict=True)), np.uint8)
    return joined, np.cumsum(count + 49) - count - 49, count, owner.astype(np.int64)


def test_batches_hold_equal_windows_together(monkeypatch):
    monkeypatch.setattr(r, "SLICE", 3000)
    data, begin, count, _ = place_of([t.encode() for _, t in lines_between_unlike_texts(150)])
    windows, place, seen = 0, {}, set()
    for k, (runs, joined, starts, n, low, high) in enumerate(r.batches(data, begin, count, most=400)):
        taken = int((high - low).sum())
        windows += taken
        assert n.tolist() == count[runs].tolist() and taken <= 400
        for i, s, a, b in zip(runs.tolist(), starts.tolist(), low.tolist(), high.tolist(), strict=True):
            for x in range(a, b):
                window = joined[s + x : s + x + 50].tobytes()
                assert window == data[begin[i] + x : begin[i] + x + 50].tobytes() and place.setdefault(window, k) == k
                seen.add((i, x))
    assert windows == len(seen) == int(count.sum()) and k > 10


def test_a_place_works_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(9)
    line = rng.integers(97, 105, 40).astype(np.uint8)
    runs = rng.integers(97, 123, (60_000, 84)).astype(np.uint8)  # one minimiser: a line between unlike bytes
    runs[:, 20:60] = line
    least = r.mix64(r.gram_hashes(runs[0], 16)) & ~r.POSITION
    reach = 20 + int(np.argmin(least[20:45]))
    runs[:, : reach - 33] = 0
    data, count = runs.ravel(), np.full(len(runs), 35)
    begin, ids = np.arange(len(runs)) * 84, np.arange(len(runs))
    sizes = []
    tracemalloc.start()
    try:
        for _, *batch, low, high in r.batches(data, begin, count):
            sizes.append(int((high - low).sum()))
            r.candidate_windows(*batch, ids, low, high)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(sizes) == int(count.sum()) and max(sizes) <= r.BATCH
    assert peak < 90e6, peak
