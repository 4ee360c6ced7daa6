"""op3: round trip, decisions against brute force, merging."""

from __future__ import annotations

import base64
import hashlib
import random

from kinframe.llm import queries, warc

SF = "/root/testdata/sf0.001"


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected(pages):
    first = {}
    for p, _, html in sorted(pages):
        first.setdefault((html or "").encode(), p)
    return {p: (len((h or "").encode()), digest((h or "").encode()), "response" if first[(h or "").encode()] == p else "revisit", None if first[(h or "").encode()] == p else first[(h or "").encode()]) for p, _, h in pages}


def index(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_all_pages(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert index(queries.op3_warc(spark, SF)) == expected(pages)


def test_odd_payloads_and_order(spark):
    odd = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(5, "http://a.com/", None), (3, "http://a.com:80/x", ""), (9, None, "é\r\n\r\n"), (1, "http://WWW.a.com/", odd), (2, "https://b.org/?q", odd), (7, "http://a.com/\r\nX: y", "z" * 200_000), (8, "nonsense", "é\r\n\r\n")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, refers_to int")
    out = warc.archive_and_index(df)
    assert index(out) == expected(pages)
    rows = sorted(out.collect(), key=lambda r: (r.part, r.seq))
    keys = [(r.url_key, r.capture_ts, r.page_id) for r in rows]
    assert keys == sorted(keys)
    assert warc.archive_and_index(df.filter("false")).count() == 0


def test_null_and_repeated_ids_and_any_number_of_ranges(spark):
    pages = [(None, "http://a.b/", "x"), (None, None, None), (1, "http://a.b/", "ab"), (1, "http://a.b/", "cd"), (4, "http://a.b/", "cd"), (4, "http://a.b/", "cd"), (None, "http://c.d/", "ab"), *((k, "http://hot.e/", "p" * (k % 5 + 3)) for k in range(10, 60))]
    df = spark.createDataFrame([(*p, "u", 1) for p in pages], "page_id long, url string, html string, url_key string, payload_digest int")
    warc.write_archives(df, folder := warc.work_dir(spark, "odd"), records_per_file=7)
    entries = warc.read_archives(spark, folder)
    least = {}
    for p, _, html in pages:
        if p is not None:
            least[html] = min(p, least.get(html, p))
    want = sorted((p or -1, len(h or ""), digest((h or "").encode()), least.get(h) if least.get(h) not in (None, p) else -1) for p, _, h in pages)
    histories = []
    for n in (1, 2, 9):
        rows = sorted(warc.capture_histories(entries, n).collect(), key=lambda r: (r.part, r.seq))
        assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.refers_to or -1) for r in rows) == want
        assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in rows)
        histories.append([(r.url_key, r.capture_ts, r.page_id, r.payload_digest, r.previous_page) for r in rows])
    assert [sorted(map(str, h)) for h in histories] == [sorted(map(str, histories[0]))] * 3
    assert [h[4] for h in histories[2] if h[0] == "e,hot)/"] == [None, *range(10, 59)]


def test_revisits_only_from_a_size_on(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = index(warc.archive_and_index(df, min_revisit=3))
    assert {p: v[2] for p, v in got.items()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((rng.randint(0, 9), i, j) for j in range(rng.randint(0, 12))) for i in range(k)]
        assert list(warc.loser_tree_merge(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?b=C#d") == "com,example)/a?b=c"
    assert warc.url_key("http://x.y:81") == "y,x:81)/"
    assert warc.url_key("-") == "-"


def test_record_ids_are_unique_and_referred_to(spark):
    import glob
    import gzip
    import io
    import uuid

    pages = [(None, "u", "x"), (None, "u", "x"), (None, "v", None), (1, "u", "ab"), (1, "w", "ab"), (1, "u", "ab"), (1, "u", "cd"), (2, "u", "ab"), (3, "u", "cd"), (4, "u", None), (5, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write_archives(df, folder := warc.work_dir(spark, "ids"))
    heads = []
    for name in glob.glob(f"{folder}/*.txt.gz"):
        with gzip.open(name) as f:
            heads += [head for _, head, _ in warc.parse(io.BytesIO(f.read()))]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(ids) == len(set(ids)) == len(pages)
    assert all(str(uuid.UUID(i[10:-1])) == i[10:-1] and uuid.UUID(i[10:-1]).version == 8 for i in ids)
    answers = {h["WARC-Record-ID"]: h["WARC-Payload-Digest"] for h in heads if h["WARC-Type"] == "response"}
    revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 4 and all(answers[h["WARC-Refers-To"]] == h["WARC-Payload-Digest"] for h in revisits)
