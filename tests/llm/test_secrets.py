"""op10: base spans against plain patterns, inferred formats, masking."""

from __future__ import annotations

import hashlib
import random
import re

from kinframe.llm import queries, secrets

SF = "/root/testdata/sf0.001"


def brute(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], s, e) for s, k, e in sorted(out)]


ODD = ["token=token: abcdefghij", "API_KEY='x' apikey : \"abcdefgh\"", "AKIAAKIA1234567890", "AKIA12345", "é" * 5 + "password=éabcdefgh", "PaSsWd = 12345678", "f" * 31, "f" * 32 + "g" + "0" * 40, "secret  =  aaaaaaaaAAAA.=-/_+", "tokenſ=abcdefghi", "", "api__key=abcdefgh"]


def test_base_spans():
    rng = random.Random(2)
    alphabet = ["token", "=", ":", " ", '"', "abcdef0123456789", "AKIA", "ABCDEF12", "z", "pass", "word", "é"]
    for t in ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]:
        assert secrets.base_spans(t) == brute(t)


def test_whole_table(spark):
    docs = dict(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op10_secrets(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(secrets.joined(want).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in secrets.KINDS[:3]]
        assert set(secrets.joined(want).split(",")) <= set(r.spans.split(","))


def test_formats_separate_credentials_from_words():
    rng = random.Random(4)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    code, words = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", ["".join(rng.choice(["tha", "ent", "ion", "er"]) for _ in range(3)) for _ in range(400)]
    formats = {"assign": secrets.infer(["ghp_" + pick(code, 24) for _ in range(300)]), "plain": secrets.infer(words)}
    assert len(formats["assign"].next) < 30  # merged, not a tree of 300 words
    new = "ghp_" + pick(code, 24)
    assert secrets.found_spans(f"see {new} there", formats, 1.0, -4.5) == [("format", 4, 32)]
    assert secrets.found_spans("thaentionerthaentionerthaention2 " * 20, formats, 1.0, -4.5) == []
    assert secrets.found_spans(f"token={new}", formats, 1.0, -4.5) == [("assign", 0, 34)]


def test_merging_finds_a_loop():
    a = secrets.infer(["ag" * k for k in range(1, 20) for _ in range(int(400 * 0.7**k))])
    assert len(a.next) <= 4
    assert a.rate("agagagagag") > a.rate("aaggg")


def test_mask_and_defined_cases(spark):
    t = "x password=hunter2hunter2 y " + "ab12" * 8
    df = spark.createDataFrame([(1, t, 99), (2, None, None), (3, "", 0), (3, "", 0), (4, "plain words " * 30_000, 1)], "doc_id long, text string, n_chars int")
    got = secrets.redact(df, {}).collect()
    assert got[0].text == "x <assign> y <hex>" and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[1].n_chars is None and got[4].n_chars == 360_000
    found = secrets.scan(df, {}).collect()
    assert len(found) == 5 and found[1].spans == "" and found[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.learn_formats(df.filter("false")) == {} and secrets.scan(df.filter("false"), {}).count() == 0
    assert secrets.masked("abcdef", [("a", 0, 3), ("b", 1, 2), ("c", 2, 5)]) == "<a>f"


def test_short_dotted_and_plain_shaped_values_are_scored(spark):
    rng = random.Random(7)
    pick = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
    values = [f"{pick(6)}.{pick(6)}" for _ in range(300)]
    words = ["".join(rng.choice(["tha", "ent", "ion", "er"]) for _ in range(3)) for _ in range(400)]
    # no text has a length that is 3 modulo 8
    texts = [t + " " * ((8 - len(t)) % 8) for t in (f"{w} password={v} {w} {w}" for v, w in zip(values, words, strict=False))]
    formats = secrets.learn_formats(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert formats["plain"] and formats["assign"].shortest == 13
    bare = f"{pick(6)}.{pick(6)}"
    assert secrets.found_spans(f"see {bare}. thaenter", formats, 1.0, -4.5) == [("format", 4, 17)]
    assert secrets.found_spans("thaenter ionthaent thaentiontha.ent", formats, 1.0, -4.5) == []
    # without any ordinary token the background is uniform, and the method stays on
    assert secrets.found_spans(f"see {bare}", {"assign": formats["assign"]}, 0.5, -4.5) == [("format", 4, 17)]


def test_planted_credentials_precision_and_recall(spark):
    """Bare credentials of a labelled format among the words of real documents; spans equal a scoring of every token."""
    rng = random.Random(11)
    pick = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    digits, upper = "0123456789", "ABCDEFGHJKLMNPQRSTUVWXYZ"
    make = lambda: f"sk_{pick(digits + 'abcdef', 20)}{pick(upper, 4)}"
    texts = [r.text[:2000] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).collect() if r.text]
    docs, planted = [], {}
    for k, t in enumerate(texts):
        value = make()
        if k % 2:
            docs.append((k, f"{t} secret={value} end"))
        else:
            docs.append((k, f"{t} {value} end"))
            planted[k] = (len(t) + 1, len(t) + 1 + len(value))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    formats = secrets.learn_formats(df)
    got = {r.doc_id: r.spans for r in secrets.scan(df, formats).collect()}
    found = {(k, *map(int, s.split(":")[1:])) for k, spans in got.items() for s in spans.split(",") if s.startswith("format:")}
    hit = found & {(k, *s) for k, s in planted.items()}
    print("recall", len(hit) / len(planted), "precision", len(hit) / max(1, len(found)))
    assert len(hit) >= 0.9 * len(planted) and len(hit) >= 0.9 * len(found)
    learned, plain = [a for k, a in formats.items() if k != "plain"], formats["plain"]
    shortest = min(a.shortest for a in learned)
    for k, t in docs:
        spans = brute(t)
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]+", t):
            whole = m.group().strip(".")
            if any(m.start() < e and s < m.end() for _, s, e in spans) or len(whole) < shortest:
                continue
            at = t.index(whole, m.start())
            if secrets.accepted(whole, learned, plain, 1.0, -4.5):
                assert f"format:{at}:{at + len(whole)}" in got[k]
            elif "." not in whole:
                assert f"format:{at}:{at + len(whole)}" not in got[k]
