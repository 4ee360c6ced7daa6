"""op4: tables and ADPCM against sample-by-sample definitions, lossless storage."""

from __future__ import annotations

import hashlib
import math
import zlib
from pathlib import Path

import numpy as np

from kinframe.llm import telephony as t


def test_expansion_tables():
    # corner values of the two laws: silence, smallest and largest steps, signs
    assert t.MULAW[0xFF] == 0 and t.MULAW[0x7F] == 0 and t.MULAW[0x00] == -32124 and t.MULAW[0x80] == 32124 and t.MULAW[0xFE] == 8
    assert t.ALAW[0xD5] == 8 and t.ALAW[0x55] == -8 and t.ALAW[0xAA] == 32256 and t.ALAW[0x2A] == -32256
    assert len(set(t.ALAW.tolist())) == 256 and len(set(t.MULAW.tolist())) == 255


def one_block(block):
    now, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(t.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if nibble & bit else 0
            now = max(-32768, min(32767, now - move if nibble & 8 else now + move))
            index = max(0, min(88, index + int(t.INDEX_MOVES[nibble])))
            out.append(now)
    return out


def test_adpcm_equals_the_definition():
    data = np.random.default_rng(1).integers(0, 256, (50, 64), dtype=np.uint8)
    assert t.decode_adpcm(data).tolist() == [one_block(bytes(b)) for b in data]


def test_wave_files():
    for tag, bits, data in ((t.MULAW_TAG, 8, b"abc"), (t.PCM_TAG, 16, b"\1\2\3\4"), (t.ALAW_TAG, 8, b"")):
        assert t.read_wave(t.wave_file(tag, 8000, bits, data)) == (tag, 8000, bits, data)


def slow(pcm, up, down, zeros=16):
    """The windowed sinc summed up sample by sample."""
    narrow = min(1.0, up / down)
    reach = math.ceil(zeros / narrow)
    out = []
    for n in range(math.ceil(len(pcm) * up / down)):
        x = n * down / up
        total = weight = 0.0
        for k in range(math.floor(x) + 1 - reach, math.floor(x) + reach + 1):
            d = k - x
            if abs(d) < reach:
                h = (math.sin(math.pi * narrow * d) / (math.pi * narrow * d) if d else 1.0) * (0.5 + 0.5 * math.cos(math.pi * d / reach))
                weight += h
                total += h * (pcm[k] if 0 <= k < len(pcm) else 0)
        out.append(max(-32768, min(32767, total / weight)))
    return out


def test_resample_equals_a_slow_sinc():
    rng = np.random.default_rng(3)
    for up, down in ((2, 1), (1, 1), (3, 2), (1, 2), (11, 8), (2, 3)):
        for n in (0, 1, 2, 64, 401):
            pcm = rng.integers(-32768, 32768, n).astype(np.int16)
            got = t.resample(pcm, up, down)
            assert len(got) == math.ceil(n * up / down) and np.abs(got - np.array(slow(pcm.tolist(), up, down), dtype=float)).max(initial=0) <= 0.5001
    # a tone of 1 kHz keeps its level and frequency; one above the new edge is gone
    time = np.arange(4000) / 8000
    tone = np.rint(8000 * np.sin(2 * np.pi * 1000 * time)).astype(np.int16)
    want = 8000 * np.sin(2 * np.pi * 1000 * np.arange(8000) / 16000)
    assert np.abs(t.resample(tone, 2)[200:-200] - want[200:-200]).max() < 20
    high = np.rint(8000 * np.sin(2 * np.pi * 3500 * time)).astype(np.int16)
    assert np.abs(t.resample(high, 1, 2)[100:-100]).max() < 20
    assert (t.resample(np.full(300, 77, np.int16), 2)[40:-40] == 77).all()


def test_stored_and_read_back(spark):
    texts = [None, "", "a", "é" * 40, "x" * 64, "y" * 65, "long " * 60_000, "a"]
    df = spark.createDataFrame([(i, x, "e") for i, x in enumerate(texts)], "doc_id long, text string, feature string")
    got = {r.doc_id: r for r in t.features(t.encode_texts(df)).collect()}
    for i, x in enumerate(texts):
        raw = (x or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (got[i].n_bytes, got[i].payload_bytes) == (len(raw), len(padded))
        assert got[i].payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert got[i].tail_crc32 == zlib.crc32(padded[-64:])
        media = t.wave_file(t.MULAW_TAG, 8000, 8, padded)
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[0][2:] == got[1][2:] and got[2][2:] == got[7][2:]
    assert t.features(t.encode_texts(df.filter("false"))).count() == 0


def test_pcm_is_stored_at_another_rate(spark):
    text = "every sample, " * 40
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    raw = mulaw_of(text.encode() + bytes(-len(text) % 64))
    for options, rate, factor in (({}, 16_000, 2), ({"up": 1}, 8000, 1), ({"up": 3, "down": 2}, 12_000, 1.5)):
        rows = {r.doc_id: t.read_wave(r.pcm) for r in t.encode_texts(df, **options).collect()}
        tag, got_rate, bits, data = rows[1]
        got = np.frombuffer(data, "<i2")
        assert (tag, got_rate, bits) == (t.PCM_TAG, rate, 16) and len(got) == len(raw) * factor
        assert np.abs(got - np.array(slow(raw, options.get("up", 2), options.get("down", 1)))).max() <= 0.5001
        assert len(rows[2][3]) == 64 * 2 * factor


def test_any_samples_are_packed_without_loss():
    rng = np.random.default_rng(7)
    for step in (1, 2, 3):
        for n in (0, 1, 2, 3, 64, 401):
            pcm = rng.integers(-32768, 32768, n).astype(np.int16)
            assert t.unpack(*t.pack(pcm, step), n, step).tolist() == pcm.tolist()
            more = t.resample(pcm, step)
            base, rest = t.pack(more, step)
            assert len(base) == n and not len(rest) and t.unpack(base, rest, len(more), step).tolist() == more.tolist()


def test_taps_give_exact_sums():
    # multiples of 2 ** -34, and sums with 16-bit samples below 2 ** 53 of these: no machine rounds on the way
    for up, down in ((2, 1), (3, 2), (1, 2), (2, 3), (1, 8)):
        taps = t.phases(up, down)[0] * 2.0**34
        assert (taps == np.rint(taps)).all() and (np.abs(taps).sum(axis=1) * 32768 < 2.0**53).all()


def test_stored_pcm_is_whole_and_small(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = {r.doc_id: (r.n_bytes, r.media, r.pcm) for r in t.encode_texts(docs).collect()}
    stored = t.store(docs, str(tmp_path / "media"))
    assert {r.doc_id: (r.n_bytes, r.media, r.pcm) for r in t.files(stored).collect()} == plain
    assert sorted(map(tuple, t.features(stored).collect())) == sorted(map(tuple, t.features(t.encode_texts(docs)).collect()))
    size = lambda path: sum(p.stat().st_size for p in path.rglob("*.parquet"))
    assert size(tmp_path / "media") < 1.5 * Path("/root/testdata/sf0.01/documents.parquet").stat().st_size
    few = docs.limit(5)
    for k, options in enumerate(({"up": 3, "down": 2}, {"up": 1}, {"up": 3})):
        want = sorted(tuple(r) for r in t.encode_texts(few, **options).collect())
        assert sorted(tuple(r) for r in t.files(t.store(few, str(tmp_path / f"m{k}"), **options)).collect()) == want


def mulaw_of(raw):
    return t.MULAW[np.frombuffer(raw, np.uint8)].tolist()
