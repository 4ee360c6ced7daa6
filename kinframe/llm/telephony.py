"""Telephony audio in columns (operator 4).

Payload bytes are stored losslessly as 8-bit mu-law samples in a RIFF/WAVE file;
stored files are parsed again, expanded by mu-law and A-law lookup tables, decoded
as IMA ADPCM blocks (all blocks of a batch advance together, one numpy step per
nibble). Their 16-bit PCM is resampled from 8 to 16 kHz by polyphase filters and stored beside
them, without loss, as every ``up``-th sample and what the others differ from those that the
filters make of these; other rates are an option.

Defined cases: a null text is an empty payload; an empty one is padded to one block
of 64 zero bytes; texts of any length are handled whole; equal texts give equal
values; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

BLOCK = 64
#: Bytes of payload that are coded at once; a longer one is taken alone.
BATCH_BYTES = 1 << 20
RATE = 8000
#: Of the stored files, whose samples are small already: more effort saves a twentieth.
ZSTD_LEVEL = 6
#: Fixed values of the formats: WAVE format tags, and the IMA ADPCM index moves.
PCM_TAG, ALAW_TAG, MULAW_TAG = 1, 6, 7
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
#: Fixed values of IMA ADPCM: the 89 step sizes.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
        7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int32,
)


def mulaw_table() -> np.ndarray:
    """The 256 linear 16-bit values of mu-law codes."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 linear 16-bit values of A-law codes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    mantissa, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = np.where(segment == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def wave_file(tag: int, rate: int, bits: int, data: bytes) -> bytes:
    """A mono RIFF/WAVE file; lengths beyond 32 bits raise."""
    head = struct.pack("<HHIIHH", tag, 1, rate, rate * bits // 8, bits // 8, bits) + (b"" if tag == PCM_TAG else b"\0\0")
    chunks = b"fmt " + struct.pack("<I", len(head)) + head
    if tag != PCM_TAG:
        chunks += b"fact" + struct.pack("<II", 4, len(data) * 8 // bits)
    chunks += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def read_wave(blob: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, bits, data bytes) of a RIFF/WAVE file."""
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(blob):
        name, size = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if name == b"fmt ":
            fmt = struct.unpack_from("<HHIIHH", blob, at + 8)
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before fmt")
            return fmt[0], fmt[2], fmt[5], blob[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """IMA ADPCM: uint8 blocks, one a row, to int16 samples, one block a row.

    A block holds a 16-bit predictor, a step index (clipped to 0..88), a reserved
    byte and two samples in each further byte, low nibble first.
    """
    n, width = blocks.shape
    now = blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int8).astype(np.int32) << 8)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((1 + 2 * (width - 4), n), dtype=np.int16)
    out[0] = now
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(width - 4):
        for half in (0, 1):
            nibble = (columns[k] >> (4 * half)) & 15
            now = np.clip(now + MOVES[nibble, index], -32768, 32767)
            index = np.clip(index + INDEX_MOVES[nibble], 0, 88)
            out[1 + 2 * k + half] = now
    return out.T


def adpcm_moves() -> np.ndarray:
    """What a nibble adds at a step index: 16 x 89, by the format's shift and add rule."""
    nibble, step = np.arange(16)[:, None], STEPS[None, :]
    move = (step >> 3) + np.where(nibble & 1, step >> 2, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 4, step, 0)
    return np.where(nibble & 8, -move, move).astype(np.int32)


MOVES = adpcm_moves()


def phases(up: int, down: int, zeros: int = 16) -> tuple[np.ndarray, int]:
    """(taps, reach): for each of ``up`` phases the filter over 2 * reach input samples around a place between two of them.

    A sinc with its edge at the lower of both rates, ``zeros`` zero crossings long on each side and tapered by a Hann window;
    each phase adds up to one, so that a constant stays one. Taps are multiples of 2 ** -34: their sums with 16-bit samples
    are exact in doubles, so any machine and order of adding gives the same samples.
    """
    narrow = min(1.0, up / down)
    reach = int(np.ceil(zeros / narrow))
    at = np.arange(1 - reach, reach + 1)[None, :] - (np.arange(up) / up)[:, None]
    taps = np.sinc(narrow * at) * np.where(np.abs(at) < reach, 0.5 + 0.5 * np.cos(np.pi * at / reach), 0.0)
    return np.rint(taps / taps.sum(axis=1, keepdims=True) * 2.0**34) / 2.0**34, reach


def resample(pcm: np.ndarray, up: int, down: int = 1) -> np.ndarray:
    """int16 samples at ``up / down`` times the rate, by polyphase filters; silence lies beyond both ends.

    Sample n is the input at place n * down / up: the phase is the rest, and one filter over the whole input gives all samples of a phase.
    """
    count = -(-len(pcm) * up // down)
    if not count:
        return pcm
    taps, reach = phases(up, down)
    padded = np.concatenate([np.zeros(reach - 1), pcm, np.zeros(reach + 1)])
    place = np.arange(count) * down
    whole, phase = place // up, place % up
    out = np.empty(count)
    for p in range(up):
        mine = np.flatnonzero(phase == p)
        # a phase on the input's own places passes them on
        out[mine] = pcm[whole[mine]] if p == 0 and up >= down else np.convolve(padded, taps[p][::-1], "valid")[whole[mine]]
    return np.clip(np.rint(out), -32768, 32767).astype(np.int16)


def pack(pcm: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, rest) of any int16 samples: every ``step``-th one, and of the others the difference (modulo 2 ** 16) to those interpolated from the base; no rest if there is none."""
    base = pcm[::step]
    rest = (pcm - resample(base, step)[: len(pcm)])[np.arange(len(pcm)) % step != 0]
    return base, rest if rest.any() else rest[:0]


def unpack(base: np.ndarray, rest: np.ndarray, count: int, step: int) -> np.ndarray:
    """The ``count`` samples that ``pack`` took apart."""
    pcm = resample(base, step)[:count]
    if len(rest):
        pcm[np.arange(count) % step != 0] += rest
    return pcm


ENCODED = "doc_id long, n_bytes long, media binary, pcm binary"
PACKED = "doc_id long, n_bytes long, media binary, rate int, step int, samples long, base binary, rest binary"
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]


def encoding(batches: Iterator[pa.RecordBatch], up: int, down: int) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1, BATCH_BYTES, 256):
        lengths, media, pcm = [], [], []
        for t in batch.column(1):
            raw = b"" if not t.is_valid else t.as_buffer().to_pybytes()
            lengths.append(len(raw))
            raw += bytes(-len(raw) % BLOCK if raw else BLOCK)
            media.append(wave_file(MULAW_TAG, RATE, 8, raw))
            pcm.append(wave_file(PCM_TAG, RATE * up // down, 16, resample(MULAW[np.frombuffer(raw, np.uint8)], up, down).astype("<i2").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(media, pa.binary()), pa.array(pcm, pa.binary())], names=["doc_id", "n_bytes", "media", "pcm"])


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_texts(docs: DataFrame, up: int = 2, down: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media, pcm): the text's padded bytes as a mu-law file at 8 kHz, and its PCM as a file at ``up / down`` times that rate."""
    return texts_of(docs).mapInArrow(lambda batches: encoding(batches, up, down), ENCODED)


def packing(batches: Iterator[pa.RecordBatch], rate: int, step: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pcm = [np.frombuffer(read_wave(p.as_py())[3], "<i2") for p in batch.column(3)]
        packed = [pack(p, step) for p in pcm]
        fixed = [pa.array(np.full(len(pcm), x, np.int32)) for x in (rate, step)]
        columns = [pa.array([part[k].astype("<i2").tobytes() for part in packed], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *fixed, pa.array([len(p) for p in pcm], pa.int64()), *columns], names=PACKED_NAMES)


def unpacking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 2, BATCH_BYTES, 256):
        pcm = []
        for rate, step, count, base, rest in zip(*(batch.column(k).to_pylist() for k in range(3, 8)), strict=True):
            data = unpack(np.frombuffer(base, "<i2"), np.frombuffer(rest, "<i2"), count, step)
            pcm.append(wave_file(PCM_TAG, rate, 16, data.astype("<i2").tobytes()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(pcm, pa.binary())], names=["doc_id", "n_bytes", "media", "pcm"])


def store(docs: DataFrame, folder: str, up: int = 2, down: int = 1) -> DataFrame:
    """What ``encode_texts`` gives, packed, written to ``folder`` and read back; ``files`` gives it as files again.

    At a rate that is no multiple of 8 kHz all samples are the base.
    """
    run = lambda batches: packing(encoding(batches, up, down), RATE * up // down, up if down == 1 else 1)
    texts_of(docs).mapInArrow(run, PACKED).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", ZSTD_LEVEL).parquet(folder)
    return docs.sparkSession.read.schema(PACKED).parquet(folder)


def files(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, pcm) of what ``store`` wrote."""
    return stored.select(*PACKED_NAMES).mapInArrow(unpacking, ENCODED)


def features(stored: DataFrame) -> DataFrame:
    """Digests and sound features of stored files; from (doc_id, n_bytes, media, pcm), or from ``store``.

    feature: ``mu:<rms>;a:<rms>;adpcm:<mean>:<rms>;pcm:<samples>:<crc32>`` with root mean
    squares of the mu-law and A-law expansion and of the ADPCM decoding, and what the stored PCM holds.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    mu2, a2 = MULAW.astype(np.int64) ** 2, ALAW.astype(np.int64) ** 2

    def some(ids, lengths, media, pcm) -> pa.RecordBatch:
        payloads = [read_wave(m)[3] for m in media]
        joined = np.frombuffer(b"".join(payloads), np.uint8)
        sizes = np.array([len(p) for p in payloads], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        square = lambda table: np.sqrt(np.add.reduceat(table[joined], starts) / sizes)
        samples = decode_adpcm(joined.reshape(-1, BLOCK)).astype(np.int64)
        per = sizes // BLOCK
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        count = per * samples.shape[1]
        mean = np.add.reduceat(samples.sum(axis=1), first) / count
        rms = np.sqrt(np.add.reduceat((samples * samples).sum(axis=1), first) / count)
        feature = []
        for m, a, x, r, p in zip(square(mu2), square(a2), mean, rms, pcm, strict=True):
            data = read_wave(p)[3]
            feature.append(f"mu:{m:.3f};a:{a:.3f};adpcm:{x:.3f}:{r:.3f};pcm:{len(data) // 2}:{zlib.crc32(data):08x}")
        hexes = lambda blobs: pa.array([hashlib.sha256(b).hexdigest() for b in blobs], pa.string())
        return pa.RecordBatch.from_arrays(
            [ids, lengths, pa.array(sizes), hexes(payloads), pa.array([zlib.crc32(p[-BLOCK:]) for p in payloads], pa.int64()), pa.array([len(m) for m in media], pa.int64()), hexes(media), pa.array(feature, pa.string())],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, BATCH_BYTES, 256):
            yield some(batch.column(0), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist())

    if "pcm" in stored.columns:
        return stored.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, schema)
    # the files are four times the packed samples: they stay in the task that reads them
    return stored.select(*PACKED_NAMES).mapInArrow(lambda batches: run(unpacking(batches)), schema)
