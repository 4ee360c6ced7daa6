"""Repeated passages by enhanced suffix arrays (operator 8).

All equal strings of ``least`` bytes meet in one place: the minimiser of a window of
that length (its least hashed 16-byte gram) depends on the window alone, so windows
are dealt by the hash of their minimiser. Consecutive windows of one minimiser are a
run. First only hashes travel, each once a home; runs whose hash occurs in one document
are dropped. Of the others the bytes travel, of equal runs of a home those of its least id
(the others are removable as they are), and each place builds the suffix array of its
windows with their common prefix lengths, scans it with a stack for the tree of
common-prefix intervals, and keeps intervals whose occurrences differ in what
precedes them: the maximal repeats there, with all occurrences. A repeat that goes on
beyond a run goes on in the place of the next run, so lengths add up over places.

A minimiser of very many runs (a line that most documents have, between unlike ones) would
crowd its place. Its runs are cut where the minimiser's position in the window passes a
bound, and each section is dealt by the bytes that all its windows have in common, its
core, of nearly a window. Again only hashes of cores travel first. A place takes its
windows in batches of whole minimisers, or of some positions of the minimiser: equal
windows agree in both.

An occurrence is removable where its repeat also occurs in a document of smaller id.
Texts equal to that of a smaller id are wholly removable and take no part.

Texts are kept in a bucketed table in the shared folder, so the joins that need
them move only positions. Every group handled at once is one of a number of parts
that grows with the shuffle partitions.

Defined cases: null text is empty; texts below ``least`` bytes have no repeats; null
ids neither cause nor suffer removal; rows of one id are one document to each other;
repeated rows give repeated result rows; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, work_dir
from .neardup import mix64

LEAST, GRAM = 50, 16
#: Windows handled in one numpy step; positions within it take 20 bits of the ordering key.
PIECE = 400_000
#: Windows that a place holds in numpy arrays at once, and bytes of runs hashed in one step.
BATCH, SLICE = 1 << 19, 1 << 20
#: Runs from which on a minimiser is crowded, and the positions of the minimiser in a window at which its runs are cut.
CROWDED = 200_000
CUTS = (*range(0, LEAST - GRAM, 3), LEAST - GRAM + 1)
POSITION = np.uint64(0xFFFFF)
BASE = 0x9E3779B97F4A7C15
TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes (modulo 2**64) of all k-byte strings, by doubling lengths."""
    power = lambda e: np.uint64(pow(BASE, e, 1 << 64))
    part, have, out, done = TABLE[data], 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            if k & have:
                if out is None:
                    out, done = part, have
                else:
                    n = len(data) - done - have + 1
                    out, done = out[:n] + power(done) * part[done : done + n], done + have
            if have * 2 > k:
                return out
            n = len(part) - have
            part, have = part[:n] + power(have) * part[have:], have * 2


def runs_of(data: np.ndarray, lengths: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """(text number, start within the text, windows, minimiser hash) of every run in joined texts.

    ``data`` holds the texts one after the other and must be shorter than 2**20 bytes.
    """
    return anchored_runs(data, lengths, least, gram)[:4]


def anchored_runs(data: np.ndarray, lengths: np.ndarray, least: int = LEAST, gram: int = GRAM):
    """What ``runs_of`` gives, and how far after the run's start its minimiser is."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(data) < least:
        return none
    hashes = mix64(gram_hashes(data, gram))
    low = (hashes & ~POSITION) | np.arange(len(hashes), dtype=np.uint64)
    wide, have = least - gram + 1, 1
    while have * 2 <= wide:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    if have < wide:
        low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
    n = len(low)
    anchor = (low & POSITION).astype(np.int64)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)[:n]
    inside = ends[owner] - np.arange(n) >= least
    new = np.ones(n, dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, n))
    at, count = at[inside[at]], count[inside[at]]
    return owner[at], at - (ends - lengths)[owner[at]], count, hashes[anchor[at]], anchor[at] - at


def pieces(texts: Iterable[bytes]) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Texts in groups below the piece size: (numbers, offsets, joined bytes, lengths); long ones in overlapping parts."""
    numbers, offsets, parts, size = [], [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LEAST + 1), PIECE):
            part = t[at : at + PIECE + LEAST - 1]
            if parts and size + len(part) > PIECE + LEAST:
                yield numbers, offsets, b"".join(parts), np.array([len(p) for p in parts])
                numbers, offsets, parts, size = [], [], [], 0
            numbers.append(k)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield numbers, offsets, b"".join(parts), np.array([len(p) for p in parts])


def released(function):
    """``function``, after which freed memory goes back to the system: a Python worker would keep it, also while it waits for others' work."""

    def call(*tables: pa.Table) -> pa.Table:
        out = function(*tables)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)
        return out

    if function.__code__.co_argcount == 1:
        return lambda table: call(table)
    return lambda left, right: call(left, right)


def packed(array: np.ndarray, kind: str) -> bytes:
    return array.astype(kind).tobytes()


#: What homes tell places: values they have; twice their runs, and 1 more if several documents of theirs have them.
HASH_ROWS = "home int, place int, hash binary, runs binary"
#: What places tell homes: values that are shared, by kind. Where place is null: the home's copies.
SHARED_ROWS = "home int, place int, kind int, hash binary, marks binary"
MINIMISER, CROWD, CORE = 0, 1, 2
#: Snippets for a place, or (place null) what a home can cut by itself.
SNIPPET_ROWS = "place int, ids binary, marks binary, start binary, count binary, bytes binary, home int, stop binary"
CUT_ROWS = "home int, marks binary, start binary, stop binary"


def home_runs(left: pa.Table, copied: set[int]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of the texts of a home but copies and those without an id, by parts: (text number, start, windows, minimiser hash, the part's bytes, where in it, how far after that the minimiser)."""
    if not left.num_rows:
        return
    marks, known = left.column("mark").to_pylist(), left.column("doc_id").is_valid().to_pylist()
    texts = left.column("text").combine_chunks()
    own = np.array([i for i, m in enumerate(marks) if m not in copied and known[i]], dtype=np.int64)
    for numbers, offsets, joined, lengths in pieces(texts[i].as_buffer().to_pybytes() for i in own.tolist()):
        data = np.frombuffer(joined, np.uint8)
        owner, start, count, value, reach = anchored_runs(data, lengths)
        at = (np.cumsum(lengths) - lengths)[owner] + start
        yield own[np.array(numbers)[owner]], start + np.array(offsets)[owner], count, value, data, at, reach


@lru_cache(maxsize=2)
def powers(base: int) -> np.ndarray:
    """Powers (modulo 2**64) for all positions of a part."""
    out = np.full(PIECE + LEAST + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def run_hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes (modulo 2**64) of the strings of ``size`` bytes that start at ``at``: from sums over prefixes, in powers of the inverse base."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(TABLE[data] * powers(pow(BASE, -1, 1 << 64))[: len(data)], dtype=np.uint64)])
        return mix64((sums[at + size] - sums[at]) * powers(BASE)[at] + size.astype(np.uint64))


def places_of(value: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of a minimiser's hash, and 32 further bits of it."""
    return (value % np.uint64(places)).astype(np.int64), (value >> np.uint64(32)).astype(np.uint32)


def sections(count: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs cut at CUTS, as sections: (run, first window, windows, start and bytes of the core), starts within the run.

    A window's section and core depend on the window alone.
    """
    out = []
    for least, over in zip(CUTS, CUTS[1:], strict=False):
        low, high = np.maximum(0, reach - over + 1), np.minimum(count, reach - least + 1)
        run = np.flatnonzero(low < high)
        out.append((run, low[run], (high - low)[run], (reach - least)[run], np.full(len(run), LEAST - (over - 1 - least))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def told(rows: pa.Table, kind: int) -> np.ndarray:
    """The values of a kind that places told a home, as sorted pairs of place and hash."""
    held = [np.frombuffer(h, "<u4").astype(np.uint64) | np.uint64(p << 32) for p, k, h in zip(*(rows.column(x).to_pylist() for x in ("place", "kind", "hash")), strict=True) if k == kind]
    return np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)


def among(value: np.ndarray, places: int, keys: np.ndarray) -> np.ndarray:
    """Whether ``keys``, as of ``told``, have the values."""
    if not len(keys):
        return np.zeros(len(value), bool)
    place, hash_ = places_of(value, places)
    key = hash_.astype(np.uint64) | (place.astype(np.uint64) << np.uint64(32))
    return keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key


def copied(rows: pa.Table) -> set[int]:
    """The marks of the copies in SHARED_ROWS of a home."""
    return {m for p, x in zip(rows.column("place").to_pylist(), rows.column("marks").to_pylist(), strict=True) if p is None for m in np.frombuffer(x, "<i8").tolist()}


def hash_runs(texts: DataFrame, known: DataFrame, places: int, kind: int) -> DataFrame:
    """HASH_ROWS of a home: each minimiser, or each core of runs of crowded ones, once, however often it occurs there; copies have none.

    ``known``: SHARED_ROWS of the copies and of crowded minimisers.
    """

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        home = (left if left.num_rows else right).column("home")[0].as_py()
        crowd, held, rows = told(right, CROWD), [], []
        for number, _, count, value, data, at, reach in home_runs(left, copied(right)) if kind == MINIMISER or len(crowd) else ():
            if kind == MINIMISER:
                held.append((number.astype(np.int32), value))
                continue
            cut = np.flatnonzero(among(value, places, crowd))
            if len(cut):
                run, _, _, core, size = sections(count[cut], reach[cut])
                held.append((number[cut[run]].astype(np.int32), run_hashes(data, at[cut[run]] + core, size)))
        if held:
            number, value = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((number, value))
            number, value = number[order], value[order]
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            several = np.minimum.reduceat(number, first) < np.maximum.reduceat(number, first)
            runs = 2 * np.minimum(np.diff(np.append(first, len(value))), (1 << 15) - 1) + several
            place, hash_ = places_of(value[first], places)
            for part in split_by(place, np.argsort(place, kind="stable")):
                rows.append((home, int(place[part[0]]), packed(hash_[part], "<u4"), packed(runs[part], "<u2")))
        return binary_rows(rows, ("home", "place"), ("hash", "runs"))

    return texts.groupBy("home").cogroup(known.groupBy("home")).applyInArrow(released(together), HASH_ROWS)


def split_by(key: np.ndarray, order: np.ndarray) -> list[np.ndarray]:
    """``order``, which sorts by ``key``, cut where the key changes."""
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(order) else []


def binary_rows(rows: list[tuple], numbers: tuple[str, ...], blobs: tuple[str, ...]) -> pa.Table:
    """An Arrow table of int columns followed by binary ones."""
    c = list(zip(*rows, strict=True)) if rows else [()] * (len(numbers) + len(blobs))
    return pa.table({n: pa.array(x, pa.int32() if k < len(numbers) else pa.binary()) for k, (n, x) in enumerate(zip((*numbers, *blobs), c, strict=True))})


def joined_columns(table: pa.Table, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=k) for c, k in kinds.items()}


def shared_values(rows: DataFrame, kind: int, crowded: int) -> DataFrame:
    """SHARED_ROWS of the values that two documents or more have, for each home that has them; those of ``crowded`` runs or more are of kind CROWD."""

    def reduce(table: pa.Table) -> pa.Table:
        place, homes = table.column("place")[0].as_py(), table.column("home").to_numpy()
        got = joined_columns(table, {"hash": "<u4", "runs": "<u2"})
        home = np.repeat(homes, [len(x) // 4 for x in table.column("hash").to_pylist()])
        order = np.argsort(got["hash"], kind="stable")
        value, runs = got["hash"][order], got["runs"][order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        size = np.diff(np.append(first, len(value)))
        shared = (size > 1) | (np.maximum.reduceat(runs & np.uint16(1), first) > 0)
        many = np.add.reduceat((runs >> np.uint16(1)).astype(np.int64), first) >= crowded
        out = []
        for k, what in ((kind, shared & ~many), (CROWD, shared & many)):
            keep = order[np.repeat(what, size)]
            out += [(int(home[part[0]]), place, k, packed(got["hash"][part], "<u4"), b"") for part in (keep[x] for x in split_by(home[keep], np.argsort(home[keep], kind="stable")))]
        return binary_rows(out, ("home", "place", "kind"), ("hash", "marks"))

    return rows.groupBy("place").applyInArrow(released(reduce), SHARED_ROWS)


def least_of_equals(joined: np.ndarray, at: np.ndarray, size: np.ndarray, value: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each string (``size`` bytes at ``at``) the least id of those that equal it, byte by byte, among those of its hash ``value``."""
    order = np.lexsort((ids, value))
    new = np.append(True, value[order][1:] != value[order][:-1]) if len(order) else np.zeros(0, bool)
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    wide = int(size.max()) if len(size) else 1
    grid = np.lib.stride_tricks.sliding_window_view(np.concatenate([joined, np.zeros(wide, np.uint8)]), wide)
    out = ids.copy()
    for s in range(0, len(order), 50_000):
        a, b = order[s : s + 50_000], lead[s : s + 50_000]
        unlike = (grid[at[a]] != grid[at[b]]) & (np.arange(wide)[None, :] < size[a][:, None])
        equal = (size[a] == size[b]) & ~unlike.any(axis=1)
        out[a[equal]] = ids[b[equal]]
    return out


def fetch(texts: DataFrame, shared: DataFrame, places: int, combine: bool) -> DataFrame:
    """SNIPPET_ROWS: the bytes of the runs whose minimiser is shared; where it is crowded, of the sections whose core is.

    ``combine``: of equal runs of a home only those of the least id go to their place; the others are cut here. So a
    passage that very many documents have meets in its place as often as there are homes, not documents.
    """

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, held = [], []
        wanted, crowd, cores = (told(right, kind) for kind in (MINIMISER, CROWD, CORE))

        if left.num_rows and len(wanted) + len(cores):
            home = left.column("home")[0].as_py()
            for number, start, count, value, data, at, reach in home_runs(left, copied(right)):
                run = np.flatnonzero(among(value, places, wanted))
                low, windows, dealt = np.zeros_like(run), count[run], value[run]
                cut = np.flatnonzero(among(value, places, crowd))
                if len(cut):
                    part, first, some, core, size = sections(count[cut], reach[cut])
                    hashes = run_hashes(data, at[cut[part]] + core, size)
                    hit = np.flatnonzero(among(hashes, places, cores))
                    run, low, windows, dealt = (np.concatenate(x) for x in ((run, cut[part[hit]]), (low, first[hit]), (windows, some[hit]), (dealt, hashes[hit])))
                content = run_hashes(data, at[run] + low, windows + LEAST - 1)
                held.append((number[run].astype(np.int32), (start[run] + low).astype(np.int32), windows.astype(np.uint8), content, places_of(dealt, places)[0].astype(np.int32)))
            number, start, count, content, place = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            start, count = start.astype(np.int64), count.astype(np.int64)
            marks, ids = left.column("mark").to_numpy(), left.column("doc_id").fill_null(0).to_numpy()
            text = left.column("text").combine_chunks()
            sizes = pc.binary_length(text).to_numpy().astype(np.int64)
            begin = np.cumsum(sizes) - sizes
            joined = np.concatenate([np.frombuffer(t.as_buffer(), np.uint8) for t in text if len(t.as_buffer())])
            at, size, by = begin[number] + start, count + LEAST - 1, ids[number]
            later = np.flatnonzero(by > least_of_equals(joined, at, size, content, by)) if combine else np.zeros(0, np.int64)
            if len(later):
                order = later[np.lexsort((start[later], marks[number[later]]))]
                rows.append((None, b"", packed(marks[number[order]], "<i8"), packed(start[order], "<i4"), b"", b"", home, packed((start + size)[order], "<i4")))
            sent = np.ones(len(number), bool)
            sent[later] = False
            go = np.flatnonzero(sent)
            for part in split_by(place, go[np.argsort(place[go], kind="stable")]):
                n = size[part]
                source = np.repeat(at[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((int(place[part[0]]), packed(by[part], "<i8"), packed(marks[number[part]], "<i8"), packed(start[part], "<i4"), packed(count[part], "u1"), joined[source].tobytes(), None, b""))
        c = list(zip(*rows, strict=True)) if rows else [()] * 8
        return pa.table({n.split()[0]: pa.array(x, pa.int32() if n.endswith("int") else pa.binary()) for n, x in zip(SNIPPET_ROWS.split(", "), c, strict=True)})

    return texts.groupBy("home").cogroup(shared.groupBy("home")).applyInArrow(released(together), SNIPPET_ROWS)


def sliced(begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches of runs, that lie one after the other, of about SLICE bytes."""
    first = 0
    while first < len(count):
        end = max(first + 1, int(np.searchsorted(begin, begin[first] + SLICE)))
        yield first, end
        first = end


def candidate_windows(data: np.ndarray, begin: np.ndarray, count: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of windows that may start a maximal repeat, of those from ``low`` to below ``high``.

    Windows are grouped by a 64-bit hash; a group stays if it spans two documents and its
    windows are not all preceded by one byte within their runs. Hashes that collide only keep more.
    """
    windows = high - low
    ends = np.cumsum(windows)
    run = np.repeat(np.arange(len(count), dtype=np.int32), windows)
    offset = (np.arange(len(run)) - np.repeat(ends - windows - low, windows)).astype(np.int32)
    at = begin[run] + offset
    value = np.empty(len(run), np.uint64)
    for a, b in sliced(begin, count):
        here = slice(ends[a] - windows[a], ends[b - 1])
        value[here] = gram_hashes(data[begin[a] : begin[b - 1] + count[b - 1] + LEAST - 1], LEAST)[at[here] - begin[a]]
    before = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int16), -1)
    order = np.argsort(value)
    value, by, left = value[order], ids[run[order]], before[order]
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    low, high = np.minimum.reduceat(left, first), np.maximum.reduceat(left, first)
    stay = (np.minimum.reduceat(by, first) < np.maximum.reduceat(by, first)) & ((low != high) | (low < 0))
    keep = order[np.repeat(stay, np.diff(np.append(first, len(value))))]
    return run[keep], offset[keep]


def suffix_array(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes that start at ``at`` with ``length`` bytes each, and common prefixes of neighbours.

    Suffixes are compared as big-endian words of eight bytes, padded with zeros; common[k] is that of
    the k-th and the one before, in real bytes; common[0] is 0.
    """
    words = (int(length.max()) + 7) // 8
    padded = np.concatenate([data, np.zeros(8 * words, np.uint8)])
    grid = np.lib.stride_tricks.sliding_window_view(padded, 8 * words)
    keys = np.empty((words, len(at)), dtype=np.uint64)
    for s in range(0, len(at), 50_000):
        part = grid[at[s : s + 50_000]].copy()
        part[np.arange(8 * words)[None, :] >= length[s : s + 50_000, None]] = 0
        keys[:, s : s + 50_000] = part.view(">u8").astype(np.uint64).T
    order = np.lexsort(keys[::-1])
    common = np.zeros(len(at), dtype=np.int64)
    for s in range(1, len(at), 50_000):
        a, b = at[order[s - 1 : s + 49_999]], at[order[s : s + 50_000]]
        a = a[: len(b)]
        unequal = grid[a] != grid[b]
        full = np.where(unequal.any(axis=1), unequal.argmax(axis=1), 8 * words)
        common[s : s + 50_000] = np.minimum(full, np.minimum(length[order[s - 1 : s - 1 + len(b)]], length[order[s : s + len(b)]]))
    return order, common


def common_prefix_intervals(common: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the intervals of suffixes sharing ``least`` bytes or more, inner ones first."""
    stack: list[tuple[int, int]] = []
    for k, c in enumerate([*common[1:], 0], start=1):
        first = k - 1
        while stack and stack[-1][0] > c:
            length, first = stack.pop()
            yield length, first, k - 1
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, first))


def maximal_repeats(data: np.ndarray, begin: np.ndarray, count: np.ndarray, ids: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None):
    """(run, offset) in suffix order, and the intervals (length, first, last) that are maximal repeats of two documents.

    They start in windows from ``low`` to below ``high``, else in any.
    """
    run, offset = candidate_windows(data, begin, count, ids, np.zeros_like(count) if low is None else low, count if high is None else high)
    if not len(run):
        return run, offset, []
    at = begin[run] + offset
    order, common = suffix_array(data, at, count[run] + LEAST - 1 - offset)
    run, offset, at = run[order], offset[order], at[order]
    before = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1)
    by, found = ids[run], []
    for length, first, last in common_prefix_intervals(common.tolist(), LEAST):
        left = before[first : last + 1]
        here = by[first : last + 1]
        if (left.min() < 0 or left.min() != left.max()) and here.min() != here.max():
            found.append((length, first, last))
    return run, offset, found


SNIPPETS = {"ids": "<i8", "marks": "<i8", "start": "<i4", "count": "u1", "bytes": "u1"}


def opened(table: pa.Table):
    got = joined_columns(table, SNIPPETS)
    count = got["count"].astype(np.int64)
    size = count + LEAST - 1
    return got["bytes"], np.cumsum(size) - size, count, got["ids"], got["marks"], got["start"].astype(np.int64)


def minimisers(data: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ordering key, how far after the run's start) of the minimiser of each run: the first least gram of what its windows have in common."""
    value, reach = np.empty(len(count), np.uint64), np.empty(len(count), np.int64)
    for a, b in sliced(begin, count):
        grams = LEAST - GRAM + 2 - count[a:b]
        ends = np.cumsum(grams)
        at = np.arange(ends[-1]) - np.repeat(ends - grams - count[a:b] + 1, grams)  # within the run
        key = mix64(gram_hashes(data[begin[a] : begin[b - 1] + count[b - 1] + LEAST - 1], GRAM))[np.repeat(begin[a:b] - begin[a], grams) + at]
        low = np.minimum.reduceat((key & ~POSITION) | at.astype(np.uint64), ends - grams)
        value[a:b], reach[a:b] = low & ~POSITION, (low & POSITION).astype(np.int64)
    return value, reach


def batches(data: np.ndarray, begin: np.ndarray, count: np.ndarray, most: int = 0) -> Iterator[tuple]:
    """(runs, their bytes, starts and windows, least and end of the windows to take), so that equal windows meet and ``most`` (else BATCH) windows or one position of one minimiser are taken."""
    most = most or BATCH
    value, reach = minimisers(data, begin, count)
    order = np.argsort(value, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(value[order]) > 0))
    ends = np.cumsum(count[order])
    upto = ends[np.append(first[1:], len(order)) - 1]  # windows to the end of each minimiser
    k = 0
    while k < len(first):
        before = int(upto[k - 1]) if k else 0
        end = max(k + 1, int(np.searchsorted(upto, before + most, side="right")))
        runs = order[first[k] : first[end] if end < len(first) else len(order)]
        size = count[runs] + LEAST - 1
        starts = np.cumsum(size) - size
        joined = np.empty(int(size.sum()), np.uint8)
        for a, b in sliced(starts, size):
            to = starts[a], starts[b - 1] + size[b - 1]
            joined[to[0] : to[1]] = data[np.repeat(begin[runs[a:b]] - starts[a:b], size[a:b]) + np.arange(*to)]
        windows, far = count[runs], reach[runs]
        if upto[end - 1] - before <= most:
            yield runs, joined, starts, windows, np.zeros_like(windows), windows
        else:
            taken = np.array([np.count_nonzero((far - p >= 0) & (far - p < windows)) for p in range(LEAST - GRAM + 1)])
            p = 0
            while p < len(taken):
                over = max(p + 1, int(np.searchsorted(np.cumsum(taken), taken[:p].sum() + most, side="right")))
                low = np.clip(far - over + 1, 0, windows)
                yield runs, joined, starts, windows, low, np.maximum(low, np.clip(far - p + 1, 0, windows))
                p = over
        k = end


def removable(snippets: DataFrame, homes: int) -> DataFrame:
    """CUT_ROWS: of every occurrence, the longest repeat that a smaller id has too; with what homes cut by themselves, which passes through.

    So snippets are exchanged once and stored nowhere else.
    """

    def reduce(table: pa.Table) -> pa.Table:
        at_home = table.column("home").is_valid()
        done = table.filter(at_home).select(["home", "marks", "start", "stop"])
        table = table.filter(pc.invert(at_home))
        if not table.num_rows:
            return done
        data, begin, count, ids, marks, start = opened(table)
        cuts = []
        for runs, *batch, least, end in batches(data, begin, count):
            run, offset, found = maximal_repeats(*batch, ids[runs], least, end)
            by, longest = ids[runs[run]], np.zeros(len(run), dtype=np.int64)
            for length, first, last in found:  # inner, longer ones come first
                here, mine = by[first : last + 1], longest[first : last + 1]
                mine[(here > here.min()) & (mine == 0)] = length
            hit = np.flatnonzero(longest)
            low = start[runs[run[hit]]] + offset[hit]
            cuts.append((marks[runs[run[hit]]], low.astype(np.int32), (low + longest[hit]).astype(np.int32)))
        marks, low, stop = (np.concatenate(x) for x in zip(*cuts, strict=True))
        home = marks % homes
        out = [(int(home[part[0]]), packed(marks[part], "<i8"), packed(low[part], "<i4"), packed(stop[part], "<i4")) for part in split_by(home, np.lexsort((low, marks, home)))]
        return pa.concat_tables([done, binary_rows(out, ("home",), ("marks", "start", "stop")).cast(done.schema)])

    return snippets.withColumn("place", F.coalesce("place", "home")).groupBy("place").applyInArrow(released(reduce), CUT_ROWS)


def prepared(docs: DataFrame, combine: bool = True, crowded: int = CROWDED) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The bucketed table of texts, the copies among them, the snippets of all shared runs, and the number of homes.

    Runs of minimisers with ``crowded`` runs or more are cut into sections: their texts are read once more for the cores. Texts are exchanged once, for the table; rows of packed arrays number homes times places.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    homes, places = n, 2 * n
    same = F.md5("text")
    home = (F.col("mark") % homes).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    # a copy: a text whose digest some smaller id has; only digests and ids are exchanged for this
    for seed in range(16):
        # a mark stands for one id and text; where two pairs got one number, others are drawn
        mark = F.xxhash64(F.lit(seed), "doc_id", same).bitwiseAND((1 << 62) - 1)
        every = stash(rows.select("doc_id", same.alias("same"), mark.alias("mark")), work_dir(spark, "digests"))
        pair = F.struct("doc_id", "same")
        if not every.groupBy("mark").agg(F.min(pair).alias("low"), F.max(pair).alias("high")).where(~F.col("low").eqNullSafe(F.col("high"))).take(1):
            break
    else:
        raise RuntimeError("no draw of marks is free of collisions")
    digests = every.where("doc_id is not null")
    firsts = digests.groupBy("same").agg(F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id")).where("least_id < most_id")
    copies = stash(digests.join(firsts, "same").where("doc_id > least_id").select("mark").distinct().select(home.alias("home"), "mark"), work_dir(spark, "copies"))
    name = f"texts_{uuid.uuid4().hex}"
    table = rows.withColumn("mark", mark).select(home.alias("home"), "mark", "doc_id", "text")
    table.repartition(n, "home").write.option("compression", "zstd").option("path", work_dir(spark, "texts")).bucketBy(n, "home").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"drop table {name}")  # the files of a table with a path of its own stay
    nothing = F.lit(None).cast("int")
    known = copy_cuts(copies).select("home", nothing.alias("place"), nothing.alias("kind"), F.lit(b"").alias("hash"), "marks")
    shared = stash(shared_values(hash_runs(stored, known, places, MINIMISER), MINIMISER, crowded), work_dir(spark, "shared"))
    crowd = shared.where(F.col("kind") == CROWD)
    if crowd.take(1):
        cores = hash_runs(stored, known.union(crowd), places, CORE)
        shared = shared.union(shared_values(cores, CORE, 1 << 62))
    return stored, copies, fetch(stored, shared.union(known), places, combine), homes


def copy_cuts(copies: DataFrame) -> DataFrame:
    """CUT_ROWS that cover copies from end to end."""

    def pack(table: pa.Table) -> pa.Table:
        marks = np.sort(table.column("mark").to_numpy())
        return binary_rows([(table.column("home")[0].as_py(), packed(marks, "<i8"), packed(np.zeros(len(marks)), "<i4"), packed(np.full(len(marks), (1 << 31) - 1), "<i4"))], ("home",), ("marks", "start", "stop"))

    return copies.groupBy("home").applyInArrow(pack, CUT_ROWS)


def repeat_groups(docs: DataFrame) -> DataFrame:
    """Maximal repeats within runs (within their sections where a minimiser is crowded), one row an occurrence: (repeat_id, n_occurrences, n_bytes, doc_id, start)."""

    def reduce(table: pa.Table) -> pa.Table:
        data, begin, count, ids, _, start = opened(table)
        place, rows, k = table.column("place")[0].as_py(), [], 0
        for runs, *batch, least, end in batches(data, begin, count):
            run, offset, found = maximal_repeats(*batch, ids[runs], least, end)
            run = runs[run]
            for k, (length, first, last) in enumerate(found, start=k):
                rows += [((place << 40) | k, last - first + 1, length, int(ids[run[x]]), int(start[run[x]] + offset[x])) for x in range(first, last + 1)]
            k += bool(found)
        c = list(zip(*rows, strict=True)) if rows else [()] * 5
        return pa.table([pa.array(x, pa.int64()) for x in c], names=["repeat_id", "n_occurrences", "n_bytes", "doc_id", "start"])

    return prepared(docs, combine=False)[2].groupBy("place").applyInArrow(reduce, "repeat_id long, n_occurrences long, n_bytes long, doc_id long, start long")


def remove_repeats(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; kept: the remaining bytes. ``crowded``: see ``prepared``."""
    stored, copies, snippets, homes = prepared(docs, crowded=crowded)
    cuts = removable(snippets, homes).union(copy_cuts(copies))

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        got = joined_columns(right, {"marks": "<i8", "start": "<i4", "stop": "<i4"})
        order = np.lexsort((got["start"], got["marks"]))
        marks, low, high = (got[x][order] for x in ("marks", "start", "stop"))
        out = []
        for doc, mark, text in zip(left.column("doc_id").to_pylist(), left.column("mark").to_pylist(), left.column("text").to_pylist(), strict=True):
            a, b = np.searchsorted(marks, mark), np.searchsorted(marks, mark, side="right")
            spans = []
            if b > a and len(text) >= LEAST:
                s, e = low[a:b], np.minimum(np.maximum.accumulate(high[a:b]), len(text))
                first = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
                spans = list(zip(s[first].tolist(), e[np.append(first[1:], len(s)) - 1].tolist(), strict=True))
            kept, at = [], 0
            for s, e in spans:
                kept.append(text[at:s])
                at = e
            kept = b"".join([*kept, text[at:]])
            out.append((doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
        c = list(zip(*out, strict=True)) if out else [()] * 6
        return pa.table({**{k: pa.array(x, pa.int64()) for k, x in zip(("doc_id", "n_bytes", "n_removed", "n_spans"), c, strict=False)}, "kept_sha256": pa.array(c[4], pa.string()), "kept": pa.array(c[5], pa.binary())})

    return stored.groupBy("home").cogroup(cuts.groupBy("home")).applyInArrow(released(together), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
