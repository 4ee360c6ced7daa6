"""Secret scans with inferred formats (operator 10).

Base patterns give labelled credentials. For each kind a prefix tree of a bounded
sample is generalised by merging states whose arrival and exit frequencies are
statistically compatible (Hoeffding bounds, as in the state-merging inference of
stochastic regular languages). The probabilistic automata score every candidate
token of every text; tokens that a format explains far better than the ordinary
words of the texts do become spans of kind ``format``. Base spans always stay.

Bounds: at most ``sample`` distinct labelled values, and ordinary tokens that two texts have, of
each kind (those of the least hash) are gathered for fitting; of longer ones the first ``max_length`` characters, without an end.

Defined cases: null text is an empty text; whole texts are scanned; the patterns'
letters fold case in ASCII only; offsets count code points, ends are exclusive;
repeated rows give repeated result rows; without any labelled value only base spans
are found; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, work_dir

#: The base patterns, in the order of their kinds.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Candidates and ordinary tokens: maximal runs over the letters of assigned values.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
TOKEN_LETTERS = 26 + 26 + 10 + 6

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns in ``text``, by start, then kind.

    Runs of 16 or 32 characters are asked for at once where a shorter greedy run could
    not match otherwise; assignments match first and are dropped after, as a short value
    still uses up its characters.
    """
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def label_value(text: str, span: Span) -> str:
    """The credential within a span: for assignments the value."""
    kind, start, end = span
    return ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]


def symbol(c: str) -> str:
    """The class of a character: digit, hex letter, other letter by case, or itself."""
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "A" <= c <= "F":
        return "A"
    return "g" if c.islower() else "G" if c.isupper() else c


#: How many characters share a symbol; the rest stand for themselves.
CLASS_SIZE = {"0": 10, "a": 6, "A": 6, "g": 20, "G": 20}


@dataclass
class Automaton:
    """next[state][symbol] = (state, log probability of a character); stop[state] = log probability."""

    next: list[dict[str, tuple[int, float]]]
    stop: list[float]
    floor: float
    shortest: int = 1

    def rate(self, token: str) -> float:
        """Mean log probability a character, the end counted as one."""
        state, total = 0, 0.0
        for c in token:
            step = self.next[state].get(symbol(c)) if state >= 0 else None
            if step is None:
                state, total = -1, total + self.floor
            else:
                state, total = step[0], total + step[1]
        return (total + (self.stop[state] if state >= 0 else self.floor)) / (len(token) + 1)


def infer(words: list[str], alpha: float = 0.05, max_length: int = 64) -> Automaton:
    """Merge compatible states of the words' prefix tree into a probabilistic automaton."""
    child: list[dict[str, int]] = [{}]
    seen, ends = [0], [0]
    count: list[Counter] = [Counter()]
    for w in words:
        at = 0
        seen[0] += 1
        for c in w[:max_length]:
            s = symbol(c)
            count[at][s] += 1
            if s not in child[at]:
                child[at][s] = len(child)
                child.append({})
                seen.append(0)
                ends.append(0)
                count.append(Counter())
            at = child[at][s]
            seen[at] += 1
        if len(w) > max_length:
            seen[at] -= 1  # it goes on, unseen: no end here
        else:
            ends[at] += 1
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > spread * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if differ(ends[x], seen[x], ends[y], seen[y]):
                return False
            for s in count[x].keys() | count[y].keys():
                if differ(count[x][s], seen[x], count[y][s], seen[y]):
                    return False
                if s in child[x] and s in child[y] and x != y:
                    todo.append((child[x][s], child[y][s]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to the automaton at ``a``."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            seen[x] += seen[y]
            ends[x] += ends[y]
            count[x].update(count[y])
            for s, below in child[y].items():
                if s in child[x]:
                    todo.append((child[x][s], below))
                else:
                    child[x][s] = below

    kept = [0]
    blue = deque((0, s) for s in sorted(child[0]))
    while blue:
        parent, s = blue.popleft()
        b = child[parent].get(s)
        if b is None or b in kept:
            continue
        into = next((r for r in kept if compatible(r, b)), None)
        if into is None:
            kept.append(b)
            blue.extend((b, t) for t in sorted(child[b]))
        else:
            child[parent][s] = into
            fold(into, b)
            blue = deque((r, t) for r in kept for t in sorted(child[r]) if child[r][t] not in kept)
    place = {r: k for k, r in enumerate(kept)}
    moves, stop = [], []
    for r in kept:
        kinds = len(count[r]) + 1
        total = seen[r] + 0.5 * kinds
        moves.append({s: (place[child[r][s]], math.log((n + 0.5) / total / CLASS_SIZE.get(s, 1))) for s, n in count[r].items()})
        stop.append(math.log((ends[r] + 0.5) / total))
    return Automaton(moves, stop, math.log(1e-4), min(map(len, words), default=1))


def uniform() -> Automaton:
    """The background where no ordinary token is known: all letters of a token, and its end, alike."""
    p = -math.log(TOKEN_LETTERS + 1)
    return Automaton([{symbol(c): (0, p) for c in map(chr, range(128)) if TOKEN.fullmatch(c)}], [p], math.log(1e-4))


def gather(docs: DataFrame, sample: int, max_length: int) -> dict[str, list[str]]:
    """Bounded samples of labelled values by kind, and of ordinary tokens under ``plain``.

    Each task hands on the values of least hash it has met, at most ``sample`` a kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        import xxhash

        best: dict[str, dict[str, list[int]]] = {}

        def offer(kind: str, value: str) -> None:
            mine = best.setdefault(kind, {})
            if value in mine:
                mine[value][1] += 1
                return
            mine[value] = [xxhash.xxh3_64_intdigest(value.encode("utf-8", "replace")) >> 1, 1]
            if len(mine) > 4 * sample:
                best[kind] = dict(heapq.nsmallest(sample, mine.items(), key=lambda x: (x[1][0], x[0])))

        for b in batches:
            for text in b.column(0):
                t = text.as_py() or ""
                spans = base_spans(t)
                for s in spans:
                    offer(s[0], label_value(t, s)[: max_length + 1])
                # ordinary tokens, of all texts: the least hashes of distinct ones
                if spans:
                    ordinary = {m.group().strip(".") for m in TOKEN.finditer(t) if not any(m.start() < e and s < m.end() for _, s, e in spans)}
                else:
                    ordinary = {x.strip(".") for x in TOKEN.findall(t)}
                for x in ordinary:
                    if len(x) >= 6:
                        offer("plain", x[: max_length + 1])
        rows = [(k, v, *h) for k, mine in best.items() for v, h in heapq.nsmallest(sample, mine.items(), key=lambda x: (x[1][0], x[0]))]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["kind", "value", "h", "n"])

    # each task's least hashes; those of all are found by counts of their leading bits, so that no task gets a whole kind
    met = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, value string, h long, n long")
    met = stash(met, work_dir(docs.sparkSession, "labels")).groupBy("kind", "value", "h").agg(F.sum("n").alias("n"))
    # what occurs in one text only may be a credential that no label names: it says nothing of ordinary tokens
    met = met.where("kind <> 'plain' or n > 1")
    high = F.shiftright("h", 51)
    enough, so_far = {}, Counter()
    for r in sorted(met.groupBy("kind", high.alias("high")).count().collect(), key=lambda r: r["high"]):
        if so_far[r["kind"]] < sample:
            enough[r["kind"]] = r["high"]
        so_far[r["kind"]] += r["count"]
    if not enough:
        return {}
    low = met.where(high <= F.element_at(F.create_map(*[F.lit(x) for kv in enough.items() for x in kv]), F.col("kind"))).collect()
    out: dict[str, list[str]] = {}
    for r in sorted(low, key=lambda r: (r["kind"], r["h"], r["value"])):
        if len(mine := out.setdefault(r["kind"], [])) < sample:
            mine.append(r["value"])
    return out


def learn_formats(docs: DataFrame, sample: int = 1000, max_length: int = 64) -> dict[str, Automaton]:
    """An automaton for each labelled kind, and ``plain`` for ordinary tokens; empty without labels."""
    return {kind: infer(values, max_length=max_length) for kind, values in gather(docs, sample, max_length).items()}


def accepted(token: str, learned: list[Automaton], plain: Automaton, min_gain: float, min_rate: float) -> bool:
    """Whether a format of values no longer than ``token`` explains it, and far better than ordinary tokens are."""
    rate = max((a.rate(token) for a in learned if len(token) >= a.shortest), default=-math.inf)
    return rate >= min_rate and rate - plain.rate(token) >= min_gain


def found_spans(text: str, formats: dict[str, Automaton], min_gain: float, min_rate: float, known: dict[str, bool] | None = None) -> list[Span]:
    """Base spans and candidates that a learned format explains: by start, then kind.

    A candidate is a maximal token outside base spans, as long as the shortest labelled value at
    least, without dots around it; if it is none, the parts between its dots are. It gains ``min_gain`` nats a
    character over ordinary tokens at a mean of ``min_rate`` at least. ``known`` keeps verdicts for
    further texts with the same formats.
    """
    spans = base_spans(text)
    plain = formats.get("plain") or uniform()
    learned = [a for k, a in formats.items() if k != "plain"]
    if not learned:
        return spans
    shortest = min(a.shortest for a in learned)
    known = {} if known is None else known

    def fits(token: str) -> bool:
        if len(token) < shortest:
            return False
        if token not in known:
            if len(known) >= 100_000:
                known.clear()
            known[token] = accepted(token, learned, plain, min_gain, min_rate)
        return known[token]

    extra = []
    for m in TOKEN.finditer(text):
        if m.end() - m.start() < shortest:
            continue
        token = m.group()
        if any(m.start() < e and s < m.end() for _, s, e in spans):
            continue
        whole = token.strip(".")
        at = m.start() + len(token) - len(token.lstrip("."))
        if fits(whole):
            extra.append(("format", at, at + len(whole)))
        elif "." in whole:
            for part in whole.split("."):
                if fits(part):
                    extra.append(("format", at, at + len(part)))
                at += len(part) + 1
    return sorted(spans + extra, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if extra else spans


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, formats: dict[str, Automaton], min_gain: float = 1.0, min_rate: float = -4.5) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans) for every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            spans = [found_spans(t.as_py() or "", formats, min_gain, min_rate, known) for t in b.column(1)]
            n = [Counter(s[0] for s in x) for x in spans]
            base = [hashlib.sha256(joined([s for s in x if s[0] != "format"]).encode()).hexdigest() for x in spans]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([c[k] for c in n], pa.int64()) for k in KINDS), pa.array(base, pa.string()), pa.array([joined(x) for x in spans], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span, overlapping ones together, replaced by its first kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, formats: dict[str, Automaton], min_gain: float = 1.0, min_rate: float = -4.5) -> DataFrame:
    """``docs`` with secrets in ``text`` masked and ``n_chars``, where there is one, recounted; null texts stay null."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for b in batches:
            texts = [None if t is None else masked(t, found_spans(t, formats, min_gain, min_rate, known)) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
