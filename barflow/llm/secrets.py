"""Secret scans: fixed patterns, and probabilistic automata inferred from labelled credentials by state merging (ALERGIA)."""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barflow.llm import text as T

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Labelled values, at most, of each class from which automata are inferred, and their length; the confidence parameter of a merge.
PER_CLASS, LONGEST_LEARNED, ALPHA = 2000, 256, 0.01
#: Shortest candidate; the log2 odds a character by which a credential format must beat ordinary text, and those of the whole run.
SHORTEST, ODDS, EVIDENCE = 10, 1.0, 24.0
#: Symbol classes: digits, a-f, g-z, A-F, G-Z, and each other character of a candidate by itself.
_SYMBOLS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", "=", "-")
_CLASS = np.full(256, 255, np.uint8)
for _i, _chars in enumerate(_SYMBOLS):
    _CLASS[[ord(_c) for _c in _chars]] = _i
_WITHIN = [math.log2(len(x)) for x in _SYMBOLS]
_HEX = (_CLASS <= 1).astype(bool)
_FLOOR = 1e-7


def runs(mask: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of true values of this length or more."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= shortest
    return starts[long], ends[long]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a line break after each, which no pattern crosses, and the offset of each text (n + 1 values)."""
    data, offsets = T.utf8(column)
    offsets = offsets + np.arange(len(offsets))
    out = np.full(len(data) + len(offsets) - 1, 10, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] - 1] = False
    out[keep] = data
    return out, offsets


def base_spans(data: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the value) in bytes of every match, leftmost and non-overlapping per kind."""
    raw, found = data.tobytes(), []
    # a match needs = or : and stays on its line: only such lines are searched
    breaks = np.concatenate([[-1], np.flatnonzero(data == 10), [len(data)]])
    signs = np.flatnonzero((data == 61) | (data == 58))
    for line in np.unique(np.searchsorted(breaks, signs)).tolist():
        for m in _ASSIGN.finditer(raw, int(breaks[line - 1]) + 1, int(breaks[line])):
            if m.end(1) - m.start(1) >= 6:
                found.append((m.start(), m.end(), 0, m.start(1)))
    found += [(m.start(), m.end(), 1, m.start()) for m in _ACCESS.finditer(raw) if m.end() - m.start() >= 20]
    found += [(a, b, 2, a) for a, b in zip(*(x.tolist() for x in runs(_HEX[data], 24)))]
    return sorted(found)


def candidates(data: np.ndarray, base: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of candidate characters, ``SHORTEST`` or longer, that touch no base span. Runs of small letters alone, but for the
    first, are words up to a length of 16 and no candidates."""
    starts, ends = runs(_CLASS[data] != 255, SHORTEST)
    if len(starts):
        kinds = _CLASS[data]
        marked = np.concatenate([[0], np.cumsum((kinds != 1) & (kinds != 2))])
        odd = marked[ends] - marked[starts + 1] > 0
        starts, ends = starts[odd | (ends - starts >= 16)], ends[odd | (ends - starts >= 16)]
    if base and len(starts):
        a, b = np.array([x[0] for x in base]), np.maximum.accumulate([x[1] for x in base])
        at = np.searchsorted(a, ends)  # base spans that begin before the run's end
        free = (at == 0) | (b[np.maximum(at - 1, 0)] <= starts)
        starts, ends = starts[free], ends[free]
    return list(zip(starts.tolist(), ends.tolist()))


@dataclass
class Automaton:
    """A deterministic automaton over symbol classes with counts: ``to[state][symbol]`` is (next state, times)."""

    to: list[dict[int, tuple[int, int]]] = field(default_factory=list)
    seen: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    @classmethod
    def infer(cls, values: list[bytes], alpha: float = ALPHA) -> Automaton:
        """ALERGIA: a prefix tree of the values, whose states are merged, in breadth-first order, wherever the frequencies of
        ending and of every symbol, there and below, are compatible by Hoeffding's bound at ``alpha``."""
        to, seen, ends = [{}], [0], [0]
        for value in values:
            state = 0
            seen[0] += 1
            for s in value:
                if s not in to[state]:
                    to[state][s] = len(to)
                    to.append({})
                    seen.append(0)
                    ends.append(0)
                state = to[state][s]
                seen[state] += 1
            ends[state] += 1
        times = {(p, s): seen[q] for p, edges in enumerate(to) for s, q in edges.items()}
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def far(x: int, n: int, y: int, m: int) -> bool:
            return n > 0 and m > 0 and abs(x / n - y / m) > bound * (n**-0.5 + m**-0.5)

        def compatible(p: int, q: int) -> bool:
            todo = [(p, q)]
            while todo:
                p, q = todo.pop()
                if far(ends[p], seen[p], ends[q], seen[q]):
                    return False
                for s in to[p].keys() | to[q].keys():
                    if far(times.get((p, s), 0), seen[p], times.get((q, s), 0), seen[q]):
                        return False
                    if s in to[p] and s in to[q]:
                        todo.append((to[p][s], to[q][s]))
            return True

        def fold(p: int, q: int) -> None:
            todo = [(p, q)]
            while todo:
                p, q = todo.pop()
                seen[p] += seen[q]
                ends[p] += ends[q]
                for s, target in to[q].items():
                    times[p, s] = times.get((p, s), 0) + times[q, s]
                    if s in to[p]:
                        todo.append((to[p][s], target))
                    else:
                        to[p][s] = target

        red, at = [0], 0
        while True:
            blue = [(p, s) for p in red for s, q in sorted(to[p].items()) if q not in red]
            if not blue:
                break
            p, s = max(blue, key=lambda e: times[e])
            q = to[p][s]
            for r in red:
                if compatible(r, q):
                    to[p][s] = r
                    fold(r, q)
                    break
            else:
                red.append(q)
            at += 1
        place = {q: i for i, q in enumerate(red)}
        return cls([{s: (place[t], times[q, s]) for s, t in to[q].items()} for q in red], [seen[q] for q in red], [ends[q] for q in red])

    def bits(self, symbols: bytes) -> float:
        """Minus log2 of the probability of a value of these symbol classes, its characters uniform within their classes."""
        state, out = 0, 0.0
        for s in symbols:
            p, following = _FLOOR, state
            if s in self.to[state]:
                following, times = self.to[state][s]
                p = max(p, times / self.seen[state])
            out += _WITHIN[s] - math.log2(p)
            state = following
        return out - math.log2(max(_FLOOR, self.ends[state] / self.seen[state]))


@dataclass
class Formats:
    """Automata of credential formats by name, and one of ordinary runs of candidate characters."""

    known: dict[str, Automaton] = field(default_factory=dict)
    plain: Automaton | None = None
    _memo: dict[bytes, tuple[str, float]] = field(default_factory=dict)

    def judged(self, symbols: bytes) -> tuple[str, float]:
        """The likeliest format, and the log2 odds a character by which it beats ordinary text."""
        if symbols not in self._memo:
            if len(self._memo) > 100_000:
                self._memo.clear()
            plain = self.plain.bits(symbols) if self.plain else math.inf
            bits, name = min(((a.bits(symbols), name) for name, a in self.known.items()), default=(math.inf, ""))
            self._memo[symbols] = name, (plain - bits) / len(symbols) if math.isfinite(plain) and math.isfinite(bits) else -math.inf
        return self._memo[symbols]


def learned(docs: DataFrame, per_class: int = PER_CLASS) -> Formats:
    """Automata from values that the patterns label, and, as ordinary text, from runs that they don't and that occur again elsewhere or
    are words: a credential that stands alone is neither, and must not teach what ordinary text is like.

    Of each class's distinct values the ``per_class`` of least hash are taken: a bounded sample that doesn't depend on the
    number of documents or partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, _ = buffer(part.column("text"))
                base = base_spans(data)
                values = [(KINDS[k], data[v:e]) for _, e, k, v in base] + [("plain", data[a:b]) for a, b in candidates(data, base)]
                usable = [(name, x) for name, x in values if len(x) <= LONGEST_LEARNED and (_CLASS[x] != 255).all()]
                pairs = sorted({(name, _CLASS[x].tobytes().hex(), x.tobytes().decode()) for name, x in usable})
                names, symbols, texts = zip(*pairs) if pairs else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (names, symbols, texts)], ["class", "symbols", "value"])

    found = docs.select("text").mapInArrow(run, "class string, symbols string, value string")
    hashed = found.groupBy("class", "symbols", F.xxhash64("value").alias("h"), "value").agg(F.count(F.lit(1)).alias("times"))
    word = F.col("symbols").rlike("^(03|04)?((01|02)+(07|09)?)+$")  # small letters, the first one may be a capital, joined by _ or -
    hashed = hashed.where((F.col("class") != "plain") | (F.col("times") > 1) | word)
    # a hash threshold keeps what reaches one task near the bound, however many values there are
    shares = hashed.groupBy("class").agg(F.least(F.lit(1.0), F.lit(2.0 * per_class) / F.count(F.lit(1))).alias("share"))
    chance = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    rows = hashed.join(F.broadcast(shares), "class").where(chance < F.col("share")).select("class", "symbols", "h").toArrow().sort_by("h")
    by_class: dict[str, list[bytes]] = defaultdict(list)
    for name, symbols in zip(rows.column("class").to_pylist(), rows.column("symbols").to_pylist()):
        if len(by_class[name]) < per_class:
            by_class[name].append(bytes.fromhex(symbols))
    known = {name: Automaton.infer(by_class[name]) for name in KINDS if len(by_class[name]) >= 20}
    return Formats(known, Automaton.infer(by_class["plain"]) if by_class["plain"] else None)


def scanned(docs: DataFrame, formats: Formats, odds: float = ODDS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format, n_likely) of every row of ``docs(doc_id, text)``.

    ``spans`` lists kind:start:end in code points, ends exclusive, by start and then kind; base spans always stay, and runs
    that a format's automaton explains better than ordinary text by ``odds`` bits a character, and ``EVIDENCE`` bits in all, come as
    ``format``. n_likely counts the base spans whose value does so too.
    Null and empty texts have no spans, and the hash of the empty string; texts are scanned whole; repeated rows give
    repeated rows; of formats that are equally likely the first by name counts; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offsets = buffer(part.column("text"))
                base = base_spans(data)
                every = [(a, b, k) for a, b, k, _ in base]
                likely = []
                for a, b in candidates(data, base):
                    bits = formats.judged(_CLASS[data[a:b]].tobytes())[1]
                    if bits >= odds and bits * (b - a) >= EVIDENCE:
                        every.append((a, b, 3))
                for a, b, _, v in base:  # what the patterns find stays, and is judged alike
                    if (_CLASS[data[v:b]] != 255).all() and formats.judged(_CLASS[data[v:b]].tobytes())[1] >= odds:
                        likely.append(a)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                n = len(part)
                counts, base_text, all_text = np.zeros((n, 4), np.int64), defaultdict(list), defaultdict(list)
                judged = np.bincount(np.searchsorted(offsets, np.array(likely, np.int64), "right") - 1, minlength=n).astype(np.int64)
                for a, b, k in sorted(every, key=lambda x: (x[0], x[2])):
                    i = int(np.searchsorted(offsets, a, "right")) - 1
                    start = points[offsets[i]]
                    line = f"{(*KINDS, 'format')[k]}:{points[a] - start}:{points[b] - start}"
                    counts[i, k] += 1
                    all_text[i].append(line)
                    if k < 3:
                        base_text[i].append(line)
                digests = [hashlib.sha256(",".join(base_text.get(i, ())).encode()).hexdigest() for i in range(n)]
                spans = [",".join(all_text.get(i, ())) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[:, 3]), pa.array(judged[:n])],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format", "n_likely"],
                )

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long, n_likely long")


def op6_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(docs, learned(docs))


QUERIES = {"op6_secret_automata": op6_secret_automata}
ORACLES: dict[str, str] = {}
