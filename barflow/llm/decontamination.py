"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barflow.llm import text as T
from barflow.llm.session import checkpointed

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints up to this distance are found; the blocks number RADIUS // 2 + 1, so one of them differs by one bit at most.
RADIUS, BITS = 17, 64
BLOCKS = RADIUS // 2 + 1
#: Words of items that one pass over the documents carries; more items take more passes.
PASS_WORDS = 2_000_000
#: Words of a text that are searched at a time.
PIECE = 200_000
_CUTS = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
_SEPARATES = np.array([not (chr(c).isalnum() or c >= 128) for c in range(256)])


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words on end, and the index of each text's first (n + 1 values).

    Words here are runs of letters and digits (any byte from 0x80 on counts as one), A-Z lowered, so that punctuation
    and layout make no difference.
    """
    data, offsets = T.utf8(column)
    data = np.where(_SEPARATES[data], np.uint8(32), T.lower(data))
    starts, ends, first = T.words(data, offsets)
    return T.word_hashes(data, starts, ends), first


def shingled(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position, as far as there are so many."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = T.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : size + i])
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _blocks(fps: np.ndarray, k: int) -> np.ndarray:
    return (fps >> np.uint64(_CUTS[k])) & np.uint64((1 << (_CUTS[k + 1] - _CUTS[k])) - 1)


@dataclass
class Items:
    """The benchmark items of one pass: their shingles, and a multi-index of their fingerprints by length."""

    ids: pa.Array
    lengths: np.ndarray
    shingles: list[Counter]
    fps: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array) -> Items:
        words, first = word_hashes(texts)
        keep = np.flatnonzero(np.diff(first))
        lists = [shingled(words[first[i] : first[i + 1]], min(SHINGLE, first[i + 1] - first[i])) for i in keep]
        fps = np.array([int(np.packbits(2 * _bits(x).sum(axis=0) > len(x), bitorder="little").view(np.uint64)[0]) for x in lists], np.uint64)
        return cls(ids.take(pa.array(keep)), np.diff(first)[keep], [Counter(x.tolist()) for x in lists], fps)

    def __post_init__(self) -> None:
        keys = [self._key(self.lengths, k, _blocks(self.fps, k)) for k in range(BLOCKS)]
        keys, item = np.concatenate(keys), np.tile(np.arange(len(self.fps)), BLOCKS)
        order = np.argsort(keys, kind="stable")
        self.keys, self.item = keys[order], item[order]
        self.words = {}  # by shingle width: sorted shingles, and the lengths of the items that have each
        self.sizes: dict[int, dict[int, np.ndarray]] = {}
        for width in sorted(set(np.minimum(self.lengths, SHINGLE).tolist())):
            by_length = {}
            for length in sorted(set(self.lengths[np.minimum(self.lengths, SHINGLE) == width].tolist())):
                own = [list(self.shingles[i]) for i in np.flatnonzero(self.lengths == length)]
                by_length[length] = np.unique(np.array([x for y in own for x in y], np.uint64))
            self.sizes[width] = by_length
            every = np.unique(np.concatenate(list(by_length.values())))
            table = np.zeros(1 << 20, bool)
            table[every >> np.uint64(44)] = True
            self.words[width] = (every, table)

    @staticmethod
    def _key(length: np.ndarray | int, k: int, value: np.ndarray) -> np.ndarray:
        return np.asarray(length, np.uint64) << np.uint64(32) | np.uint64(k << 24) | value

    def within(self, length: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) of items of this length at ``RADIUS`` or fewer differing bits."""
        found = []
        for k in range(BLOCKS):
            value = _blocks(fps, k)
            for flip in [0, *(1 << b for b in range(_CUTS[k + 1] - _CUTS[k]))]:
                probe = self._key(length, k, value ^ np.uint64(flip))
                low, high = np.searchsorted(self.keys, probe, "left"), np.searchsorted(self.keys, probe, "right")
                for _ in range(int((high - low).max(initial=0))):
                    at = np.flatnonzero(low < high)
                    found.append(np.stack([at, self.item[low[at]]]))
                    low = low + 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        window, item = np.unique(np.concatenate(found, axis=1), axis=1)
        near = np.bitwise_count(fps[window] ^ self.fps[item]) <= RADIUS
        return window[near], item[near]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Jaccard similarity of two multisets: shared occurrences over all."""
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / max(a.total() + b.total() - shared, 1)


def matches(column: pa.Array, items: Items) -> list[tuple[int, int, float, int, int]]:
    """(text, item, similarity, first word, words) of each text's best window for each item, at ``SIMILARITY`` or more.

    Texts of more than ``PIECE`` words are searched in pieces that overlap by the longest item, so that what is held has a bound.
    """
    words, first = word_hashes(column)
    counts = np.diff(first)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}

    def add(text: int, offset: int, found: dict[tuple[int, int], tuple[float, int, int]]) -> None:
        for (t, item), (similarity, start, n) in found.items():
            best[text + t, item] = max(best.get((text + t, item), (0.0, 0, 0)), (similarity, start - offset, n))

    overlap, begin = int(items.lengths.max(initial=0)), 0
    for t in [*np.flatnonzero(counts > PIECE).tolist(), len(counts)]:
        if t > begin:
            add(begin, 0, _search(words[first[begin] : first[t]], first[begin : t + 1] - first[begin], items))
        if t < len(counts):
            # pieces overlap by the longest item, so that every full window lies in one; what would only repeat the overlap is no piece,
            # so that a piece is as long as any item or is the whole text
            for at in range(0, max(int(counts[t]) - overlap, 1), PIECE):
                part = words[first[t] + at : min(first[t] + at + PIECE + overlap, first[t + 1])]
                add(t, at, _search(part, np.array([0, len(part)]), items))
        begin = t + 1
    return [(t, item, s, -start, n) for (t, item), (s, start, n) in sorted(best.items())]


def _search(words: np.ndarray, first: np.ndarray, items: Items) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(text, item): (similarity, minus the first word, words) of the best windows of texts that ``first`` bounds among ``words``.

    A window takes as many words as the item, or the whole of a shorter text. Windows are cut at every word from which
    one holds a shingle of an item of its length: any other window has no shingle in common with such an item.
    """
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    counts = np.diff(first)
    for width, (every, table) in items.words.items():
        hashes = shingled(words, width)
        hit = np.flatnonzero(table[hashes >> np.uint64(44)])
        hit = hit[every[np.minimum(np.searchsorted(every, hashes[hit]), len(every) - 1)] == hashes[hit]]
        owner = np.searchsorted(first, hit, "right") - 1
        inside = hit + width <= first[owner + 1]
        hit, owner = hit[inside], owner[inside]
        if not len(hit):
            continue
        texts = np.unique(owner)
        # prefix sums of bits over the texts that have a hit at all
        sizes = np.maximum(counts[texts] - width + 1, 0)
        base = np.cumsum(sizes) - sizes
        at = np.repeat(first[texts] - base, sizes) + np.arange(sizes.sum())
        sums = np.zeros((len(at) + 1, BITS), np.int32)
        np.cumsum(_bits(hashes[at]), axis=0, dtype=np.int32, out=sums[1:])
        place = dict(zip(texts.tolist(), zip(base.tolist(), sizes.tolist())))
        for length, own in items.sizes[width].items():
            mine = own[np.minimum(np.searchsorted(own, hashes[hit]), len(own) - 1)] == hashes[hit]
            if not mine.any():
                continue
            span = length - width + 1  # shingles of a window
            begin, end, text = [], [], []
            for t in np.unique(owner[mine]).tolist():
                b, n = place[t]
                here = hit[mine & (owner == t)] - first[t]
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, np.maximum(here - span + 1, 0), 1)
                np.add.at(cover, here + 1, -1)
                starts = np.flatnonzero(np.cumsum(cover)[:n] > 0)
                starts = np.unique(np.minimum(starts, max(n - span, 0)))
                begin.append(b + starts)
                end.append(b + np.minimum(starts + span, n))
                text.append(np.full(len(starts), t))
            begin, end, text = np.concatenate(begin), np.concatenate(end), np.concatenate(text)
            ones = sums[end] - sums[begin]
            fps = np.packbits(2 * ones > (end - begin)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
            for window, item in zip(*(x.tolist() for x in items.within(length, fps))):
                b, e, t = int(begin[window]), int(end[window]), int(text[window])
                similarity = weighted_similarity(Counter(hashes[at[b:e]].tolist()), items.shingles[item])
                found = (similarity, -int(at[b] - first[t]), e - b + width - 1)
                if similarity >= SIMILARITY and found > best.get((t, item), (0.0, 0, 0)):
                    best[t, item] = found
    return best


def passes(benchmark: DataFrame) -> tuple[int, Iterator[Items]]:
    """The items in blocks of about ``PASS_WORDS`` words, built one after the other, so that what the driver and a task carry has a bound;
    and the number of blocks."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-words // PASS_WORDS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))

    def built() -> Iterator[Items]:
        for k in range(n):
            found = rows.where(block == k).orderBy("item_id", "text").toArrow()
            one = lambda name: pa.concat_arrays(found.column(name).chunks) if found.num_rows else pa.array([], found.schema.field(name).type)
            items = Items.of(one("item_id"), one("text"))
            if len(items.ids):
                yield items

    return n, built()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): each document's best window for each item it holds.

    Similarity is that of the multisets of five-word shingles (fewer in shorter items), 0.8 or more. Null and empty texts
    and items match nothing; repeated items and rows are reported each; very long texts are searched whole; empty
    tables give no rows; other columns are not read.
    """
    rows, out = docs.select("doc_id", "text"), None
    kinds = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, start_word long, n_words long"

    def search(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in T.slices(batch, "text", T.SLICE // 2):
                    if found := matches(part.column("text"), items):
                        text, item, similarity, start, n = zip(*found)
                        ids = items.ids.take(pa.array(item))
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(text)), ids, pa.array(similarity), pa.array(start), pa.array(n)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        return run

    n, blocks = passes(benchmark)
    for items in blocks:
        found = rows.mapInArrow(search(items), schema)
        found = checkpointed(found) if n > 1 else found  # lets go of the block
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go alike; very
    long texts are searched whole; no other column is read or changed; without items or documents nothing goes."""

    def without(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in T.slices(batch, "text", T.SLICE // 2):
                    keep = np.ones(len(part), bool)
                    keep[[x[0] for x in matches(part.column("text"), items)]] = False
                    yield part.filter(pa.array(keep))

        return run

    n, blocks = passes(benchmark)
    for items in blocks:
        docs = docs.mapInArrow(without(items), docs.schema)
        docs = checkpointed(docs) if n > 1 else docs
    return docs


def op8_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_simhash_decontamination": op8_simhash_decontamination}
ORACLES: dict[str, str] = {}
