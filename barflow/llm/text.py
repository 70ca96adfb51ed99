"""Arrow and numpy helpers that run inside Spark tasks: whole batches of text as one byte buffer.

A null text is an empty one. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in
UTF-8 equals the same rule on code points. Batches are cut into slices of about ``SLICE`` bytes, so the
memory of a task follows the slice (or one longer text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end, and the n + 1 offsets into them."""
    large = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    data = np.frombuffer(large.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(large) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(large) else np.zeros(1, np.int64)


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about ``size`` bytes of text; a longer text comes alone."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > size:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield batch.slice(at)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are white space."""
    return _SPACE[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of byte ranges of one buffer, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray):
        power = np.full(len(data) + 1, _BASE, np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(power[:-1] * (data.astype(np.uint64) + np.uint64(1)), out=self.sums[1:])
        power[1:] = _INVERSE
        power[0] = 1
        self.inverse = np.cumprod(power, out=power)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of every word. Equal words are found by their bytes first, so that each distinct one is hashed once."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    flat = data[~_SPACE[data]]
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    own = np.frombuffer(found.dictionary.buffers()[1], np.int64)[: len(found.dictionary) + 1].tolist()
    buffer, digest = memoryview(found.dictionary.buffers()[2] or b""), xxhash.xxh64_intdigest
    distinct = np.fromiter((digest(buffer[a:b]) for a, b in zip(own, own[1:])), np.uint64, len(found.dictionary))
    return distinct[found.indices.to_numpy()] if len(starts) else np.zeros(0, np.uint64)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words with one space between them, as one buffer, and the words' bounds in it."""
    if not len(starts):
        return np.zeros(0, np.uint8), starts, ends
    keep, data = ~_SPACE[data], data.copy()
    inner = np.ones(len(starts), bool)
    inner[first[:-1][first[:-1] < len(starts)]] = False
    keep[starts[inner] - 1] = True
    data[starts[inner] - 1] = 32
    place = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return data[keep], place[starts], place[ends]


def shingle_bounds(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every n-word shingle (a shorter text is one shingle), and each text's number of them."""
    count = np.diff(first)
    shingles = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
    last = np.minimum(at + n, np.repeat(first[1:], shingles)) - 1
    return at, last, shingles


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of ``counts`` rows; an empty group has 0."""
    out = np.zeros((len(counts), *values.shape[1:]), np.result_type(values.dtype, np.float32) if values.dtype.kind == "f" else values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0)
    return out
