"""Documents packed into token sequences by minimum bin slack.

A text's ids are cut into full windows; what remains of it, shorter than a window, waits in a task's pool with others. While a window can be
filled to the last place, subset sums of the waiting lengths, kept as the bits of one whole number, say with which of them, and going
back through the sums gives how many of each. Ids of texts that no such window takes are laid end to end and cut at its edges, and the
last, unfilled one is cut into powers of two. So no sequence has any padding, and each task cuts few texts more than are longer than a window.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from operator import neg

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from barflow.llm import text as T

#: Ids of a sequence, the id that ends a document, waiting ids of a task, about, and words whose ids a worker remembers.
WINDOW, END, POOL, REMEMBERED = 4096, 2, 1 << 21, 1_000_000
#: Words of a-z and U+00DF to U+00FF but U+00F7, in UTF-8: of its lead bytes these hold only C3.
_PLAIN = re.compile(rb"[a-z\xC3\x9F-\xB6\xB8-\xBF]+")
#: ASCII signs that end a word as one piece; an apostrophe may begin another.
_SIGN = np.array([c < 128 and chr(c).isprintable() and not chr(c).isalnum() and chr(c) not in " '" for c in range(256)])


def filled(lengths: dict[int, int], order: list[int], window: int) -> dict[int, int] | None:
    """How many of each length, the longest among them, fill the window exactly; None if none do. ``lengths`` holds the number of each, and
    ``order`` the lengths from the longest on."""
    longest = order[0]
    sums, steps, goal = 1 << longest, [], 1 << window
    for length in order:
        left, copies = min(lengths[length] - (length == longest), (window - longest) // length), 1
        while left > 0 and not sums & goal:  # a bounded number of copies, as powers of two
            steps.append((sums, length, min(copies, left)))
            sums |= sums << length * min(copies, left) & (goal << 1) - 1
            left, copies = left - min(copies, left), 2 * copies
        if sums & goal:
            break
    else:
        return None
    counts, at = {longest: 1}, window
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            counts[length], at = counts.get(length, 0) + copies, at - length * copies
    return counts


def bytes_as_letters() -> dict[int, str]:
    """The character that byte-level tokenizers put for each byte: itself where it can be printed, else the next of those from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """Ids of whole texts, word by word: words are what white space separates, and each distinct one is encoded once.

    A word of small Latin letters is one piece of the vocabulary's own pattern and goes to its merges directly; the tokenizer encodes any
    other as it is. Latin letters are made small first and signs behind a letter are a word of their own, unless the word may hold a
    special token. ``by_word`` states that all this holds for a tokenizer: white space is dropped, letters are made small, and white space
    changes nothing on either side of it. Otherwise whole texts are encoded.
    """

    def __init__(self, path: str, by_word: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word = Tokenizer.from_file(path), by_word
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.model, self.letters = self.tokenizer.model, bytes_as_letters()

    def word(self, word: bytes) -> list[int]:
        if _PLAIN.fullmatch(word):
            return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids

    def remembered(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as bytes of unsigned 32-bit numbers. Half of the words that a worker remembers are those asked for last; the
        other half is forgotten whenever these fill their half."""
        out, young, old = [], self.young, self.old
        for w in words:
            ids = young.get(w)
            if ids is None:
                ids = young[w] = old.get(w) or array("I", self.word(w)).tobytes()
            out.append(ids)
        if len(young) > REMEMBERED // 2:
            self.young, self.old = {}, young
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and the n + 1 offsets into them."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)
            ids = [np.array(x.ids, np.uint32) for x in found]
            return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        data, offsets = T.utf8(texts)
        starts, ends, first = T.words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        small = T.lower(data)
        capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        small[capital] += 32
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|"
        special = np.unique(np.searchsorted(starts, special, "right") - 1)
        for i in special.tolist():
            small[starts[i] : ends[i]] = data[starts[i] : ends[i]]
        last = np.maximum.accumulate(np.where(_SIGN[small], 0, np.arange(1, len(small) + 1, dtype=np.int32)))[ends - 1]  # behind the last that is no sign
        before = small[np.maximum(last, 1) - 1]
        split = (last > starts) & (last < ends) & (before >= 97) & (before <= 122)
        split[special] = False
        which = np.flatnonzero(split)
        place = which + np.arange(len(which))
        bounds = np.append(np.repeat(starts, 1 + split), 0)
        bounds[place + 1] = last[which]
        keep = ~T.blank(data)
        flat = small[keep]
        bounds = np.searchsorted(np.flatnonzero(keep), bounds)
        bounds[-1] = len(flat)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
        own = self.remembered(found.dictionary.to_pylist())
        lengths = np.concatenate([[0], np.cumsum([len(x) for x in own])]) // 4
        lists = pa.LargeListArray.from_arrays(pa.array(lengths, pa.int64()), pa.array(np.frombuffer(b"".join(own), np.uint32))).take(found.indices)
        words_before = np.concatenate([[0], np.cumsum(1 + split)])[first]
        ids, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        return ids, at[words_before]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, by_word: bool) -> Encoder:
    """One for each Python worker, so that words stay remembered from task to task."""
    if (path, by_word) not in _ENCODERS:
        _ENCODERS[path, by_word] = Encoder(path, by_word)
    return _ENCODERS[path, by_word]


class Pool:
    """What waits in a task, by length, and the pieces of finished sequences: (document, start, ids, its length, sequence, offset)."""

    def __init__(self, window: int, number: int):
        self.window, self.number = window, number
        self.waiting: dict[int, deque] = {}
        self.size, self.out = 0, []

    def sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.number, offset))
            offset += len(ids)
        self.number += 1

    def add(self, doc: object, ids: np.ndarray) -> None:
        full = len(ids) // self.window * self.window
        for start in range(0, full, self.window):
            self.sequence([(doc, start, ids[start : start + self.window], len(ids))])
        if full < len(ids):
            self.waiting.setdefault(len(ids) - full, deque()).append((doc, full, ids[full:].copy(), len(ids)))
            self.size += len(ids) - full

    def pack(self) -> None:
        """Fills windows while that leaves no slack; lengths that no window takes are laid end to end."""
        lengths = {n: len(x) for n, x in self.waiting.items()}
        order, rest = sorted(lengths, reverse=True), []
        while order:
            counts = filled(lengths, order, self.window)
            if counts is None:
                rest.append(order.pop(0))
                continue
            for _ in range(min(lengths[n] // c for n, c in counts.items())):
                self.sequence([self.waiting[n].popleft() for n, c in counts.items() for _ in range(c)])
            for n in counts:
                lengths[n] = len(self.waiting[n])
                if not lengths[n]:
                    del order[bisect_left(order, -n, key=neg)]
        self.lay([x for n in rest for x in self.waiting[n]])

    def lay(self, pieces: list[tuple]) -> None:
        """Full windows of the pieces end to end; what fills none waits on."""
        held, size = [], 0
        for doc, start, ids, total in pieces:
            while size + len(ids) >= self.window:
                room = self.window - size
                self.sequence([*held, (doc, start, ids[:room], total)])
                held, size, start, ids = [], 0, start + room, ids[room:]
            if len(ids):
                held.append((doc, start, ids, total))
                size += len(ids)
        self.waiting, self.size = {}, size
        for piece in held:
            self.waiting.setdefault(len(piece[2]), deque()).append(piece)

    def finish(self) -> None:
        """Cuts what is left, less than a window, into sequences of powers of two."""
        self.pack()
        left = [x for n in sorted(self.waiting, reverse=True) for x in self.waiting[n]]
        while left:
            room, held = 1 << sum(len(x[2]) for x in left).bit_length() - 1, []
            while room:
                doc, start, ids, total = left.pop(0)
                held.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    left.insert(0, (doc, start + room, ids[room:], total))
                room -= len(held[-1][2])
            self.sequence(held)
        self.waiting, self.size = {}, 0


def packed(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, pool: int = POOL, by_word: bool = True) -> DataFrame:
    """Pieces of all documents of ``docs(doc_id, text)``: doc_id, start, ids (little-endian unsigned 32-bit, as trainers map them), doc_tokens,
    sequence_id and offset.

    A document is its text's ids by the tokenizer at ``path`` and ``end``; its pieces follow each other without a gap. A sequence is ``window``
    long, or a power of two at the end of a task. Each task packs its own documents, so nothing is shuffled; ``pool`` bounds the ids
    that wait. Null and empty texts are the end alone; repeated rows and null ids are documents of their own; very long texts are encoded whole
    and cut at full windows first; other columns are not read; an empty table gives no pieces. ``by_word``: see ``Encoder``.
    """
    if window & window - 1:
        raise ValueError("window must be a power of two, since the last sequences of a task are")
    names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("start long, ids binary, doc_tokens long, sequence_id long, offset long").fields])
    schema = StructType([StructField(f.name, f.dataType) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path, by_word), Pool(window, TaskContext.get().partitionId() << 40)

        def out(kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            found, task.out = task.out, []
            for i in range(0, len(found), 2000):
                doc, start, ids, total, number, offset = zip(*found[i : i + 2000])
                arrays = [pa.array(doc, kind), pa.array(start, pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), *(pa.array(x, pa.int64()) for x in (total, number, offset))]
                yield pa.RecordBatch.from_arrays(arrays, names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part in T.slices(batch, "text"):
                ids, offsets = encode(part.column("text"))
                for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    task.add(doc, np.append(ids[a:b], np.uint32(end)))
                    if task.size > pool:
                        task.pack()
                yield from out(kind)
        task.finish()
        if kind is not None:
            yield from out(kind)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op11_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op11_minimum_bin_slack": op11_minimum_bin_slack}
ORACLES: dict[str, str] = {}
