"""SimHash near-duplicates: deletion-variant signatures of fingerprint segments, an equality join, and verification."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from barflow.llm import text as T
from barflow.llm.components import connected_components
from barflow.llm.session import checkpointed, fresh

BITS = 64
_LANES = np.uint64(0x0101010101010101)
#: Fingerprints of one signature up to which pairs are looked at by lag over many signatures at once, and up to which as a matrix;
#: with more than so many links a fingerprint, a spanning forest stands for the links.
_RUN, _MATRIX, _DENSE = 8, 4096, 2
#: Independent fingerprints of a text where links are verified: the more, the fewer similar texts lie far apart in all of them.
PRINTS = 2
#: Nodes and shingles of one block of a dense group; two blocks at a time are verified in a task.
_BLOCK, _SHINGLES = 1024, 1 << 20


def shingle_hashes(column: pa.Array, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every word shingle (A-Z lowered, one space between words) of each text on end, and their counts."""
    data, offsets = T.utf8(column)
    data = T.lower(data)
    starts, ends, first = T.words(data, offsets)
    data, starts, ends = T.joined(data, starts, ends, first)
    at, last, counts = T.shingle_bounds(first, shingle)
    buffer, digest = data.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(buffer[a:b], seed) for a, b in zip(starts[at].tolist(), ends[last].tolist())), np.uint64, len(at)), counts


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each group of hashes, the bits that are set in over half of them; an empty group gives 0."""
    pieces = -(-counts // 255)
    group = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = (np.cumsum(counts) - counts)[group] + 255 * nth
    out = np.zeros(len(counts), np.uint64)
    for plane in range(8 if len(at) else 0):
        lanes = np.add.reduceat((hashes >> np.uint64(plane)) & _LANES, at)  # eight byte counters of up to 255
        totals = T.segment_sums(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), pieces)
        for byte in range(8):
            out |= (2 * totals[:, byte] > counts).astype(np.uint64) << np.uint64(8 * byte + plane)
    return out


def text_hashes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """XXH64 of each text's shingle hashes in order: equal for texts of the same lowered words alone, but for collisions."""
    ends, buffer = np.cumsum(counts) * 8, hashes.tobytes()
    return np.fromiter((xxhash.xxh64_intdigest(buffer[a:b]) for a, b in zip((ends - counts * 8).tolist(), ends.tolist())), np.uint64, len(counts)).view(np.int64)


def identified(docs: DataFrame, shingle: int, id_col: str, text_col: str, prints: int = 1) -> DataFrame:
    """(doc_id, exact, node, fps, n) of every row: a hash of id and text, one of its lowered words in order, its fingerprints and its
    number of shingles. The first fingerprint is of the shingles' own hashes, each other one of a bijection of these; a text
    without words has fingerprints 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                hashes, counts = shingle_hashes(part.column("text"), shingle)
                found = [majority_bits(T.mix(hashes + np.uint64(k)) if k else hashes, counts).view(np.int64) for k in range(prints)]
                fps = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(found, axis=1).ravel()), prints).cast(pa.list_(pa.int64()))
                columns = [pa.array(text_hashes(hashes, counts)), fps, pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("exact"), *columns], ["doc_id", "exact", "node", "fps", "n"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("exact"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, exact long, node long, fps array<long>, n long")


def segments(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one always differs by one bit at most."""
    n = radius // 2 + 1
    cuts = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


#: A key holds the print's number, that of the variant, and the rest of the segment from these bits on.
_PRINT, _VARIANT = np.uint64(56), np.uint64(40)


def signatures(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Every segment as it is and with each of its bits left out: (key, index of the fingerprint)."""
    keys, variant = [], 0
    for start, width in segments(radius):
        part = (fps >> np.uint64(start)) & np.uint64((1 << width) - 1)
        for bit in range(-1, width):
            rest = part if bit < 0 else part & np.uint64(((1 << width) - 1) ^ (1 << bit))
            keys.append(rest | np.uint64(variant) << _VARIANT)
            variant += 1
    return np.concatenate(keys), np.tile(np.arange(len(fps)), variant)


def wildcards(radius: int) -> np.ndarray:
    """The bit of the fingerprint that each variant leaves out, -1 for none."""
    return np.array([-1 if bit < 0 else start + bit for start, width in segments(radius) for bit in range(-1, width)])


def _forest(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints, breadth first: what is reached is looked at no more, so that a
    dense group takes few rounds over few fingerprints. It begins at the middle, by majority of each bit, so that the many
    signatures which a family shares give the same links."""
    ones = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").mean(axis=0) > 0.5
    middle = np.packbits(ones, bitorder="little").view(np.uint64)[0]
    left, a, b = fps[np.argsort(np.bitwise_count(fps ^ middle), kind="stable")], [], []
    while len(left) > 1:
        todo, left = deque([left[0]]), left[1:]
        while todo and len(left):
            x = todo.popleft()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found, left = left[near], left[~near]
                todo.extend(found)
                a.append(np.full(len(found), x))
                b.append(found)
    return a, b


def _pairs(fps: np.ndarray, radius: int, bit: int) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """All links among the fingerprints of one signature; of a dense group, a spanning forest; and which it is."""
    a, b, step, total = [], [], max(1, (1 << 20) // len(fps)), 0
    for at in range(0, len(fps), step):
        x = fps[at : at + step, None] ^ fps[None, :]
        ok = (np.bitwise_count(x) <= radius) & (np.arange(len(fps)) > (at + np.arange(len(x)))[:, None])
        total += int(ok.sum())
        if total > _DENSE * len(fps):
            return *_crossing(fps, radius, bit), True
        if bit >= 0:
            ok &= ((x >> np.uint64(bit)) & np.uint64(1)).astype(bool)
        i, j = np.nonzero(ok)
        a.append(fps[at + i])
        b.append(fps[j])
    return a, b, False


def _crossing(fps: np.ndarray, radius: int, bit: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The forest of a dense group. Of a wildcard's, without links whose ends agree in the bit, where the group of the whole segment
    that both are in is dense too: its own forest joins them."""
    a, b = _forest(fps, radius)
    if bit < 0 or not a:
        return a, b
    a, b, mask = np.concatenate(a), np.concatenate(b), np.uint64(1) << np.uint64(bit)
    keep = ((a ^ b) & mask) != 0
    for value in (np.uint64(0), mask):
        side = fps[(fps & mask) == value]
        if len(side) <= _RUN or not _pairs(side, radius, -1)[2]:
            keep |= ((a & mask) == value) & ((b & mask) == value)
    return [a[keep]], [b[keep]]


def _divided(fps: np.ndarray, radius: int, variant: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join all that links join among many fingerprints of one signature: the bits outside its segment are cut into
    radius + 1 blocks, of which two fingerprints in reach share one at least."""
    segment = np.cumsum([width + 1 for _, width in segments(radius)]).searchsorted(variant, "right")
    inside = range(segments(radius)[segment][0], sum(segments(radius)[segment]))
    outside, a, b = [i for i in range(BITS) if i not in inside], [], []
    for block in range(radius + 1):
        mask = np.uint64(sum(1 << i for i in outside[block :: radius + 1]))
        order = np.argsort(fps & mask, kind="stable")
        part = fps[order]
        cut = np.flatnonzero(np.diff(part & mask)) + 1
        bounds = np.concatenate([[0], cut, [len(part)]])
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if end - start > 1:
                own = part[start:end]
                x, y = _forest(own, radius) if len(own) > _MATRIX else _pairs(own, radius, -1)[:2]
                a += x
                b += y
    return a, b


def linked(keys: np.ndarray, fps: np.ndarray, radius: int, matrix: float = _MATRIX) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, of which) links among the fingerprints of equal keys (sorted by key). Of a wildcard's group, only pairs that differ
    there: the others meet in the group of the whole segment. A group of over ``matrix`` fingerprints gives forests whatever its
    links. The last is 2 * print, and 1 more for links of a forest."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], cut]) if len(keys) else cut
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    out_a, out_b, which, wild = [], [], [], wildcards(radius)
    variants, prints = (keys >> _VARIANT & np.uint64(0xFFFF)).astype(np.int64), (keys >> _PRINT).astype(np.int64)
    for start, size in zip(starts[sizes > _RUN].tolist(), sizes[sizes > _RUN].tolist()):
        own, variant = np.unique(fps[start : start + size]), int(variants[start])
        a, b, tree = (*_divided(own, radius, variant), True) if len(own) > matrix else _pairs(own, radius, int(wild[variant]))
        out_a += a
        out_b += b
        which += [np.full(len(x), 2 * prints[start] + tree) for x in a]
    small = np.repeat(sizes <= _RUN, sizes)
    keys, fps, prints, wild = keys[small], fps[small], prints[small], wild[variants[small]]
    for lag in range(1, int(sizes[sizes <= _RUN].max(initial=1))):
        at = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not len(at):
            break
        x = fps[at] ^ fps[at + lag]
        bit = wild[at]
        at = at[(np.bitwise_count(x) <= radius) & ((bit < 0) | ((x >> np.maximum(bit, 0).astype(np.uint64)) & np.uint64(1)).astype(bool))]
        out_a.append(fps[at])
        out_b.append(fps[at + lag])
        which.append(2 * prints[at])
    return (np.concatenate(out_a), np.concatenate(out_b), np.concatenate(which)) if out_a else (fps[:0], fps[:0], np.zeros(0, np.int64))


def links(distinct: DataFrame, radius: int, mark: bool = False) -> DataFrame:
    """Links (print, a, b) among distinct fingerprints (print, fp) of a print at ``radius`` or fewer differing bits.

    The segments number radius // 2 + 1, so that of two fingerprints in reach one segment differs in one bit at
    most: both then share a signature, and none is missed. Rows are dealt out and sorted by signature; a task
    streams over them and holds one signature's fingerprints at a time. Signatures give every link, but for those with over
    two links a fingerprint or over 4,096 fingerprints: these give spanning forests, with the same components.

    With ``mark`` only the former give a forest, and its links are marked in a column ``dense``: of two fingerprints in
    reach, either the link is there or links marked dense join them.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 20_000) for at in range(0, len(batch), 20_000)):
                prints, fps = part.column("print").to_numpy().astype(np.uint64), part.column("fp").to_numpy()
                keys, index = signatures(fps.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array((keys | prints[index] << _PRINT).view(np.int64)), pa.array(fps[index])], ["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[np.ndarray], fps: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b, which = linked(np.concatenate(keys), np.concatenate(fps), radius, np.inf if mark else _MATRIX)
            which = which if mark else which & ~1
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), which.astype(np.uint64)]), axis=1).view(np.int64)
            if found.size:
                yield pa.RecordBatch.from_arrays([pa.array((found[2] >> 1).astype(np.int32)), pa.array(found[0]), pa.array(found[1]), pa.array(found[2] % 2 == 1)], ["print", "a", "b", "dense"])

        keys: list[np.ndarray] = []
        fps: list[np.ndarray] = []
        for batch in batches:
            k, f = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if cut:
                yield from out([*keys, k[:cut]], [*fps, f[:cut]])
                keys, fps = [], []
            elif keys and len(k) and keys[-1][-1] != k[-1]:
                yield from out(keys, fps)
                keys, fps = [], []
            keys.append(k[cut:])
            fps.append(f[cut:])
        if keys:
            yield from out(keys, fps)

    # a small table, but its rows give some seventy each: spread them first
    spread = distinct.select("print", "fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    dealt = spread.mapInArrow(deal, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "print int, a long, b long, dense boolean").distinct()


def _verified_forest(fps: np.ndarray, side: np.ndarray, label: np.ndarray, sets: pa.Array, radius: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links (row numbers) among the rows of different sides (or of one, if there is but one) that join all labels which links join.

    A link is a pair at ``radius`` or fewer differing bits whose sets reach the Jaccard similarity. Pairs of one label, by
    what is known before or by links found here, aren't looked at.
    """
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends, label, two = np.cumsum(sizes), np.unique(label, return_inverse=True)[1], side.min() != side.max()
    items = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
    held, a, b = np.zeros(int(items.max(initial=-1)) + 1, bool), [], []
    own = [items[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    for x in range(len(fps) - 1):
        ok = (np.bitwise_count(fps[x + 1 :] ^ fps[x]) <= radius) & (label[x + 1 :] != label[x])
        ok &= np.minimum(sizes[x + 1 :], sizes[x]) >= similarity * np.maximum(sizes[x + 1 :], sizes[x])
        if two:
            ok &= side[x + 1 :] != side[x]
        others = np.flatnonzero(ok) + x + 1
        if not len(others):
            continue
        held[own[x]] = True
        both = T.segment_sums(held[np.concatenate([own[y] for y in others.tolist()])].astype(np.int64), sizes[others])
        held[own[x]] = False
        for y in others[both >= similarity * (sizes[x] + sizes[others] - both)].tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                a.append(x)
                b.append(y)
    return a, b


def compared(asked: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b) of verified links, enough to join all that they join. ``asked`` has (print, root, i, j, side, node, fp, label, set): rows of
    equal print, root, i and j are compared, those of side 0 with those of side 1, or all of them if they are of one side, where
    their labels differ."""
    names = ["print", "root", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            column = lambda name: pa.concat_arrays([p.column(name) for p in parts])
            node, fps = column("node").to_numpy(), column("fp").to_numpy().view(np.uint64)
            a, b = _verified_forest(fps, column("side").to_numpy(), column("label").to_numpy(), column("set"), radius, similarity) if len(node) > 1 else ([], [])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in names])
            bounds = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)] if len(batch) else []
            for start, end in zip(bounds, bounds[1:]):
                key = keys[:, start].tolist()
                if held and key != last:
                    yield from close(held)
                    held = []
                last = key
                held.append(batch.slice(start, end - start))
        if held:
            yield from close(held)

    return asked.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")


def candidates(nodes: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """Of the ``nodes`` (print, node, fp, n shingles): pairs (a, b) of nodes that links join, and the groups (print, root, node, fp, n)
    in which other pairs may be in reach.

    A link of a sparse signature is a pair, if both fingerprints are of one text each. Dense signatures only give forests, and a
    fingerprint of several texts a star from one of them: what these join is a group besides.
    """
    # components are sought among numbers of (print, fp): were two to share one, more would be compared and nothing missed
    number = lambda fp: F.xxhash64("print", fp)
    fps = checkpointed(nodes.groupBy("print", "fp").agg(F.count(F.lit(1)).alias("texts"), F.min("node").alias("first")))
    edges = links(fps, radius, mark=True)
    for end in "ab":
        edges = edges.join(fps.select("print", F.col("fp").alias(end), F.col("texts").alias(f"texts_{end}"), F.col("first").alias(f"first_{end}")), ["print", end])
    edges = checkpointed(edges.select("print", "a", "b", "first_a", "first_b", (F.col("dense") | (F.col("texts_a") > 1) | (F.col("texts_b") > 1)).alias("dense")))
    many = fps.where("texts > 1")
    star = nodes.join(many.select("print", "fp", "first"), ["print", "fp"]).where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = edges.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).unionByName(star)
    roots = connected_components(edges.where("dense").select(number("a").alias("a"), number("b").alias("b")))
    alone = many.select(number("fp").alias("node")).join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    roots = roots.unionByName(alone).withColumnRenamed("node", "number")
    groups = nodes.withColumn("number", number("fp")).join(roots, "number").select("print", "root", "node", "fp", "n")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), groups


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose ``sets`` (node, set) reach the Jaccard similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def blocks(groups: DataFrame) -> DataFrame:
    """``groups`` (print, root, node, fp, n, label) dealt to comparisons: (print, root, i, j, side, node, fp, label).

    Only groups of several labels are left. A label of half a block's size or more has blocks of its own, of about 1,024 nodes or
    2^20 shingles; the others share some. Every two blocks are compared, but for those of one label: all pairs of different labels
    meet, and a family that is joined already takes rows in proportion to its size.
    """
    key = ["print", "root"]
    size = lambda: F.greatest(F.count(F.lit(1)) / _BLOCK, F.sum("n") / _SHINGLES)
    open_groups = groups.groupBy(*key).agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a <> _b").select(*key)
    groups = groups.join(open_groups, key)
    labels = groups.groupBy(*key, "label").agg(size().alias("size")).withColumn("big", F.col("size") >= 0.5)
    shared = labels.groupBy(*key, "big", F.when(F.col("big"), F.col("label")).alias("owner")).agg(F.greatest(F.ceil(F.sum("size")), F.lit(1)).cast("long").alias("k"))
    # a block is (owner, number); those that labels share have the owner null
    rows = groups.join(labels.select(*key, "label", "big"), [*key, "label"]).withColumn("owner", F.when(F.col("big"), F.col("label")))
    every = shared.groupBy(*key).agg(F.collect_list(F.struct("owner", "k")).alias("all"))
    rows = rows.join(every, key)
    mine = F.element_at(F.filter("all", lambda x: x["owner"].eqNullSafe(F.col("owner"))), 1)["k"]
    own = F.struct("owner", F.pmod(F.xxhash64("node"), mine).alias("no"))
    others = F.flatten(F.transform(F.filter("all", lambda x: x["owner"].isNull() | ~x["owner"].eqNullSafe(F.col("owner"))), lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["k"] - 1), lambda no: F.struct(x["owner"].alias("owner"), no.alias("no")))))
    rows = rows.select(*key, "node", "fp", "label", own.alias("own"), F.explode(others).alias("other"))
    number = lambda x: F.xxhash64(x)
    return rows.select(*key, number(F.least("own", "other")).alias("i"), number(F.greatest("own", "other")).alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "fp", "label")


def shingle_sets(docs: DataFrame, chosen: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, set of shingle hashes) of the rows ``chosen`` (node, exact)."""
    texts = docs.select(F.xxhash64(id_col, text_col).alias("exact"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                hashes, counts = shingle_hashes(part.column("text"), shingle)
                sets = [np.unique(x).view(np.int64) for x in np.split(hashes, np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    return texts.join(chosen, "exact").select("node", "text").mapInArrow(run, "node long, set array<long>").dropDuplicates(["node"])


def grouped(docs: DataFrame, radius: int, shingle: int, similarity: float | None, id_col: str, text_col: str, prints: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, fp, node), and each node's group: (node, least, root). ``least`` is its row (nameless, doc_id, exact) of
    least id."""
    rows = checkpointed(identified(docs, shingle, id_col, text_col, 1 if similarity is None else prints))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "exact")).alias("least")
    if similarity is None:
        rows = rows.select("doc_id", F.col("fps")[0].alias("fp"), F.col("fps")[0].alias("node"))
        nodes = rows.groupBy("node").agg(F.struct(F.min("doc_id").alias("doc_id")).alias("least"))
        edges = links(nodes.select(F.lit(0).alias("print"), F.col("node").alias("fp")), radius).select("a", "b")
    else:
        nodes = checkpointed(rows.groupBy("node", "fps", "n").agg(least))
        rows = rows.select("doc_id", F.col("fps")[0].alias("fp"), "node")
        pairs, groups = map(checkpointed, candidates(nodes.select("node", "n", F.posexplode("fps").alias("print", "fp")), radius))
        asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(groups.select("node")).distinct()
        sets = checkpointed(shingle_sets(docs, nodes.select("node", "least.exact").join(asked, "node"), shingle, id_col, text_col))
        # links of the signatures first; then only what they leave apart in a group
        edges = checkpointed(similar(pairs, sets, similarity))
        labels = connected_components(edges).withColumnRenamed("root", "label")
        labelled = checkpointed(groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
        edges = edges.unionByName(compared(blocks(labelled).join(sets, "node"), radius, similarity))
    return rows, nodes.join(connected_components(edges), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text", prints: int = PRINTS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    Fingerprints at ``radius`` or fewer differing bits are linked. Copies share a fingerprint, so links are sought among
    distinct fingerprints and a group of copies costs one row. With ``similarity``, distinct texts (by their lowered words)
    are linked, if they are in reach in one of ``prints`` independent fingerprints and the Jaccard similarity of their word
    shingles reaches it too, whether their fingerprints differ or not. component_id is the smallest doc_id reachable.

    Ids may be of any type that has an order. Null and empty texts have fingerprint 0 and are linked like any other; a null
    doc_id gets its group's component_id and is never one; repeated rows give repeated rows; an empty table gives none; other
    columns of ``docs`` are not read.
    """
    rows, named = grouped(docs, radius, shingle, similarity, id_col, text_col, prints)
    # min skips the null of a group's rows without an id
    named = named.join(named.groupBy("root").agg(F.min("least.doc_id").alias("component_id")), "root").select("node", "component_id")
    return rows.join(named, "node").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, radius: int, shingle: int, similarity: float, id_col: str = "doc_id", text_col: str = "text", prints: int = PRINTS) -> DataFrame:
    """The rows of ``docs``, as they are, of which each stands for its group of near duplicates: the one of least id, once.

    Rows that share an id but not their text are told apart by the text; a group of rows without an id keeps one of them. Groups are
    those of :func:`near_duplicates`. Null and empty texts are one group; an empty table gives no rows.
    """
    (exact,) = fresh(docs.columns, "exact")
    _, named = grouped(docs, radius, shingle, similarity, id_col, text_col, prints)
    first = named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.exact").alias(exact))
    kept = docs.withColumn(exact, F.xxhash64(id_col, text_col)).join(first, exact, "left_semi")
    return kept.dropDuplicates([id_col, exact]).select(docs.columns)


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_simhash_near_dedup": op9_simhash_near_dedup}
ORACLES: dict[str, str] = {}
