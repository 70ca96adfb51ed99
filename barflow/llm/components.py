"""Connected components: chunks of edges contracted in tasks, then alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barflow.llm.session import checkpointed

#: Edges of a chunk that one task contracts at a time.
CHUNK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node reachable) of every node of the edges but the least ones."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame, chunks: int) -> DataFrame:
    """Edges (a, b), a > b, with the same components: each chunk of about ``CHUNK`` edges as stars to its least nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            found = stars(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b"])

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            if sum(len(x) for x, _ in held) >= CHUNK:
                yield out()
                held = []
        if held:
            yield out()

    return edges.repartition(chunks).mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``, whole numbers of 64 bits; root is the least node that can be reached.

    Edges are contracted in chunks first. One chunk is all there is to do; of more, each round is two grouped minima and two
    equi-joins on the cluster and ends in a checkpoint, and the driver sees one count and one hash a round. Rounds grow with the
    logarithm of a component's size. Empty edges give an empty result; loops, repeated and reversed edges change
    nothing; edges with a null are skipped.
    """
    edges = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    chunks = max(1, -(-edges.count() // CHUNK))
    pairs = checkpointed(contracted(edges, chunks).distinct() if chunks > 1 else contracted(edges, 1))
    seen = None
    while chunks > 1:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = checkpointed(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
