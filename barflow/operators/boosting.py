"""Boosted trees that grow leaf by leaf over histograms, with a penalty on leaves.

Spark sums, for each open leaf, gradients and their slopes by feature and bin; the driver sees these sums alone, of a fixed size whatever
the number of rows, and picks the best split. Trees are short lists of splits, applied to whole batches of binned rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barflow.operators import dataset as D
from barflow.sources.session import checkpointed


@dataclass
class Tree:
    """Splits in the order in which they were made: (leaf, feature, bin). Rows of the leaf with a higher bin move to a new leaf."""

    splits: list[tuple[int, int, int]] = field(default_factory=list)
    values: list[float] = field(default_factory=list)

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins), np.int32)
        for new, (leaf, feature, cut) in enumerate(self.splits, 1):
            out[(out == leaf) & (bins[:, feature] > cut)] = new
        return out


@dataclass
class Boosted:
    """P(up) of rows with ``features``: the trees' sums through the logistic function. ``gain`` is each feature's share of what its splits
    gained."""

    features: list[str]
    edges: list[np.ndarray]
    base: float
    trees: list[Tree]
    gain: dict[str, float]

    def bins(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, i], "left") for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += np.array(tree.values)[tree.leaves(bins)]
        return out

    def __call__(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-model.raw(model.bins(np.stack([c.to_numpy(float) for c in columns], axis=1))))))

        return df.withColumn("score", score(*self.features))


def best_split(sums: np.ndarray, penalty: float, least: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best cut of a leaf by its ``sums`` (feature, bin, gradient / slope / rows); a gain of 0 where there is none."""
    left = sums.cumsum(axis=1)[:, :-1]
    right = sums.sum(axis=1)[:, None] - left
    strength = lambda x: x[..., 0] ** 2 / (x[..., 1] + penalty)
    gain = strength(left) + strength(right) - strength(left + right)
    gain[(left[..., 2] < least) | (right[..., 2] < least)] = 0
    at = np.unravel_index(gain.argmax(), gain.shape)
    return float(gain[at]), int(at[0]), int(at[1])


def boosted_leaves(features: list[str], leaves: int = 15, rounds: int = 100, step: float = 0.05, penalty: float = 1.0, least: int = 50, bins: int = 64, patience: int = 10, subsample: float = 0.8, columns: float = 0.8, seed: int = 7) -> Callable:
    """A fit of ``Boosted`` with log loss. The last year of the training rows, purged, stops it when ``patience`` trees in a row improve nothing
    there. Each tree takes a share of the rows, by a hash, and of the features."""

    def fit(train: DataFrame) -> Boosted:
        rows = D.early_stopping(train.where("y_up is not null"))
        stops = F.col("is_validation")
        learn = rows.where(~stops)
        cuts = learn.agg(*[F.percentile_approx(c, [k / bins for k in range(1, bins)], 10_000).alias(c) for c in features], F.avg("y_up").alias("_p")).first()
        if cuts["_p"] is None:
            return Boosted(features, [np.zeros(0)] * len(features), 0.0, [], dict.fromkeys(features, 0.0))
        p = min(max(cuts["_p"], 1e-6), 1 - 1e-6)
        model = Boosted(features, [np.unique(cuts[c]) for c in features], float(np.log(p / (1 - p))), [], dict.fromkeys(features, 0.0))
        key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "symbol", "session_date"), 33).cast("int")

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1).astype(float)
                found = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(features)), len(values), [None, pa.py_buffer(np.ascontiguousarray(model.bins(values)))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([found, batch.column("y_up"), batch.column("is_validation"), batch.column("key")], ["bins", "y", "stops", "key"])

        data = checkpointed(rows.select(*features, F.col("y_up").cast("double").alias("y_up"), "is_validation", key.alias("key")).mapInArrow(binned, "bins binary, y double, stops boolean, key int"))
        width, size, rng = len(features), bins + 1, np.random.default_rng(seed)

        def loaded(batch: pa.RecordBatch) -> np.ndarray:
            return np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)

        def summed(grown: Boosted, tree: Tree, wanted: list[int], turn: int) -> dict[int, np.ndarray]:
            """The sums of the wanted leaves of a tree that is growing: a job."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                out = np.zeros((len(wanted), width, size, 3))
                for batch in batches:
                    x, y = loaded(batch), batch.column("y").to_numpy()
                    stops, keys = batch.column("stops").to_numpy(zero_copy_only=False).astype(bool), batch.column("key").to_numpy()
                    taken = ~stops & ((keys.astype(np.uint64) * np.uint64(2654435761) + np.uint64(turn * 40503)) % np.uint64(1000) < np.uint64(int(subsample * 1000)))
                    x, y = x[taken], y[taken]
                    p, leaf = 1 / (1 + np.exp(-grown.raw(x))), tree.leaves(x)
                    for i, w in enumerate(wanted):
                        own = leaf == w
                        for k, v in enumerate((p - y, p * (1 - p), np.ones(len(y)))):
                            for f in range(width):
                                out[i, f, :, k] += np.bincount(x[own, f], v[own], size)
                flat = out.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(flat)), pa.array(flat[np.flatnonzero(flat)])], ["slot", "value"])

            found = data.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).toArrow()
            flat = np.zeros(len(wanted) * width * size * 3)
            flat[found.column("slot").to_numpy()] = found.column("value").to_numpy()
            return dict(zip(wanted, flat.reshape(len(wanted), width, size, 3)))

        def loss(grown: Boosted) -> float:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    p, y = np.clip(1 / (1 + np.exp(-grown.raw(loaded(batch)))), 1e-6, 1 - 1e-6), batch.column("y").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array([-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()]), pa.array([len(y)])], ["loss", "n"])

            got = data.where("stops").mapInArrow(run, "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
            return got[0] / got[1] if got[1] else 0.0

        best, kept = loss(model), 0
        for turn in range(rounds):
            tree = Tree()
            shown = np.zeros(width, bool)
            shown[rng.permutation(width)[: max(1, round(columns * width))]] = True
            sums = summed(model, tree, [0], turn)
            while len(tree.splits) + 1 < leaves:
                ways = {leaf: best_split(np.where(shown[:, None, None], s, 0.0), penalty, least) for leaf, s in sums.items()}
                leaf = max(ways, key=lambda x: (ways[x][0], -x))
                gain, feature, cut = ways[leaf]
                if gain <= 1e-12:
                    break
                model.gain[features[feature]] += gain
                tree.splits.append((leaf, feature, cut))
                new, whole = len(tree.splits), sums[leaf]
                sums[new] = summed(model, tree, [new], turn)[new]
                sums[leaf] = whole - sums[new]
            total = {leaf: s[0].sum(axis=0) for leaf, s in sums.items()}
            tree.values = [float(-step * total[leaf][0] / (total[leaf][1] + penalty)) for leaf in range(len(tree.splits) + 1)]
            model.trees.append(tree)
            if (now := loss(model)) < best - 1e-9:
                best, kept = now, len(model.trees)
            elif len(model.trees) - kept >= patience:
                break
        del model.trees[kept:]
        whole = sum(model.gain.values()) or 1.0
        model.gain = {c: g / whole for c, g in model.gain.items()}
        return model

    return fit
