"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barflow.llm import text as T
from barflow.llm.sampling import remainder, sampled_ids
from barflow.llm.session import bounded

#: Hash buckets of words (a power of two), rank of the interactions, and the fit's parameters.
WORD_BITS, RANK = 14, 6
PER_CLASS, EPOCHS, BATCH, RATE, DECAY = 3000, 12, 32, 0.08, 1e-5
#: Structure statistics (the last two are metadata of the row: its stated length, and that against the text's).
STATISTICS = (
    "log words", "mean word length", "share of letters", "share of digits", "share of symbols", "share of other punctuation", "share of capitals",
    "share of non-ASCII bytes", "share of words without a letter or digit", "share of words equal to the one before", "share of repeated words",
    "log lines", "share of repeated lines", "words that end a sentence", "log stated length", "stated length over length",
)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 3
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>"]] = 4


def _repeats(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per group, the number of values that occurred before in it."""
    group = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, group))
    v, g = values[order], group[order]
    same = (v[1:] == v[:-1]) & (g[1:] == g[:-1])
    return np.bincount(g[1:][same], minlength=len(counts))


def features(column: pa.Array, stated: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights) of each text's distinct hashed words on end, their number by text, and the statistics.

    A word weighs its share of the text's words, so that all words of a text weigh 1 together.
    """
    data, offsets = T.utf8(column)
    starts, ends, first = T.words(data, offsets)
    counts, size = np.diff(first), np.maximum(np.diff(offsets), 1)
    n = np.maximum(counts, 1)
    hashes = T.Hasher(T.lower(data))(starts, ends)
    kind = _CLASS[data]
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / size
    group = np.repeat(np.arange(len(counts)), counts)
    inner = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
    plain = inner[ends] - inner[starts] == 0
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (group[1:] == group[:-1])
    by_text = lambda mask: np.bincount(group[mask], minlength=len(counts)) / n
    stops = np.isin(data[ends - 1], [46, 33, 63]) if len(ends) else np.zeros(0, bool)
    breaks = np.flatnonzero(data == 10)
    line_ends = np.unique(np.concatenate([breaks, offsets[1:]])) if len(data) else np.zeros(0, np.int64)
    edges = np.unique(np.concatenate([offsets, breaks + 1]))
    spans = np.stack([edges[:-1], edges[1:]]) if len(edges) > 1 else np.zeros((2, 0), np.int64)
    owner = np.searchsorted(offsets, spans[0], "right") - 1
    lines = np.bincount(owner, minlength=len(counts)) if len(owner) else np.zeros(len(counts), np.int64)
    line_hash = T.Hasher(data)(spans[0], np.minimum(spans[1], len(data))) if len(line_ends) else np.zeros(0, np.uint64)
    told = np.nan_to_num(np.asarray(stated.cast(pa.float64()).to_numpy(zero_copy_only=False), float), nan=0.0)
    table = np.stack([
        np.log1p(counts) / 4, np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[first]) / n / 8, share(kind == 1), 4 * share(kind == 2), 4 * share(kind == 3), 4 * share(kind == 4),
        4 * share((data >= 65) & (data <= 90)), share(data >= 128), by_text(plain), by_text(again), _repeats(hashes, counts) / n,
        np.log1p(lines) / 3, _repeats(line_hash, lines) / np.maximum(lines, 1), by_text(stops), np.log1p(np.maximum(told, 0)) / 8, np.minimum(np.maximum(told, 0) / size, 2),
    ], axis=1)
    bucket = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    cells, times = np.unique(group << WORD_BITS | bucket, return_counts=True)
    owner = cells >> WORD_BITS
    return cells & ((1 << WORD_BITS) - 1), times / n[owner], np.bincount(owner, minlength=len(counts)), table


@dataclass
class FactorisationMachine:
    """w0 + sum w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, the last as half of (sum v x)^2 - sum (v x)^2."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def blank(cls, seed: int = 0) -> FactorisationMachine:
        n = (1 << WORD_BITS) + len(STATISTICS)
        return cls(0.0, np.zeros(n), np.random.default_rng(seed).normal(0, 0.05, (n, RANK)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))

    def standard(self, table: np.ndarray) -> np.ndarray:
        """Statistics by the training rows' mean and deviation, cut at eight deviations."""
        return np.clip((table - self.mean) / self.scale, -8, 8)

    def logits(self, buckets: np.ndarray, x: np.ndarray, counts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores in time linear in the features, and each text's sum of v x for the gradient."""
        s, base = self.standard(table), 1 << WORD_BITS
        wx = x[:, None] * self.factors[buckets]
        total = T.segment_sums(wx, counts) + s @ self.factors[base:]
        squares = T.segment_sums(wx**2, counts) + s**2 @ self.factors[base:] ** 2
        linear = T.segment_sums(x * self.weights[buckets], counts) + s @ self.weights[base:]
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1), total

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, labels: np.ndarray, seed: int = 0) -> None:
        """Log loss by AdaGrad over small batches, classes weighted alike."""
        self.mean, self.scale = table.mean(axis=0), table.std(axis=0) + 1e-3
        rng, base = np.random.default_rng(seed), 1 << WORD_BITS
        sq_w, sq_v, sq_b = np.full(len(self.weights), 1e-4), np.full(self.factors.shape, 1e-4), 1e-4
        balance = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        for _ in range(EPOCHS):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                counts = np.array([len(texts[i][0]) for i in rows])
                flat, x = np.concatenate([texts[i][0] for i in rows]), np.concatenate([texts[i][1] for i in rows])
                z, total = self.logits(flat, x, counts, table[rows])
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * balance[rows] / len(rows)
                s, owner = self.standard(table[rows]), np.repeat(np.arange(len(rows)), counts)
                used, place = np.unique(flat, return_inverse=True)
                grad_w = np.bincount(place, g[owner] * x, len(used))
                grad_v = np.stack([np.bincount(place, g[owner] * (x * total[owner, f] - x**2 * self.factors[flat, f]), len(used)) for f in range(RANK)], axis=1)
                used = np.concatenate([used, base + np.arange(s.shape[1])])
                grad_w = np.concatenate([grad_w, g @ s]) + DECAY * self.weights[used]
                grad_v = np.concatenate([grad_v, (g[:, None] * s).T @ total - (g @ s**2)[:, None] * self.factors[base:]]) + DECAY * self.factors[used]
                sq_w[used] += grad_w**2
                sq_v[used] += grad_v**2
                sq_b += g.sum() ** 2
                self.weights[used] -= RATE * grad_w / np.sqrt(sq_w[used])
                self.factors[used] -= 0.3 * RATE * grad_v / np.sqrt(sq_v[used])
                self.bias -= RATE * g.sum() / np.sqrt(sq_b)

    def scored(self, column: pa.Array, stated: pa.Array) -> np.ndarray:
        z = self.logits(*features(column, stated))[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = 0) -> FactorisationMachine:
    """Fit on about ``per_class`` rows of each value of ``labels(doc_id, quality)``; ``docs`` has doc_id, text, n_chars.

    Labels other than 0 and 1, and null ids, are left out; an id labelled both ways counts as 0. Without rows of both
    labels the machine stays blank and scores 0.5 throughout.
    """
    wanted = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("string").alias("label"))
    chosen = sampled_ids(wanted, per_class, seed)
    sample = docs.join(bounded(chosen), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text", "n_chars").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                buckets, x, counts, table = features(part.column("text"), part.column("n_chars"))
                cut = np.cumsum(counts)[:-1]
                arrays = [pa.array(np.split(v.astype(t), cut), pa.list_(k)) for v, t, k in ((buckets, np.int32, pa.int32()), (x, np.float32, pa.float32()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *arrays, pa.array(list(table), pa.list_(pa.float64()))], ["doc_id", "label", "ids", "x", "s"])

    machine = FactorisationMachine.blank(seed)
    kind = dict(sample.dtypes)["doc_id"]
    found = sample.mapInArrow(run, f"doc_id {kind}, label int, ids array<int>, x array<float>, s array<double>").toArrow().sort_by("doc_id")
    target = found.column("label").to_numpy().astype(float)
    if len(set(target.tolist())) == 2:
        texts = [(np.asarray(i.values).astype(np.int64), np.asarray(x.values).astype(float)) for i, x in zip(found.column("ids"), found.column("x"))]
        machine.fit(texts, np.array(found.column("s").to_pylist()), target, seed)
    else:
        machine.factors[:] = 0
    return machine


def predict(docs: DataFrame, machine: FactorisationMachine) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs(doc_id, text, n_chars)``, repeated rows included.

    Null and empty texts are scored from their statistics; a null n_chars counts as 0; texts are read whole; an empty
    table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                score = machine.scored(part.column("text"), part.column("n_chars"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    machine = fit(docs.where(~held_out), labels.where(~held_out))
    return predict(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {"op7_factorisation_machine": op7_factorisation_machine}
ORACLES: dict[str, str] = {}
