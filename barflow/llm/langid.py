"""Language identification: averaged hashed subword embeddings and a linear softmax, with calibrated rejection."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from barflow.llm import text as T
from barflow.llm.sampling import remainder, sampled_ids
from barflow.llm.session import bounded

#: Hash buckets (a power of two), width of the embeddings, byte lengths of subwords, and the fit's parameters.
BUCKET_BITS, WIDTH, LENGTHS = 15, 8, (2, 3, 4)
PER_LANGUAGE, EPOCHS, BATCH, RATE = 500, 12, 32, 2.0
#: Share of rightly named validation rows that rejection by score may cost, and the highest threshold: above it the other languages
#: together are less likely than the one named, and a text is only rejected as unfamiliar.
COST, HIGHEST = 0.001, 0.5
#: Subwords of usual frequency that a text is taken to have besides its own when its familiarity is judged: so short texts are not
#: rejected by chance. Rows of which one in so many calibrates.
PRIOR, HOLD = 12, 5
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def subwords(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, the buckets of all texts' subwords on end, and each text's number of them.

    Subwords are byte n-grams of words that are lowered and edged with a space; none spans two words. Digits are of no language and part
    words like a space, so that every letter is in some subword.
    """
    data, offsets = T.utf8(column)
    data = np.where((data >= 48) & (data <= 57), np.uint8(32), data)
    starts, ends, first = T.words(data, offsets)
    data, starts, ends = T.joined(T.lower(data), starts, ends, first)
    counts = np.diff(first)
    full = np.flatnonzero(counts)
    if not len(full):
        return [(np.zeros(0, np.int64), np.zeros(len(counts), np.int64))]
    # one space before the first text, between texts and after the last, so that every word has its edges
    at, size = starts[first[:-1][full]], len(data) + len(full) + 1
    place = np.ones(size, bool)
    edges = np.concatenate([at + np.arange(len(full)), [size - 1]])
    place[edges] = False
    line = np.full(size, 32, np.uint8)
    line[place] = data
    space, owner = line == 32, edges[1:]
    out = []
    for n in LENGTHS:
        if size < n:
            continue
        value = np.full(size - n + 1, n, np.uint32) * np.uint32(0x2545F491)
        inner = np.zeros(size - n + 1, bool)
        for i in range(n):
            value += (line[i : size - n + 1 + i].astype(np.uint32) + np.uint32(1)) * _FACTORS[i]
            if 0 < i < n - 1:
                inner |= space[i : size - n + 1 + i]
        if n == 2:
            inner = space[:-1] & space[1:]
        keep = np.flatnonzero(~inner)
        value = value[keep] * np.uint32(0x9E3779B1)
        value ^= value >> np.uint32(15)
        each = np.zeros(len(counts), np.int64)
        each[full] = np.diff(np.concatenate([[0], np.searchsorted(keep, owner)]))  # by the text in which a gram starts
        out.append((((value * np.uint32(0x85EBCA77)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), each))
    return out


def subword_sums(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``table`` rows over each text's subwords, and their number."""
    sums, total = np.zeros((len(column), table.shape[1])), np.zeros(len(column), np.int64)
    for buckets, counts in subwords(column):
        total += counts
        for j in range(table.shape[1]):
            sums[:, j] += T.segment_sums(table[:, j][buckets], counts)
    return sums, total


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; false for null."""
    data, offsets = T.utf8(column)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    found = np.concatenate([[0], np.cumsum(letter)])[offsets]
    out = found[1:] > found[:-1]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)).tolist():
        out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


@dataclass
class LanguageModel:
    """logits = mean over subwords of table[bucket], plus bias; score is the softmax at the fitted temperature. The table's last column
    holds the log frequency of a bucket in training: its mean is a text's familiarity."""

    languages: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((1 << BUCKET_BITS, 0), np.float32, order="F"))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    threshold: float = 0.0
    usual: float = 0.0
    least: float = -np.inf

    def familiarity(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Mean log frequency of the subwords, with ``PRIOR`` usual ones."""
        return (sums + PRIOR * self.usual) / (counts + PRIOR)

    def named(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language (und: null or without a letter), score and rejection of each text."""
        letters = has_letter(column)
        if not self.languages:
            return np.full(len(column), "und", object), np.zeros(len(column)), ~letters
        sums, counts = subword_sums(column, self.table)
        logits = sums[:, :-1] / np.maximum(counts, 1)[:, None] + self.bias
        p = _softmax(logits / self.temperature)
        strange = self.familiarity(sums[:, -1], counts) < self.least
        score = np.where(letters, p.max(axis=1), 0.0)
        names = np.array([*self.languages, "und"], object)
        return names[np.where(letters, p.argmax(axis=1), len(self.languages))], score, ~letters | (counts == 0) | (score < self.threshold) | strange


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(ids: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(table, bias) by stochastic gradient descent over texts given as distinct subword buckets and their shares of the text."""
    rng = np.random.default_rng(seed)
    embed = np.asfortranarray(rng.normal(0, 0.05, (1 << BUCKET_BITS, WIDTH)))
    out, bias = rng.normal(0, 0.3, (WIDTH, n_classes)), np.zeros(n_classes)
    steps, step = EPOCHS * -(-len(ids) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for at in range(0, len(ids), BATCH):
            chosen = order[at : at + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            counts = np.array([len(ids[i][0]) for i in chosen])
            flat, shares = (np.concatenate([ids[i][k] for i in chosen]) for k in (0, 1))
            mean = np.stack([T.segment_sums(embed[:, j][flat] * shares, counts) for j in range(WIDTH)], axis=1)
            error = _softmax(mean @ out + bias)
            error[np.arange(len(chosen)), labels[chosen]] -= 1
            back = error @ out.T
            out -= rate * (mean.T @ error) / len(chosen)
            bias -= rate * error.mean(axis=0) * 0.1
            for j in range(WIDTH):  # the mean makes a single bucket's share tiny: its rate is not divided by the batch
                embed[:, j] -= rate * np.bincount(flat, np.repeat(back[:, j], counts) * shares, len(embed))
    return np.asfortranarray(embed @ out, np.float32), bias


def shuffled(column: pa.Array, ids: pa.Array, seed: int = 0) -> pa.Array:
    """The texts with the letters of each word in another order: text of no language, of the same letters, for calibration. A text's order
    follows from its id, not from the rows beside it."""
    out = []
    for text, key in zip(column.to_pylist(), ids.to_pylist()):
        rng = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
        out.append(" ".join("".join(rng.permutation(list(w))) for w in (text or "").split()))
    return pa.array(out, pa.string())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 0) -> LanguageModel:
    """Fit on ``per_language`` labelled rows of each language of ``docs``; a fifth of them calibrates.

    Temperature minimises the log loss of that fifth. The rejection threshold is the score below which only ``COST`` of
    its rightly named rows lie, never over ``HIGHEST``. Besides, a text is rejected whose subwords are stranger than those of
    any language: halfway between the least familiar of that fifth and most of its texts with their letters shuffled, where
    these lie apart, and else at the former. Rows without id, label or letter are not learned from. Without usable rows the
    model knows no language.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("label")).where(F.col("text").rlike(r"\p{L}"))
    chosen = sampled_ids(rows.select("doc_id", "label"), per_language, seed)

    def shares(column: pa.Array) -> list[pa.Array]:
        split = [np.split(buckets.astype(np.int32), np.cumsum(counts)[:-1]) for buckets, counts in subwords(column)]
        ids, times = zip(*(np.unique(np.concatenate(x), return_counts=True) for x in zip(*split)))
        return [pa.array([x.astype(np.int16) for x in ids], pa.list_(pa.int16())), pa.array([x.astype(np.float32) / max(x.sum(), 1) for x in times], pa.list_(pa.float32())), pa.array([int(x.sum()) for x in times], pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "label", "kind", "ids", "shares", "n"]
        for batch in batches:
            for part in T.slices(batch, "text"):
                kind = np.where(part.column("hold").to_numpy(zero_copy_only=False).astype(bool), "hold", "learn")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(kind, pa.string()), *shares(part.column("text"))], names)
                held = part.filter(part.column("hold"))
                if len(held):
                    yield pa.RecordBatch.from_arrays([held.column("doc_id"), held.column("label"), pa.array(["noise"] * len(held)), *shares(shuffled(held.column("text"), held.column("doc_id")))], names)

    hold = (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(HOLD)) == 0).alias("hold")
    sample = rows.drop("label").join(bounded(chosen), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "label", hold, "text")
    kind = dict(rows.dtypes)["doc_id"]
    found = sample.mapInArrow(run, f"doc_id {kind}, label string, kind string, ids array<smallint>, shares array<float>, n long").where("size(ids) > 0").toArrow().sort_by([("doc_id", "ascending"), ("kind", "ascending")])
    if not found.num_rows:
        return LanguageModel()
    languages = sorted(set(found.column("label").to_pylist()))
    labels, kinds = np.searchsorted(languages, found.column("label").to_pylist()), np.array(found.column("kind").to_pylist())
    ids = [(np.asarray(i.values), np.asarray(x.values)) for i, x in zip(found.column("ids"), found.column("shares"))]
    counts = found.column("n").to_numpy()
    learn, hold, noise = (np.flatnonzero(kinds == k) for k in ("learn", "hold", "noise"))
    if len(hold) < 2 or not len(learn):  # too few rows to keep some apart
        learn = hold = np.flatnonzero(kinds != "noise")
    table, bias = train([ids[i] for i in learn], labels[learn], len(languages), seed)
    frequency = np.ones(len(table))
    for i in learn:
        frequency[ids[i][0]] += ids[i][1] * counts[i]
    table = np.asfortranarray(np.column_stack([table, np.log(frequency / frequency.sum())]), np.float32)
    means = np.stack([ids[i][1] @ table[ids[i][0]] for i in hold])
    logits = means[:, :-1] + bias
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(hold)), labels[hold]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == labels[hold]]
    threshold = min(HIGHEST, float(np.quantile(right, COST, method="lower"))) if len(right) else 0.0
    model = LanguageModel(languages, table, bias, temperature, threshold, float(np.median(means[:, -1])))
    own = model.familiarity(means[:, -1] * counts[hold], counts[hold]).min()
    strange = np.array([model.familiarity(ids[i][1] @ table[ids[i][0], -1] * counts[i], counts[i]) for i in noise])
    high = float(np.quantile(strange, 0.9)) if len(strange) else np.inf
    model.least = (own + high) / 2 if high < own else own - 0.1 * abs(own)
    return model


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row. A null text or one without a letter is ``und`` with score 0 and
    rejected; of languages that are equally likely the first by code point is named; repeated rows give repeated rows; very long
    texts are read whole; an empty table gives no rows; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                names, score, rejected = model.named(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that the model does not reject. Null, empty and letterless texts go; repeated rows stay or go
    alike; very long texts are read whole; no other column is read or changed, whatever its name; an empty table gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, text_col):
                yield part.filter(pa.array(~model.named(part.column(text_col))[2]))

    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
