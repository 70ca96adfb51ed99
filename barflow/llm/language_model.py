"""Language-model scores by a hierarchical Pitman-Yor process with sampled seating."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from barflow.llm import text as T
from barflow.llm.sampling import remainder
from barflow.llm.session import checkpointed

#: Contexts: the FREQUENT commonest words, a class of the last three bytes for all other words, and the start of a text.
FREQUENT, CLASSES = 4095, 4096
CONTEXTS = FREQUENT + CLASSES + 1
#: Discount and strength of the context restaurants and of their parent; sweeps in all, and how many at the end are averaged.
DISCOUNT, STRENGTH, PARENT_DISCOUNT, PARENT_STRENGTH = 0.8, 1.0, 0.6, 1.0
SWEEPS, SAMPLES = 4, 2
#: Tokens of a block of documents, and of those that one bucket of words gathers, about.
BLOCK_TOKENS = 2_000_000
_END = np.uint64(0x5E0F7E87)
_EXACT = 32


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with one end after each text, the class of each token as a context, and each text's first token (n + 1)."""
    data, offsets = T.utf8(column)
    data = T.lower(data)
    starts, ends, first = T.words(data, offsets)
    n = len(first) - 1
    place = np.ones(len(starts) + n, bool)
    bounds = first + np.arange(n + 1)
    place[bounds[1:] - 1] = False
    words, classes = np.full(len(place), _END, np.uint64), np.zeros(len(place), np.int64)
    words[place] = T.word_hashes(data, starts, ends)
    last, second, third = (np.where(ends - starts > i, data[np.maximum(ends - 1 - i, 0)] if len(ends) else 0, 0).astype(np.int64) for i in range(3))
    classes[place] = FREQUENT + (last * 961 + second * 31 + third) % CLASSES
    return words, classes, bounds


def contexts(words: np.ndarray, classes: np.ndarray, bounds: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The context of each token: what the token before it stands for, or the start of the text."""
    own = classes
    if len(frequent) and len(words):
        at = np.minimum(np.searchsorted(frequent, words), len(frequent) - 1)
        own = np.where(frequent[at] == words, at, classes)
    out = np.empty(len(words), np.int64)
    out[1:] = own[:-1]
    out[bounds[:-1]] = CONTEXTS - 1
    return out


def block_pairs(texts: pa.Array, train: np.ndarray, frequent: np.ndarray):
    """Of a block: distinct words (sorted), contexts a word is seen in, those contexts, their training counts, and what maps
    tokens to pairs, with each text's first token."""
    parts = [(tokens(texts.slice(a, b - a)), a) for a, b in _ranges(texts)]
    words = np.concatenate([p[0] for p, _ in parts])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p, _ in parts]))])
    context = np.concatenate([contexts(*p, frequent) for p, _ in parts])
    distinct, word = np.unique(words, return_inverse=True)
    codes, pair = np.unique(word * CONTEXTS + context, return_inverse=True)
    learned = np.repeat(train, np.diff(bounds))
    times = np.bincount(pair[learned], minlength=len(codes))
    return distinct, np.bincount(codes // CONTEXTS, minlength=len(distinct)), codes % CONTEXTS, times, pair, bounds


def _ranges(texts: pa.Array) -> list[tuple[int, int]]:
    batch, out, at = pa.RecordBatch.from_arrays([texts], ["text"]), [], 0
    for part in T.slices(batch, "text"):
        out.append((at, at + len(part)))
        at += len(part)
    return out


def _stirling(discount: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t) for c, t below ``_EXACT``: the weight of all seatings of c customers at t tables."""
    s = np.full((_EXACT, _EXACT), -np.inf)
    s[0, 0] = 0.0
    for c in range(1, _EXACT):
        for t in range(1, c + 1):
            s[c, t] = np.logaddexp(s[c - 1, t - 1], s[c - 1, t] + np.log(c - 1 - discount * t) if c - 1 - discount * t > 0 else -np.inf)
    return s


def uniform(keys: np.ndarray, nth: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the keys and ``nth`` alone."""
    return ((T.mix(keys + np.uint64(nth * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def poisson(mean: np.ndarray, keys: np.ndarray, nth: int) -> np.ndarray:
    """Poisson numbers by inversion; of a mean of 30 or more, by its normal limit."""
    u, out = uniform(keys, nth), np.zeros(len(mean), np.int64)
    low = np.flatnonzero(mean < 30)
    p = np.exp(-mean[low])
    total, k = p.copy(), 0
    while len(left := np.flatnonzero(u[low] > total)) and k < 200:
        k += 1
        out[low[left]] += 1
        p = p * mean[low] / k
        total[left] += p[left]
    high = np.flatnonzero(mean >= 30)
    z = np.sqrt(-2 * np.log(u[high])) * np.cos(2 * np.pi * uniform(keys[high], nth + 1))
    out[high] = np.maximum(np.rint(mean[high] + np.sqrt(mean[high]) * z), 0)
    return out


def seat(customers: np.ndarray, strength: np.ndarray, mass: np.ndarray, total: np.ndarray | None, discount: float, keys: np.ndarray, stirling: np.ndarray) -> np.ndarray:
    """Tables of each dish, drawn given its customers and all else, its own tables taken away: a blocked Gibbs step.

    The i-th table that a dish opens, from 0, weighs (strength + discount * i) * (mass + i) / (total + i): the restaurant has so many more
    tables by then, and its parent so many more customers of the dish. Without ``total`` the parent's share stays at ``mass``. Up to 31 customers
    the number of tables is drawn from its exact conditional; further customers come in runs that double, whose new tables are
    Poisson with the sum of the customers' odds. Draws depend on the 64-bit ``keys`` of the dishes alone.
    """
    out = np.minimum(customers, 1).astype(np.int64)
    many = np.flatnonzero(customers > 1)
    if len(many) < len(customers):
        out[many] = seat(customers[many], strength[many], mass[many], None if total is None else total[many], discount, keys[many], stirling) if len(many) else 1
        return out

    def weight(at: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of the i-th new table of the dishes at ``at``."""
        column = (slice(None), None) if i.ndim == 2 else slice(None)
        share = mass[at][column] if total is None else (mass[at][column] + i) / (total[at][column] + i)
        return np.maximum((strength[at][column] + discount * i) * share, 1e-300)

    u = uniform(keys, 0)
    for c in range(2, _EXACT):
        at = np.flatnonzero(customers == c if c < _EXACT - 1 else customers >= c)
        if len(at):
            chance = stirling[c, 1 : c + 1] + np.log(weight(at, np.arange(c)[None, :])).cumsum(axis=1)
            chance = np.exp(chance - chance.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[at] = 1 + (u[at][:, None] * chance[:, -1:] > chance).sum(axis=1)
    k, nth = _EXACT - 1, 1
    while len(at := np.flatnonzero(customers > k)):
        until, new = np.minimum(customers[at], 2 * k), weight(at, out[at])
        low = np.maximum(k - discount * out[at], 0.1) + new
        out[at] += poisson(np.minimum(new * np.log1p((until - k) / low), (until - k).astype(float)), keys[at], nth)
        k, nth = 2 * k, nth + 2
    return np.minimum(out, customers)


#: Slots of a state's totals: tables of each context, then the parent's customers and tables. Before the first state's come the
#: customers of each context, training tokens and distinct words.
_STATE, _FIRST = CONTEXTS + 2, CONTEXTS + 2


def states(words: np.ndarray, context: np.ndarray, owner: np.ndarray, times: np.ndarray, totals: np.ndarray, seed: int = 0):
    """(tables by pair, customers and tables by word in the parent) at the start and after each sweep that ``totals`` allow.

    Every context is a restaurant, and all share one parent over words, whose own parent is uniform. A table of a context is
    a customer of the parent. ``words`` are hashes, ``owner`` each pair's place in them; ``totals`` hold those of all buckets for
    the states so far: so a draw depends on its word and context, not on how words and documents are dealt out.
    """
    low, high = _stirling(DISCOUNT), _stirling(PARENT_DISCOUNT)
    keys = T.mix(words[owner] ^ T.mix(context.astype(np.uint64) + np.uint64(seed * CONTEXTS)))
    tables = np.minimum(times, 1)
    guests = np.bincount(owner, tables, len(words)).astype(np.int64)
    parent = np.minimum(guests, 1)
    out = [(tables, guests, parent)]
    known = totals[CONTEXTS + 1] if len(totals) else 0
    for sweep in range((len(totals) - _FIRST) // _STATE if len(totals) else 0):
        held = totals[_FIRST + sweep * _STATE :][:_STATE]
        back = (PARENT_STRENGTH + PARENT_DISCOUNT * held[-1]) / (known + 1)
        # what a pair's or a word's own tables hold of the totals is taken away before they are drawn anew
        others = guests[owner] - tables
        mass = others - PARENT_DISCOUNT * np.minimum(parent[owner], others) + back
        tables = seat(times, STRENGTH + DISCOUNT * (held[:CONTEXTS][context] - tables), mass, PARENT_STRENGTH + held[-2] - tables, DISCOUNT, T.mix(keys + np.uint64(sweep)), low)
        guests = np.bincount(owner, tables, len(words)).astype(np.int64)
        parent = seat(guests, PARENT_STRENGTH + PARENT_DISCOUNT * (held[-1] - parent), np.full(len(words), 1 / (known + 1)), None, PARENT_DISCOUNT, T.mix(words + np.uint64(sweep)), high)
        out.append((tables, guests, parent))
    return out


def predictive(own: np.ndarray, context: np.ndarray, word: np.ndarray, parent: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """P(word | context) of pairs, averaged over the samples: ``own`` is what a pair's customers have left after discounts, on average,
    ``parent`` the same of each word (by sample) in the parent."""
    customers, known = totals[:CONTEXTS], totals[CONTEXTS + 1]
    p = own / (STRENGTH + customers[context])
    for s in range(SAMPLES):
        held = totals[_FIRST + (SWEEPS + 1 - SAMPLES + s) * _STATE :][:_STATE]
        top = (parent[:, s] + (PARENT_STRENGTH + PARENT_DISCOUNT * held[-1]) / (known + 1)) / (PARENT_STRENGTH + held[-2])
        p += ((STRENGTH + DISCOUNT * held[:CONTEXTS]) / (STRENGTH + customers))[context] * top[word] / SAMPLES
    return p


def _loaded(table: pa.Table):
    """A bucket's requests joined: the distinct words, each pair's context, word and times, and what maps requests to them."""
    load = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name).combine_chunks()]
    words, spans = load("words", np.uint64), load("spans", np.uint16)
    context, times = np.concatenate(load("contexts", np.uint16)).astype(np.int64), np.concatenate(load("times", np.uint32)).astype(np.int64)
    distinct, word = np.unique(np.concatenate(words), return_inverse=True)
    codes, pair = np.unique(np.repeat(word, np.concatenate(spans)) * CONTEXTS + context, return_inverse=True)
    count = np.bincount(pair, times, len(codes)).astype(np.int64)
    cuts = np.cumsum([len(x) for x in words])[:-1], np.cumsum([int(x.sum()) for x in spans])[:-1]
    return distinct, codes % CONTEXTS, codes // CONTEXTS, count, word, pair, cuts


def _totals(table: pa.Table, totals: np.ndarray, seed: int) -> np.ndarray:
    """What a bucket adds to the totals of the next state."""
    distinct, context, owner, count, *_ = _loaded(table)
    tables, guests, parent = states(distinct, context, owner, count, totals, seed)[-1]
    known = np.bincount(owner, count, len(distinct))
    first = [] if len(totals) else [np.bincount(context, count, CONTEXTS), [known.sum(), (known > 0).sum()]]
    return np.concatenate([*first, np.bincount(context, tables, CONTEXTS), [guests.sum(), parent.sum()]]).astype(float)


def _answers(table: pa.Table, totals: np.ndarray, seed: int) -> list[tuple[bytes, bytes, bytes]]:
    """What each request of a bucket asks for: its words' counts and parts in the parent, and its pairs' own parts."""
    distinct, context, owner, count, word, pair, (word_cut, pair_cut) = _loaded(table)
    # the last totals are those after the last sweep
    samples = states(distinct, context, owner, count, totals[: len(totals) - _STATE], seed)[-SAMPLES:]
    known = np.bincount(owner, count, len(distinct)).astype(np.int64)
    own = (count - DISCOUNT * np.mean([s[0] for s in samples], axis=0) * (count > 0)).astype(np.float32)
    parent = np.stack([guests - PARENT_DISCOUNT * parent for _, guests, parent in samples], axis=1).astype(np.float32)
    return [(known[w].tobytes(), parent[w].tobytes(), own[p].tobytes()) for w, p in zip(np.split(word, word_cut), np.split(pair, pair_cut))]


def scored(docs: DataFrame, seed: int = 0, block_tokens: int = BLOCK_TOKENS, common: int = FREQUENT) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of ``docs(doc_id, text, train)``.

    The model is learned from all rows with ``train``, over words by context: in blocks of documents the distinct
    (context, word) pairs are counted; the counts go to the words' buckets, where seating is sampled; the answers go back
    to the blocks, where every token is scored by the predictive probability averaged over the samples. What moves is one entry
    per distinct pair of a block. Totals of all buckets are summed up before every sweep, and draws are keyed by word and
    context, so that scores don't depend on ``block_tokens``. A word meets at most ``CONTEXTS`` contexts of each block. The
    ``common`` commonest words, ``FREQUENT`` at most, are contexts of their own.

    Null and empty texts are one token, the end. Without training rows every word is unknown. Repeated rows are scored each,
    very long texts whole; an empty table gives no rows; other columns are not read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text", F.coalesce("train", F.lit(False)).alias("train"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        total, parts = 0, []
        for batch in batches:
            for part in T.slices(batch, "text"):
                words, _, bounds = tokens(part.column("text"))
                total += len(words)
                learned = np.repeat(part.column("train").to_numpy(zero_copy_only=False).astype(bool), np.diff(bounds))
                parts.append(np.unique(words[learned], return_counts=True))
                if sum(len(x) for x, _ in parts) > 1_000_000:
                    parts = [out(parts)]
                    if len(parts[0][0]) > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in parts.pop()], ["word", "n"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in out(parts)], ["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], ["word", "n"])

    counted = checkpointed(rows.select("text", "train").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.where("word is null").agg(F.sum("n")).first()[0] or 0
    most = counted.where(F.col("word") != int(_END)).orderBy(F.desc("n"), "word").limit(min(common, FREQUENT)).select("word").toArrow().column("word").to_numpy()
    frequent = np.sort(most.view(np.uint64))
    blocks = buckets = max(1, -(-total // block_tokens))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def ask(block: tuple, table: pa.Table) -> pa.Table:
        texts, train = _text(table), table.column("train").to_numpy(zero_copy_only=False).astype(bool)
        words, spans, context, times, _, _ = block_pairs(texts, train, frequent)
        cuts = _cuts(words, buckets)
        ends = np.concatenate([[0], np.cumsum(spans)])
        out = [(block[0].as_py(), b, words[i:j].tobytes(), spans[i:j].astype(np.uint16).tobytes(), context[ends[i] : ends[j]].astype(np.uint16).tobytes(), times[ends[i] : ends[j]].astype(np.uint32).tobytes()) for b, (i, j) in enumerate(cuts) if j > i]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], ["block", "bucket", "words", "spans", "contexts", "times"])

    # one plan from here on: the documents are dealt out by block once, and so are the requests by bucket; Spark reuses both exchanges
    asked = rows.groupBy("block").applyInArrow(ask, "block int, bucket int, words binary, spans binary, contexts binary, times binary")

    def summed(before: DataFrame | None) -> DataFrame:
        """One row: the totals so far, and those of the next state."""

        def sum_up(bucket: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
            values = _totals(table.sort_by("block"), _told(told), seed) if len(table) else np.zeros(0)
            return pa.table({"slot": np.arange(len(values), dtype=np.int32), "value": values})

        if before is None:
            parts = asked.groupBy("bucket").applyInArrow(lambda bucket, table: sum_up(bucket, table, table.slice(0, 0)), "slot int, value double")
        else:
            parts = asked.groupBy("bucket").cogroup(told(before).groupBy("bucket")).applyInArrow(sum_up, "slot int, value double")
        sums = parts.groupBy("slot").agg(F.sum("value").alias("value")).groupBy()
        one = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda x: x["value"]).alias("next"))
        return one.withColumnRenamed("next", "totals") if before is None else before.crossJoin(F.broadcast(one)).select(F.concat("totals", "next").alias("totals"))

    def told(totals: DataFrame, name: str = "bucket") -> DataFrame:
        """The one row of totals for each bucket or block."""
        return spark_range(docs, blocks, name).crossJoin(F.broadcast(totals))

    def answer(bucket: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        known, parent, own = zip(*_answers(table, _told(told), seed)) if len(table) else ((), (), ())
        return pa.table([table.column("block"), table.column("bucket"), *(pa.array(x, pa.binary()) for x in (known, parent, own))], ["block", "bucket", "known", "parent", "own"])

    totals = summed(None)
    for _ in range(SWEEPS):
        totals = summed(totals)
    every = told(totals, "block")
    answers = asked.groupBy("bucket").cogroup(told(totals).groupBy("bucket")).applyInArrow(answer, "block int, bucket int, known binary, parent binary, own binary")
    answers = answers.withColumn("totals", F.lit(None).cast("array<double>")).unionByName(every, allowMissingColumns=True)

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _text(docs)
        if not len(texts):
            return pa.table([docs.column("doc_id"), *(pa.array([], t) for t in (pa.int64(),) * 3 + (pa.float64(),) * 3)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])
        _, spans, context, _, pair, bounds = block_pairs(texts, np.zeros(len(texts), bool), frequent)
        sums = np.array(answers.filter(pc.is_valid(answers.column("totals"))).column("totals")[0].as_py())
        n, v = sums[CONTEXTS : CONTEXTS + 2]
        answers = answers.filter(pc.is_valid(answers.column("bucket"))).sort_by("bucket")
        load = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in answers.column(name).combine_chunks()])
        known, parent, own = load("known", np.int64), load("parent", np.float32).reshape(-1, SAMPLES).astype(float), load("own", np.float32).astype(float)
        if len(own) != len(context):
            raise ValueError("the documents changed between two readings")
        word = np.repeat(np.arange(len(spans)), spans)
        p = predictive(own, context, word, parent, sums)
        counts = np.diff(bounds)
        base = np.log10((known + 1) / (n + v + 1))[word]
        sums = [T.segment_sums(x[pair], counts) for x in (np.log10(p), base)]
        hits = T.segment_sums((known > 0)[word][pair].astype(np.int64), counts)
        return pa.table([docs.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(hits), pa.array(np.full(len(counts), int(n))), pa.array(sums[1]), pa.array(sums[0]), pa.array(10 ** (-sums[0] / counts))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)


def spark_range(docs: DataFrame, n: int, name: str) -> DataFrame:
    """One column, from 0 to n - 1."""
    return docs.sparkSession.range(n).select(F.col("id").cast("int").alias(name))


def _told(table: pa.Table) -> np.ndarray:
    return np.array(table.column("totals")[0].as_py()) if len(table) else np.zeros(0)


def _text(table: pa.Table) -> pa.Array:
    column = table.column("text").combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _cuts(words: np.ndarray, buckets: int) -> list[tuple[int, int]]:
    """Ranges of sorted hashes that belong to each bucket: equal parts of the hash space."""
    edges = [np.uint64((k << 64) // buckets) for k in range(buckets)]
    at = [*np.searchsorted(words, np.array(edges, np.uint64)).tolist(), len(words)]
    return list(zip(at, at[1:]))


def op4_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    return scored(docs.withColumn("train", ~held_out)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES = {"op4_pitman_yor_scores": op4_pitman_yor_scores}
ORACLES: dict[str, str] = {}
