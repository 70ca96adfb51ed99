import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from barflow.llm import langid as L, language_model as P, quality_model as Q, text as T
from barflow.llm.sampling import remainder


def test_crc_remainder(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.x for r in df.select("doc_id", remainder(F.col("doc_id"), 4).alias("x")).collect()}
    assert got == {**{i: zlib.crc32(str(i).encode()) % 4 for i in range(50)}, None: None}


def test_words_and_joined_match_a_regex():
    texts = [None, "", "  Ab\tcd\n\x0be ", "é à", "x", " ", "a  b"]
    data, offsets = T.utf8(pa.array(texts))
    starts, ends, first = T.words(data, offsets)
    found = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert found == want
    data, starts, ends = T.joined(data, starts, ends, first)
    assert [bytes(data[starts[i] : ends[j - 1]]).decode() for i, j in zip(first, first[1:]) if j > i] == [" ".join(w) for w in want if w]


def test_subwords_do_not_depend_on_neighbours():
    texts = ["the cat", None, "x", "", "  ein Haus ", "the cat"]
    whole = [np.split(b, np.cumsum(c)[:-1]) for b, c in L.subwords(pa.array(texts))]
    for i, t in enumerate(texts):
        alone = [b for b, c in L.subwords(pa.array([t]))]
        for n, parts in enumerate(whole):
            assert parts[i].tolist() == (alone[n].tolist() if n < len(alone) else [])


def test_languages_are_learned_and_noise_rejected(docs):
    model = L.fit(docs)
    assert model.languages == ["en", "fr"]
    got = {r.doc_id: r for r in L.predict(docs, model).collect()}
    truth = {r.doc_id: r.lang for r in docs.where("lang is not null and length(text) > 60 and doc_id is not null").collect()}
    assert np.mean([got[d].lang_pred == lang for d, lang in truth.items()]) > 0.97
    for d in (400, 401, 402, 502):
        assert got[d].lang_pred == "und" and got[d].score == 0 and got[d].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    assert not any(got[d].rejected for d in truth)
    rng = np.random.default_rng(3)
    letters = [" ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(30)) for _ in range(20)]
    noise = docs.sparkSession.createDataFrame([(9000 + i, t) for i, t in enumerate(letters)], "doc_id long, text string")
    assert all(r.rejected for r in L.predict(noise, model).collect())
    kept = {r.doc_id for r in L.accepted(docs, model).collect()}
    assert kept == {d for d, r in got.items() if not r.rejected}
    assert L.accepted(docs, model).columns == docs.columns


def test_digits_leave_letters_in_place(docs):
    model = L.fit(docs)
    cases = ["\u4eca\u65e5\u306f\u6771\u4eac\u3067\u65b0\u3057\u3044\u5e74\u306e\u4f1a\u8b70\u304c\u3042\u308a\u307e\u3057\u305f", "\u4eca\u65e5\u306f2024\u6771\u4eac\u3067\u65b0\u3057\u3044\u5e74\u306e\u4f1a\u8b70\u304c\u3042\u308a\u307e\u3057\u305f", "abc123 x9y8 k1", "sha256:deadbeef00 v1.2.3", "12 345"]
    names, score, rejected = model.named(pa.array(cases))
    assert rejected[0] and rejected[1] and rejected[4] and names[4] == "und"
    counts = [sum(c[i] for _, c in L.subwords(pa.array(cases))) for i in range(5)]
    assert min(counts[:4]) > 0 and counts[4] == 0
    same = lambda a, b: [x.tolist() for x, _ in L.subwords(pa.array([a]))] == [x.tolist() for x, _ in L.subwords(pa.array([b]))]
    assert same("the 2nd of7 May", "the nd of May")


def test_scores_are_a_softmax_of_mean_embeddings(docs):
    """Plain Python: every subword of every word, the mean of its rows, the bias, the temperature."""
    model = L.fit(docs)
    texts = ["The cat of 7 houses", "une maison", "x", "It is\nthat  la"]
    factors, names = L._FACTORS.tolist(), model.named(pa.array(texts))[0]
    for text, name, score in zip(texts, names, model.named(pa.array(texts))[1]):
        rows = []
        for word in re.sub("[0-9]", " ", text).lower().split():
            edged = f" {word} ".encode()
            for n in L.LENGTHS:
                for i in range(len(edged) - n + 1):
                    value = n * 0x2545F491
                    for k in range(n):
                        value += (edged[i + k] + 1) * factors[k]
                    value = value * 0x9E3779B1 & 0xFFFFFFFF
                    value = (value ^ value >> 15) * 0x85EBCA77 & 0xFFFFFFFF
                    rows.append(model.table[value >> 32 - L.BUCKET_BITS, :-1].astype(float))
        logits = (np.mean(rows, axis=0) + model.bias) / model.temperature
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        assert model.languages[p.argmax()] == name and abs(p.max() - score) < 1e-5


def test_noise_follows_from_the_id():
    texts, ids = pa.array(["the house of cards", "another text"]), pa.array([3, 9])
    both = L.shuffled(texts, ids).to_pylist()
    assert [L.shuffled(texts[i : i + 1], ids[i : i + 1])[0].as_py() for i in range(2)] == both


def test_no_labels_and_empty_tables(docs, empty):
    model = L.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert model.languages == [] and {r.lang_pred for r in L.predict(docs, model).collect()} == {"und"}
    assert L.predict(empty, L.fit(empty)).count() == 0


def test_factorisation_machine_by_pairs():
    m = Q.FactorisationMachine.blank(3)
    m.weights[:] = np.random.default_rng(1).normal(size=len(m.weights))
    text = pa.array(["a b c a", None, "one two, three?"])
    buckets, x, counts, table = Q.features(text, pa.array([7, None, 15]))
    z, _ = m.logits(buckets, x, counts, table)
    at, base = 0, 1 << Q.WORD_BITS
    for i, n in enumerate(counts):
        idx = np.concatenate([buckets[at : at + n], base + np.arange(table.shape[1])])
        val = np.concatenate([x[at : at + n], (table[i] - m.mean) / m.scale])
        want = m.bias + m.weights[idx] @ val + sum(m.factors[idx[a]] @ m.factors[idx[b]] * val[a] * val[b] for a in range(len(idx)) for b in range(a))
        assert z[i] == pytest.approx(want)
        at += n


def test_quality_is_learned(spark, docs, empty):
    bad = docs.where("doc_id < 240 and doc_id % 2 = 0").withColumn("text", F.concat_ws(" ### ", F.split("text", " ")))
    good = docs.where("doc_id is null or doc_id >= 240 or doc_id % 2 = 1")
    mixed = good.unionByName(bad)
    labels = mixed.where("doc_id < 240").selectExpr("doc_id", "int(doc_id % 2) quality").distinct()
    m = Q.fit(mixed.where("doc_id % 3 > 0 or doc_id is null"), labels)
    got = [(r.predicted, r.doc_id % 2) for r in Q.predict(mixed, m).collect() if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 3 == 0]
    assert np.mean([a == b for a, b in got]) > 0.75
    assert Q.predict(empty, m).count() == 0
    assert {r.score for r in Q.predict(docs, Q.fit(empty, labels.limit(0))).collect()} == {0.5}


def seatings(customers, discount):
    """Weight of each number of tables over all seatings of so many customers, by adding one customer at a time."""
    weight = {(): 1.0}
    for _ in range(customers):
        more = {}
        for sizes, w in weight.items():
            for i, n in enumerate(sizes):
                key = tuple(sorted((*sizes[:i], n + 1, *sizes[i + 1 :])))
                more[key] = more.get(key, 0.0) + w * (n - discount)
            key = tuple(sorted((*sizes, 1)))
            more[key] = more.get(key, 0.0) + w
        weight = more
    out = np.zeros(customers + 1)
    for sizes, w in weight.items():
        out[len(sizes)] += w
    return out


@pytest.mark.parametrize("customers,strength,mass,total", [(2, 3.0, 0.8, 20.0), (3, 0.7, 5.0, 9.0), (10, 4.0, 2.0, 50.0), (20, 9.0, 6.0, 60.0), (20, 5.0, 0.3, None)])
def test_tables_follow_the_exact_conditional(customers, strength, mass, total):
    """All seatings are enumerated; each table pays the restaurant's strength and the parent's share as they are when it is opened."""
    n, discount = 40_000, 0.5
    keys = T.mix(np.arange(n, dtype=np.uint64))
    full = lambda x: None if x is None else np.full(n, x)
    t = P.seat(np.full(n, customers), full(strength), full(mass), full(total), discount, keys, P._stirling(discount))
    weight = seatings(customers, discount)
    for tables in range(1, customers + 1):
        for i in range(tables):
            weight[tables] *= (strength + discount * i) * (mass if total is None else (mass + i) / (total + i))
    assert np.bincount(t, minlength=customers + 1) / n == pytest.approx(weight / weight.sum(), abs=0.01)


def test_many_customers_sit_at_fewer_tables():
    keys = T.mix(np.arange(6, dtype=np.uint64))
    many = P.seat(np.array([0, 1, 2, 31, 40, 5000]), np.full(6, 1.0), np.full(6, 0.3), np.full(6, 2.0), 0.5, keys, P._stirling(0.5))
    assert many[0] == 0 and many[1] == 1 and (many <= [0, 1, 2, 31, 40, 5000]).all()


def test_poisson_numbers():
    keys = T.mix(np.arange(40_000, dtype=np.uint64))
    for mean in (0.3, 4.0, 80.0):
        x = P.poisson(np.full(len(keys), mean), keys, 1)
        assert x.mean() == pytest.approx(mean, rel=0.03) and x.var() == pytest.approx(mean, rel=0.06)


def plain_model(texts, train, frequent):
    """The two-level model over dictionaries, with the same draws: P(word | context), words and contexts."""
    def split(t):
        words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))]
        return [(xxhash.xxh64_intdigest(w.encode()), w.encode()) for w in words] + [(int(P._END), None)]

    counts = {}
    for t, learned in zip(texts, train):
        for h, w in split(t) if learned else ():
            counts[h] = counts.get(h, 0) + 1
    common = sorted(sorted((h for h in counts if h != int(P._END)), key=lambda h: (-counts[h], h - (h >> 63 << 64)))[:frequent])

    def contexts(tokens):
        place = {h: i for i, h in enumerate(common)}
        byte = lambda w, i: w[-1 - i] if len(w) > i else 0
        own = [P.FREQUENT + P.CLASSES if w is None else place.get(h, P.FREQUENT + (byte(w, 0) * 961 + byte(w, 1) * 31 + byte(w, 2)) % P.CLASSES) for h, w in tokens]
        return [P.CONTEXTS - 1, *own[:-1]]

    times = {}
    for t, learned in zip(texts, train):
        if learned:
            tokens = split(t)
            for (h, _), c in zip(tokens, contexts(tokens)):
                times[h, c] = times.get((h, c), 0) + 1
    words, pairs = sorted(counts), sorted(times)
    place = {h: i for i, h in enumerate(words)}
    ids, owner, context = np.array(words, np.uint64), np.array([place[h] for h, _ in pairs]), np.array([c for _, c in pairs])
    n = np.array([times[x] for x in pairs])
    customers, found = np.bincount(context, n, P.CONTEXTS), np.concatenate([np.bincount(context, n, P.CONTEXTS), [n.sum(), len(words)]])
    for _ in range(P.SWEEPS + 1):
        state = P.states(ids, context, owner, n, found if len(found) > P._FIRST else np.zeros(0))[-1]
        found = np.concatenate([found, np.bincount(context, state[0], P.CONTEXTS), [state[1].sum(), state[2].sum()]])
    samples = P.states(ids, context, owner, n, found[: -P._STATE])[-P.SAMPLES :]

    def p(h, c):
        out = 0.0
        for tables, guests, parent in samples:
            i, j = place.get(h), pairs.index((h, c)) if (h, c) in times else None
            top = ((guests[i] - P.PARENT_DISCOUNT * parent[i] if i is not None else 0) + (P.PARENT_STRENGTH + P.PARENT_DISCOUNT * parent.sum()) / (len(words) + 1)) / (P.PARENT_STRENGTH + guests.sum())
            here = tables[context == c].sum()
            out += ((n[j] - P.DISCOUNT * tables[j] if j is not None else 0) + (P.STRENGTH + P.DISCOUNT * here) * top) / (P.STRENGTH + customers[c]) / P.SAMPLES
        return out

    return p, words, sorted(set(context.tolist())), lambda t: sum(np.log10(p(h, c)) for (h, _), c in zip(split(t), contexts(split(t))))


@pytest.mark.parametrize("frequent", [3, 4095])
def test_language_model_against_plain_python(spark, frequent):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"{'Wx'[k % 2]}{k}" for k in rng.zipf(1.6, 25) % 30) for _ in range(24)] + [None, "", "again and again and again"]
    train = [i % 5 != 1 for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, train)), "doc_id int, text string, train boolean")
    p, words, contexts, score = plain_model(texts, train, frequent)
    for c in contexts[:6]:
        assert sum(p(h, c) for h in words) + p(0, c) == pytest.approx(1)
    got = {r.doc_id: r.score for r in P.scored(df, block_tokens=100, common=frequent).collect()}
    assert got == {i: pytest.approx(score(t), rel=1e-5) for i, t in enumerate(texts)}
    assert {r.doc_id: r.score for r in P.scored(df, common=frequent).collect()} == {i: pytest.approx(x, rel=1e-5) for i, x in got.items()}


def test_language_model_contract(spark, docs, rows, empty):
    train = F.coalesce(remainder(F.col("doc_id"), 7) != 2, F.lit(True))
    got = P.scored(docs.withColumn("train", train), block_tokens=4000).collect()
    assert len(got) == len(rows)
    words = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    count = {}
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            for w in words(r[1]):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        own = words(text[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in count for w in own), n)
        assert r.base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in own))
        assert r.score < 0
    held = [r for r in got if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert P.scored(empty.withColumn("train", F.lit(True))).count() == 0

