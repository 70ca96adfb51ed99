"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from barflow.llm import spelling as S


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute(counts, ratio=5):
    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    best = {a: min(near[a], key=lambda b: (-counts[b], b)) for a in counts if near[a]}
    form = {a: b for a, b in best.items() if counts[b] >= ratio * counts[a]}
    out = set()
    for a in counts:
        root = a
        while root in form:
            root = form[root]
        out.add((a, form.get(a), root, counts[a], len(near[a]), counts[form[a]] if a in form else None))
    return out


def edited(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abéz")
    return rng.choice([word[:i] + c + word[i + 1 :], word[:i] + c + word[i:], word[:i] + word[i + 1 :], word + c, c + word])


def family(seed):
    """Words of few syllables with edits of edits, repeated letters and ties."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(["an", "tion", "ing", "é", "aa", "b"]) for _ in range(rng.randint(3, 6))) for _ in range(120)}
    for _ in range(3):
        words |= {edited(rng, rng.choice(sorted(words))) for _ in range(150)}
    words |= {"a" * n for n in range(6, 12)} | {"ab" * n for n in range(3, 7)} | {"abcdef", "abcdeg", "bcdefg"}
    return {w: rng.choice([1, 1, 2, 5, 5, 10, 25, 130, 700]) for w in sorted(words) if len(w) >= 6}


@pytest.mark.parametrize("frequent", [1, 8, 200])
def test_groups_equal_brute_force(spark, frequent):
    counts = family(frequent)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in S.grouped(words, frequent=frequent).collect()} == brute(counts)


def test_long_words_are_compared_from_their_first_difference(spark, monkeypatch):
    monkeypatch.setattr(S, "SHORT", 0)
    counts = family(5)
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    assert {tuple(r) for r in S.grouped(words, frequent=8).collect()} == brute(counts)


def test_lists_are_short_and_cover_any_edit(spark):
    words = spark.createDataFrame([(i, w) for i, w in enumerate(family(3))], "id long, word string")
    cells = S.grams(words, frequent=4).collect()
    by_word = {k: list(v) for k, v in itertools.groupby(sorted(cells), lambda r: r.id)}
    for r in words.collect():
        own = by_word[r.id]
        assert [x.p for x in own] == list(range(len(r.word) + 1))
        assert all(f"^{r.word}$"[x.p :].startswith(x.gram) for x in own)
        assert all(x.covered == sum(y.p <= x.p < y.p + len(y.gram) for y in own) for x in own)
        assert max(x.covered for x in own) < len(own)


def test_documents_with_nulls_long_words_and_repeats(spark, docs, rows):
    long = "b" * 200_000
    more = spark.createDataFrame([(900 + i, t, "en", "s", 1, 1, "", "") for i, t in enumerate([f"{long} Éclair×ab éclair×ab"] * 5 + [f"{long}c"] * 25)], docs.schema)
    every = 7  # the table of the query has one damaged run in 199
    got = {tuple(r) for r in S.variants(docs.unionByName(more), every).collect()}
    counts = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc_id, text, *_ in [tuple(r) for r in docs.unionByName(more).select("doc_id", "text").collect()]:
        for run in re.findall("[a-zÀ-ÿ]+", (text or "").translate(low)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    assert got == brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def test_empty(spark, empty):
    assert S.variants(empty).count() == 0


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        S.grouped(spark.createDataFrame([("abc", 5)], "word string, n long"))
