"""Packing: every id once and in place, no padding, windows filled by exact subset sums."""

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from barflow.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def check(pieces, texts, tokenizer, window):
    """All of what the contract asks of pieces; texts by id, ids unique."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, P.END]
        own = sorted(by_doc[doc], key=lambda r: r.start)
        assert {r.doc_tokens for r in own} == {len(ids)}
        got = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert got == ids and [r.start for r in own] == [0, *np.cumsum([len(r.ids) // 4 for r in own])[:-1]]
    for own in by_sequence.values():
        sizes = [len(r.ids) // 4 for r in sorted(own, key=lambda r: r.offset)]
        assert sorted(r.offset for r in own) == [0, *np.cumsum(sizes)[:-1]] and min(sizes) > 0
        assert sum(sizes) <= window and sum(sizes) & sum(sizes) - 1 == 0  # full, or a power of two


@pytest.mark.parametrize("window,pool", [(4096, 1 << 21), (64, 500)])
def test_every_id_once_without_padding(spark, docs, rows, tokenizer, window, pool):
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = P.packed(unique, PATH, window, pool=pool).collect()
    check(pieces, texts, tokenizer, window)
    whole = [r for r in pieces if r.start == 0 and r.doc_tokens < window]
    assert sum(len(r.ids) // 4 == r.doc_tokens for r in whole) >= (0.8 if window > 64 else 0.6) * len(whole)


def test_repeats_and_null_ids_are_documents(spark, docs, rows):
    got = Counter(r.doc_id for r in P.packed(docs, PATH).where("start = 0").collect())
    assert got == Counter(r[0] for r in rows)


def test_empty(spark, empty):
    assert P.packed(empty, PATH).count() == 0


def test_query(spark, sf_dir):
    got = P.op11_minimum_bin_slack(spark, sf_dir).collect()
    pieces = {(r.doc_id, r.start): r.ids for r in P.packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), PATH).collect()}
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in got} == {k: (len(v) // 4, zlib.crc32(v)) for k, v in pieces.items()}


def test_words_equal_whole_texts(tokenizer):
    rng = random.Random(4)
    bits = ["the", "The", "ÉCLAIR", "é", "é", "́", "ß", "Σ", "İ", "it's", "IT'S", "dogs'.", "x.", "x,", "x.,", "...", "3a.", "12", "日本", "a b", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "ÀÐÞ×ÿ$$$", "tion###", "x-y.", "b.'s", "c'.", "é!", "Ö\u0301a", "end<|endoftext|>", "a<|endoftext|>.", "<|x.", "\x1c", "\x0b", "🙂", "naïve,", "œuf", "×", "ª"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n", "\t ", "  "]) for _ in range(rng.randrange(12))) for _ in range(1500)] + [None, "", " "]
    encode = P.Encoder(PATH)
    ids, offsets = encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, text
    same, bounds = P.Encoder(PATH, by_word=False)(pa.array(texts, pa.string()))
    assert same.tolist() == ids.tolist() and bounds.tolist() == offsets.tolist()


def test_filled_finds_a_subset_if_there_is_one():
    rng = random.Random(2)
    for _ in range(400):
        lengths = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        counts, longest = P.filled(lengths, sorted(lengths, reverse=True), 32), max(lengths)
        sums = {sum(n * c for n, c in zip(lengths, x)) for x in product(*(range((n == longest), m + 1) for n, m in lengths.items()))}
        assert (counts is not None) == (32 in sums)
        if counts:
            assert sum(n * c for n, c in counts.items()) == 32 and counts[longest] and all(c <= lengths[n] for n, c in counts.items())


def test_lengths_that_fill_no_window_are_cut_at_its_edges():
    pool = P.Pool(64, 0)
    for doc in range(50):
        pool.add(doc, np.arange(40, dtype=np.uint32))
    pool.finish()
    sizes = Counter()
    for *_, ids, _, number, _ in pool.out:
        sizes[number] += len(ids)
    assert Counter(sizes.values()) == Counter({64: 31, 16: 1})
