import re

import numpy as np
import xxhash

from barflow.llm import near_dedup as N
from barflow.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_against_brute_force(docs, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in N.near_duplicates(docs).collect() if r.doc_id is not None}
    short = {r[0]: fingerprint(r[1]) for r in rows if r[0] is not None and r[0] != 500}
    assert all(got[d][0] == f"{f:016x}" for d, f in short.items())
    fps = {d: int(got[d][0], 16) for d in got}
    ids = sorted(fps)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {d: c for d, (_, c) in got.items()} == components(ids, edges)


def test_row_per_row_and_no_null_component(docs, rows):
    found = N.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert [r.component_id for r in found if r.doc_id is None] == [None]


def test_empty_table(empty):
    assert N.near_duplicates(empty).collect() == []


def test_every_pair_in_reach_shares_a_signature():
    rng = np.random.default_rng(1)
    for radius in (4, 7, 11):
        for _ in range(200):
            a = rng.integers(0, 1 << 63, dtype=np.uint64)
            b = a
            for bit in rng.choice(64, radius, replace=False):
                b ^= np.uint64(1 << int(bit))
            keys, index = N.signatures(np.array([a, b]), radius)
            order = np.argsort(keys, kind="stable")
            x, y, _ = N.linked(keys[order], np.array([a, b])[index[order]], radius)
            assert len(x) >= 1


def test_large_groups_give_spanning_links():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(np.array([base ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j)) for i in range(64) for j in range(i)]))
    keys, index = N.signatures(fps, 4)
    order = np.argsort(keys, kind="stable")
    a, b, _ = N.linked(keys[order], fps[index[order]], 4)
    assert len(set(components(fps.tolist(), zip(a.tolist(), b.tolist())).values())) == 1
    assert len(a) < 4 * 67 * len(fps)  # dense groups give a tree


def test_similarity_is_verified(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near, far = text.replace("w50 ", "v50 "), " ".join(f"w{i}" if i % 9 else f"u{i}" for i in range(100))
    df = spark.createDataFrame([(1, text), (2, near), (3, far), (4, text.upper())], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, 20, 5, 0.8).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(7, 7), (100, 101), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_components_of_many_chunks(spark, monkeypatch):
    from barflow.llm import components as K

    monkeypatch.setattr(K, "CHUNK", 7)
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (55, 2))]
    got = {r.node: r.root for r in K.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])
    assert K.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_string_ids_and_rows_of_one_id(spark):
    same, other = "the same words of a text " * 9, "wholly different words there are in this one " * 9
    rows = [("b", same, 1), ("a", same.upper(), 2), ("a", other, 3), ("a", other, 3), (None, other + "x", 4), (None, "no id and alone", 5)]
    df = spark.createDataFrame(rows, "doc_id string, text string, exact int")
    got = sorted((str(r.doc_id), r.text, r.exact) for r in N.representatives(df, 11, 5, 0.8).collect())
    assert got == sorted([("a", same.upper(), 2), ("a", other, 3), ("None", "no id and alone", 5)]) and N.representatives(df, 11, 5, 0.8).columns == df.columns
    assert {r.component_id for r in N.near_duplicates(df).where("doc_id = 'b'").collect()} == {"a"}


def jaccard_components(texts, radius, n, similarity):
    fps = {d: fingerprint(t, n) for d, t in texts.items()}
    sets = {d: {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for d, t in texts.items() for w in [t.split()]}
    near = lambda a, b: len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])
    return fps, components(texts, [(a, b) for a in texts for b in texts if a < b and (fps[a] ^ fps[b]).bit_count() <= radius and near(a, b)])


def test_links_of_a_dense_family_are_all_verified(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base, texts = [f"w{i}" for i in range(60)], {}
    for i in range(120):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(1, 4)), replace=False):
            words[at] = f"v{rng.integers(3)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    fps, expected = jaccard_components(texts, 20, 5, 0.8)
    assert 10 < len(set(expected.values())) < 110
    for block in (1024, 16):  # in one block, and in pairs of blocks
        monkeypatch.setattr(N, "_BLOCK", block)
        assert {r.doc_id: r.component_id for r in N.near_duplicates(df, 20, 5, 0.8).collect()} == expected


def test_equal_fingerprints_are_verified_too(spark):
    line, texts = " ".join(f"line{i}" for i in range(11)), {}
    for i in range(8):
        texts[i] = " ".join([line] * 40 + [f"own{i}x{k}" for k in range(60)])
    texts[8], texts[9] = texts[3].replace("own3x59", "other"), texts[5].upper()
    df = spark.createDataFrame([*texts.items(), (5, "another text of the same id"), (None, texts[2].replace("own2x59", "nameless"))], "doc_id long, text string")
    fps, expected = jaccard_components({d: t.lower() for d, t in texts.items()}, 11, 5, 0.8)
    assert len(set(fps.values())) < 4 and len(set(expected.values())) == 8
    got = N.near_duplicates(df, 11, 5, 0.8).where("doc_id is null or doc_id != 5").collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, c) for d, c in expected.items() if d != 5} | {(None, 2)}
