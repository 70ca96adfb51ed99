import itertools
import re

import corpus_pipeline as C

import __spark_entry__ as entry


def test_stages_keep_columns_and_act(spark, docs, tmp_path, sf_dir):
    folder, now = str(tmp_path), docs
    counts = []
    for name, stage in C.STAGES:
        out = stage(spark, now, sf_dir)
        if name != "mixing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        counts.append(now.count())
    assert counts[0] < docs.count() and counts[1] < counts[0] and counts[2] <= counts[1] and counts[3] == counts[2]
    texts = [r.text for r in spark.read.parquet(f"{folder}/near_dedup").collect()]
    assert len(texts) == len(set(texts))
    left = {r.doc_id for r in now.collect()}
    assert 400 not in left
    clean = {r.doc_id for r in docs.where("lang is not null and length(text) > 60 and doc_id is not null").collect()}
    assert clean <= {r.doc_id for r in spark.read.parquet(f"{folder}/language_id").collect()}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + C.SHINGLE]) for i in range(max(1, len(words) - C.SHINGLE + 1))}


def test_near_duplicates_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    rows = {r.doc_id: shingles(r.text) for r in docs.collect()}
    left = {r.doc_id for r in C.near_dedup_stage(spark, docs, sf_dir).collect()}
    near = [(a, b) for a, b in itertools.combinations(sorted(rows), 2) if len(rows[a] & rows[b]) >= C.SIMILARITY * len(rows[a] | rows[b])]
    assert len(near) >= 5
    missed = [p for p in near if p[0] in left and p[1] in left]
    assert len(missed) <= 0.05 * len(near)
    alone = rows.keys() - {x for p in near for x in p}
    assert alone <= left  # what resembles nothing stays
    assert all(any(b == gone and a in rows for a, b in near) for gone in rows.keys() - left)  # the least id of a group stays


def test_empty_documents(spark, empty, sf_dir):
    for _, stage in C.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_registered(spark, sf_dir):
    names = entry.queries()
    assert "pipeline" in names and {f"op{i}" for i in range(1, 14)} <= {n.split("_")[0] for n in names}
    assert C.run(spark, sf_dir).count() > 0
