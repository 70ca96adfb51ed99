import pytest

from barflow.llm import mixing as M


def water_level(sizes, weights, most=3.0):
    total, target = sum(sizes), [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(total)
    while free:
        level = left / sum(weights[i] for i in free)
        over = {i for i in free if level * weights[i] > most * sizes[i] + 1e-9}
        if not over:
            for i in free:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        free -= over
    return target


def test_targets(spark):
    sizes = [("a", 1, 100), ("b", 1, 5), ("c", 1, 1), (None, 1, 400), ("d", 1, 30)]
    got = {r.source: r.target for r in M.targets(spark.createDataFrame(sizes, "source string, n long, source_size long")).collect()}
    want = water_level([100, 5, 1, 30, 400], [1, 2, 3, 1, 2])
    assert [got[s] for s in ("a", "b", "c", "d", None)] == pytest.approx(want)


def test_words_come_near_their_targets(docs, rows):
    got = M.mixed(docs).collect()
    assert sum(r.rows for r in got) == len(rows)
    by = {}
    for r in got:
        t = by.setdefault(r.source, [r.target, 0, 0])
        t[1] += r.copies * r.size
        t[2] = max(t[2], r.size)
        assert 0 <= r.copies <= 3 * r.rows
    for target, taken, largest in by.values():
        assert abs(taken - target) <= max(largest, 1)


@pytest.mark.parametrize("seed", range(5))
def test_small_sources_meet_their_targets_too(spark, seed):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {}
    for r in M.mixed(docs, seed=seed).collect():
        t = by.setdefault(r.source, [r.target, 0])
        t[1] += r.copies * r.size
        assert 0 <= r.copies <= 3 * r.rows
    for source, (target, taken) in by.items():
        assert abs(taken - target) <= max(0.01 * target, 128), source


def test_small_documents_make_up_for_large_ones_by_whole_copies(spark):
    sizes = [1000, 900] + [20] * 110
    rows = spark.createDataFrame([("s", str(i), float(n), 0.97, 3.0) for i, n in enumerate(sizes)], "stratum string, k string, size double, want double, most double")
    for seed in range(4):
        got = {r.k: r.copies for r in M.by_size(rows, len(sizes), seed).collect()}
        assert len(got) == len(sizes) and set(got.values()) <= {0, 1, 2, 3}
        assert abs(sum(n * got[str(i)] for i, n in enumerate(sizes)) - 0.97 * sum(sizes)) <= 20


def test_reruns_agree_whatever_the_partitions(docs):
    a = {(r.doc_id, r.source, r.size): r.copies for r in M.mixed(docs).collect()}
    assert a == {(r.doc_id, r.source, r.size): r.copies for r in M.mixed(docs.repartition(3, "text")).collect()}


def test_rounding_keeps_the_sum_and_the_mean(spark):
    rows = spark.range(600).selectExpr("'s' stratum", "cast(id as string) k", "double(1 + id % 37) size", "0.1 + (id % 8) / 10 p")
    want = sum((1 + i % 37) * (0.1 + (i % 8) / 10) for i in range(600))
    ups = 0
    for seed in range(5):
        got = M.pivotal(rows, 600, seed, fanout=16).collect()
        assert len(got) == 600 and {r.up for r in got} <= {0, 1}
        assert abs(sum(r.size * r.up for r in got) - want) <= 37
        ups += sum(r.up for r in got if int(r.k) % 8 == 0)
    assert 0.02 < ups / (5 * 75) < 0.25


def test_repeated_rows_are_materialised(docs):
    plan = {(r.doc_id, r.source, r.size): r.copies for r in M.mixed(docs).collect()}
    got = M.repeated(docs)
    assert got.columns == [*docs.columns, "copy"]
    assert got.count() == sum(plan.values())


def test_empty_table(empty):
    assert M.mixed(empty).count() == 0 and M.repeated(empty).count() == 0
