import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions import ranks as R


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    return {"hot": rng.normal(size=5000).round(2), "a": rng.integers(0, 4, 300).astype(float), "b": np.array([7.0]), "c": np.array([1.0, 2.0]), "d": np.full(9, 3.0)}


@pytest.fixture(scope="module")
def cells(spark, values):
    rows = [("m", k, float(x)) for k, v in values.items() for x in v]
    return spark.createDataFrame(rows, "model string, feature string, value double").groupBy("model", "feature", "value").agg(F.count("*").alias("c"))


@pytest.mark.parametrize("parts", [2, 23])
def test_ranks_are_exact_over_ranges(spark, values, cells, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.ranked(cells, ["model", "feature"])
        assert got.select(F.spark_partition_id()).distinct().count() > 1
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == sum(len(set(v)) for v in values.values())
    for r in rows:
        v = values[r.feature]
        assert (r.upto, r.n, r.c) == ((v <= r.value).sum(), len(v), (v == r.value).sum())


@pytest.mark.parametrize("parts", [2, 4, 100])
def test_quantiles_equal_numpy(values, cells, parts):
    got = R.quantiles(R.ranked(cells, ["model", "feature"]), ["model", "feature"], parts).collect()
    assert {r.feature for r in got} == set(values)
    for r in got:
        np.testing.assert_allclose(r.quantiles, np.quantile(values[r.feature], np.arange(parts + 1) / parts), atol=1e-12)
        assert r.n == len(values[r.feature])


def test_no_values(cells):
    assert R.quantiles(R.ranked(cells.limit(0), ["model", "feature"]), ["model", "feature"]).count() == 0


@pytest.mark.parametrize("equal", [False, True])
@pytest.mark.parametrize("knots", [[], [1.0], [0.0, 0.0, 2.0, 5.0, 5.0, 5.0, 9.0], [x / 4 for x in range(101)]])
def test_bisection_counts_as_numpy(spark, knots, equal):
    x = [-1.0, 0.0, 0.1, 1.0, 2.0, 5.0, 9.0, 24.75, 25.0, 26.0]
    df = spark.createDataFrame([(knots, v) for v in x], "q array<double>, v double")
    got = {r.v: r.i for r in R.bisected(df, "i", "q", "v", equal=equal).collect()}
    assert list(map(got.get, x)) == np.searchsorted(knots, x, "right" if equal else "left").tolist()


def test_values_of_a_key_stay_where_they_are(spark, cells):
    """No join with a row a key brings all values of a key into one task."""
    from barflow.operators import monitoring as M

    keys = ["model", "feature"]
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        p = M.profile(cells, keys)
        for df in (R.ranked(cells, keys), M.binned(cells, p, keys), M.ks(R.ranked(cells, keys), p, keys)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
