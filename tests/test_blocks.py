"""Long series in parts: the same rows as in one piece."""

import numpy as np
import pandas as pd
import pytest
from bars import frame, series
from pyspark.sql import Window, functions as F

from barflow.functions.blocks import in_blocks
from barflow.functions.sliding import Sorted
from barflow.operators import detectors as D, indicators as I, quality as Q


@pytest.fixture(scope="module")
def bars(spark):
    return frame(spark, pd.concat([series("HOT", 2600, 1), series("B", 30, 2)])).checkpoint()


def test_sorted_window_equals_numpy():
    rng, window, values = np.random.default_rng(0), Sorted(40), []
    for _ in range(600):
        x = None if rng.random() < 0.1 else float(np.round(rng.normal(), 1))
        window.push(x)
        values.append(x)
        kept = [v for v in values[-40:] if v is not None]
        if kept:
            m = np.median(kept)
            assert window.median() == pytest.approx(m) and window.deviation(m) == pytest.approx(np.median(np.abs(np.array(kept) - m)))


@pytest.mark.parametrize("size", [650, 1000])
def test_blocks_equal_whole_series(bars, size):
    whole = {(r.symbol, r.ts): r for r in I.indicators(bars).collect()}
    cut = in_blocks(bars, I.indicators, size=size)
    assert cut.columns == I.indicators(bars).columns
    got = cut.collect()
    assert len(got) == len(whole)
    for r in got:
        for n in I.FIELDS:
            assert (r[n] is None) == (whole[r.symbol, r.ts][n] is None) and (r[n] is None or r[n] == pytest.approx(whole[r.symbol, r.ts][n], rel=1e-9, abs=1e-9))


def test_robust_z_in_blocks_with_rows_behind(bars):
    rows = bars.withColumn("row", F.unix_timestamp("ts"))
    look = lambda x: Q.robust_z(x).withColumn("next", F.lead("log_return").over(Window.partitionBy("symbol").orderBy("ts")))
    whole = {(r.symbol, r.ts): (r.z, r.log_return, r.next) for r in look(rows).collect()}
    assert {(r.symbol, r.ts): (r.z, r.log_return, r.next) for r in in_blocks(rows, look, before=253, after=1, size=300).collect()} == whole
    closes = [r.close for r in bars.where("symbol = 'HOT'").orderBy("ts").collect()]
    r = pd.Series(np.log(closes)).diff()
    m = r.shift(1).rolling(252, min_periods=60).median()
    mad = r.shift(1).rolling(252, min_periods=60).apply(lambda w: np.nanmedian(np.abs(w - np.nanmedian(w))))
    z = ((r - m) / (1.4826 * mad)).to_numpy()
    got = np.array([np.nan if v[0] is None else v[0] for k, v in sorted(whole.items()) if k[0] == "HOT"])
    np.testing.assert_allclose(got, z, rtol=1e-9)


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_zscores_of_ranges_equal_one_walk(spark, partitions):
    rng, limits = np.random.default_rng(7), D.Limits(z_limit=2.2, z_window=60, z_least=20)
    rows = []
    for symbol, n in (("A", 40), ("HOT", 1500), ("Z", 1)):
        r = rng.normal(0, 0.01, n) * np.where(rng.random(n) < 0.08, 8, 1)
        rows += [(symbol, i, float(c)) for i, c in enumerate(100 * np.exp(np.cumsum(r)))]
    bars = spark.createDataFrame(rows, "symbol string, i long, close double").withColumn("ts", F.timestamp_seconds(F.col("i") * 60)).repartition(4)
    got = {(r.symbol, r.i): r.det_zscore.score for r in D.return_zscore(bars, limits, partitions).where("det_zscore is not null").collect()}
    want = {}
    for symbol in ("A", "HOT", "Z"):
        state, closes = D.ZScore(limits), [c for s, _, c in rows if s == symbol]
        for i in range(1, len(closes)):
            if hit := state.push(float(np.log(closes[i] / closes[i - 1]))):
                want[symbol, i] = abs(hit[0])
    assert len(want) > 40 and got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}
