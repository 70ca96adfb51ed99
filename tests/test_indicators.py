import numpy as np
import pandas as pd
import pytest
from bars import frame, series
from pyspark.sql import functions as F

from barflow.functions import rolling as R
from barflow.operators import features as X, indicators as I


def wilder(x, n):
    out = np.full(len(x), np.nan)
    v = x[~np.isnan(x)]
    skip = len(x) - len(v)
    if len(v) >= n:
        y = v[:n].mean()
        out[skip + n - 1] = y
        for i in range(n, len(v)):
            y = (y * (n - 1) + v[i]) / n
            out[skip + i] = y
    return out


def reference(b):
    c, v = b["close"], b["volume"]
    lr = np.log(c / c.shift())
    out = pd.DataFrame({"return_1": c.pct_change(), "log_return_1": lr, "price_change": c.diff(), "volume_change_pct": v.pct_change()})
    out["sma_20"] = out["bb_middle"] = c.rolling(20).mean()
    sd = c.rolling(20).std(ddof=0)
    out["bb_upper"], out["bb_lower"] = out.sma_20 + 2 * sd, out.sma_20 - 2 * sd
    out["bb_width"] = (out.bb_upper - out.bb_lower) / out.sma_20
    out["volatility_20"] = lr.rolling(20).std()
    out["volume_sma_20"] = v.rolling(20).mean()
    out["volume_ratio"] = v / out.volume_sma_20
    e12, e26 = c.ewm(span=12, adjust=False).mean(), c.ewm(span=26, adjust=False).mean()
    out["ema_12"], out["ema_26"] = e12.where(b.index >= 11), e26.where(b.index >= 25)
    macd = (e12 - e26)[25:]
    signal = macd.ewm(span=9, adjust=False).mean()
    out["macd"] = macd
    out["macd_signal"] = signal[8:]
    out["macd_hist"] = out.macd - out.macd_signal
    up, down = wilder(c.diff().clip(lower=0).to_numpy(), 14), wilder((-c.diff()).clip(lower=0).to_numpy(), 14)
    out["rsi_14"] = 100 - 100 / (1 + up / down)
    return out


def test_all_columns_against_pandas(spark):
    a, b = series("A", 900, 1), series("B", 700, 2)
    got = I.indicators(frame(spark, a, b)).orderBy("symbol", "ts").toPandas()
    for s, own in (("A", a), ("B", b)):
        want = reference(own)
        mine = got[got.symbol == s].reset_index(drop=True)
        for c in I.FIELDS:
            np.testing.assert_allclose(mine[c].astype(float), want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_flat_and_falling_prices(spark):
    flat = series("F", 40).assign(close=5.0)
    up = series("U", 40).assign(close=np.arange(1.0, 41.0))
    got = I.rsi(frame(spark, flat, up)).where("rsi_14 is not null").groupBy("symbol").agg(F.min("rsi_14").alias("a"), F.max("rsi_14").alias("b")).collect()
    assert {r.symbol: (r.a, r.b) for r in got} == {"F": (50.0, 50.0), "U": (100.0, 100.0)}


def test_slow_decay_is_refused(spark):
    with pytest.raises(ValueError):
        R.ema(frame(spark, series()), "close", "x", 200, ["symbol"], "ts")


def test_features_are_causal_and_reset_at_gaps(spark):
    b = series("A", 300)
    b = pd.concat([b[:150], b[153:]])
    df = X.with_gaps(frame(spark, b))
    whole = X.features(df).orderBy("ts").toPandas()
    assert whole.gap_before.max() == 3 and whole.segment.max() == 1
    assert whole[whole.bar_no <= 60].ready.sum() == 0 and whole[whole.bar_no >= 61].ready.all()
    cut = X.features(X.with_gaps(frame(spark, b[:200]))).orderBy("ts").toPandas()
    for c in X.NAMES:
        np.testing.assert_allclose(cut[c].astype(float), whole[c][:200].astype(float), rtol=1e-9, err_msg=c)


def test_atr_and_shape(spark):
    b = series("A", 80)
    got = X.features(frame(spark, b).withColumn("gap_before", F.lit(0))).orderBy("ts").toPandas()
    prev = b.close.shift()
    tr = (np.maximum(b.high, prev) - np.minimum(b.low, prev)).where(prev.notna())
    np.testing.assert_allclose(got.atr_14_norm.astype(float), wilder(tr.to_numpy(), 14) / b.close, rtol=1e-9)
    np.testing.assert_allclose(got.close_pos, (b.close - b.low) / (b.high - b.low), rtol=1e-9)


def test_weekday_gaps(spark):
    b = series("A", 5).assign(ts=pd.to_datetime(["2026-01-02", "2026-01-05", "2026-01-06", "2026-01-12", "2026-01-13"]))
    assert [r.gap_before for r in X.with_gaps(frame(spark, b), daily=True).orderBy("ts").collect()] == [0, 0, 0, 3, 0]


def test_array_median(spark):
    rows = [([3.0, 1.0],), ([5.0],), ([],), ([4.0, 1.0, 2.0],)]
    got = [r.m for r in spark.createDataFrame(rows, "x array<double>").select(R.array_median(F.col("x")).alias("m")).collect()]
    assert got == [2.0, 5.0, None, 2.0]


def test_one_shuffle_serves_all_indicators(spark):
    plan = I.indicators(frame(spark, series()).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 1 and "Python" not in plan


def test_window_over_symbols_has_no_single_partition(spark):
    plan = X.features(frame(spark, series()).withColumn("gap_before", F.lit(0)))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
