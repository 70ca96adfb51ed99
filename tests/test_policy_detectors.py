import uuid

import numpy as np
import pandas as pd
import pytest
from bars import frame, series
from pyspark.sql import functions as F

from barflow.functions import ids, timegrid as G
from barflow.operators import detectors as D, policy as P
from barflow.streaming.kernel import SymbolState


def arrivals(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(120):
        t = int(rng.integers(max(0, i - 6), i + 3))
        rows.append(("A", "1m" if i < 80 else "5m", pd.Timestamp("2026-01-05") + pd.Timedelta(minutes=t), f"e{t}", i))
    return pd.DataFrame(rows, columns=["symbol", "interval", "ts", "event_id", "arrival"])


@pytest.mark.parametrize("seed", range(4))
def test_outcomes_match_the_row_by_row_state(spark, seed):
    rows, state, want = arrivals(seed), SymbolState(), []
    for r in rows.itertuples():
        want.append(state.outcome(r.interval, r.ts.timestamp(), r.event_id))
        if want[-1] == "processed":
            state.push(r.ts.timestamp(), r.event_id, 1.0, D.Limits())
    got = [r.outcome for r in P.outcomes(spark.createDataFrame(rows)).orderBy("arrival").collect()]
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_ids_that_come_again_with_newer_times(spark, seed):
    """What is processed depends on what was: judgements differ by several rounds."""
    rows, state, want = arrivals(seed), SymbolState(), []
    rows["event_id"] = [f"e{x}" for x in np.random.default_rng(seed).integers(0, 50, len(rows))]
    for r in rows.itertuples():
        want.append(state.outcome(r.interval, r.ts.timestamp(), r.event_id))
        if want[-1] == "processed":
            state.push(r.ts.timestamp(), r.event_id, 1.0, D.Limits())
    assert [r.outcome for r in P.outcomes(spark.createDataFrame(rows)).orderBy("arrival").collect()] == want


def test_redelivery_changes_nothing(spark):
    rows = arrivals(1)
    again = rows.assign(arrival=rows.arrival + 1000)
    processed = lambda df: {(r.event_id, r.interval) for r in P.outcomes(spark.createDataFrame(df)).where("outcome = 'processed' and interval = '5m'").collect()}
    tail = again[again.interval == "5m"]
    assert processed(rows) == processed(pd.concat([rows, tail]))


def test_missing_bars_round_half_to_even(spark):
    t = lambda s: pd.Timestamp("2026-01-05") + pd.Timedelta(seconds=s)
    rows = pd.DataFrame({"symbol": "A", "interval": "1m", "ts": [t(0), t(60), t(210), t(420)], "event_id": list("abcd"), "arrival": range(4)})
    assert [r.missing_bars for r in P.outcomes(spark.createDataFrame(rows)).orderBy("arrival").collect()] == [0, 0, 1, 3]


def test_uuid5_is_rfc_4122(spark):
    df = spark.createDataFrame([("a", "b"), ("é", "x:y"), ("", "")], "a string, b string")
    for r in df.select("a", "b", ids.uuid5(ids.NAMESPACE_DNS, F.col("a"), F.col("b")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{r.a}:{r.b}"))


def test_business_days(spark):
    days = pd.date_range("2026-01-01", periods=30)
    got = spark.createDataFrame(pd.DataFrame({"ts": days})).select("ts", G.add_business_days(F.col("ts"), 5).alias("x")).collect()
    for r in got:
        assert r.x.date() == (np.busday_offset(r.ts.date(), 5, roll="forward")).astype(object)


def test_zscore_is_winsorised(spark):
    rng = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 200)))
    close[150:] *= 1.5
    close[151:] *= 1.5
    b = series("A", 200).assign(close=close)
    limits = D.Limits()
    want, state = {}, D.ZScore(limits)
    for i in range(1, 200):
        if found := state.push(float(np.log(close[i] / close[i - 1]))):
            want[b.ts[i]] = found[0]
    got = {r.ts: r.det_zscore.score for r in D.return_zscore(frame(spark, b), limits).where("det_zscore is not null").collect()}
    assert set(got) == set(want) and len(want) >= 2
    assert all(got[t] == pytest.approx(abs(z)) for t, z in want.items())


def test_thresholds_and_severity(spark):
    b = series("A", 40).assign(close=[100.0] * 30 + [102.0, 102.0, 99.0] + [99.0] * 7, volume=[10] * 35 + [100, 10, 65, 10, 10])
    df = D.volume_median(D.return_threshold(frame(spark, b)))
    hits = [(x.det_return.anomaly_type, x.det_return.severity) for x in df.orderBy("ts").collect() if x.det_return]
    assert hits == [("price_spike", "medium"), ("price_drop", "high")]
    assert [x.det_volume.severity for x in df.orderBy("ts").collect() if x.det_volume] == ["medium", "low"]


def test_parameters_are_checked():
    for bad in (dict(return_limit=0), dict(volume_ratio=1.0), dict(z_least=200), dict(volume_least=100)):
        with pytest.raises(ValueError):
            D.Limits(**bad)
