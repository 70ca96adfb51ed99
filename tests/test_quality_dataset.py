import datetime as dt

import numpy as np
import pandas as pd
import pytest
from bars import frame, series
from pyspark.sql import functions as F

from barflow.operators import backtest as B, dataset as D, evaluation as E, quality as Q

NOW = "2026-10-01 00:00:00"


def raw(symbol="AAA", n=120, seed=1):
    b = series(symbol, n, seed, start="2024-01-02", freq="B")
    local = pd.DatetimeIndex(b.ts + pd.Timedelta(hours=9, minutes=30)).tz_localize("America/New_York")
    df = pd.DataFrame({"symbol": symbol, "row": np.arange(2, n + 2), "raw_timestamp": [str(int(t.timestamp())) for t in local]})
    for c in ("open", "high", "low", "close", "volume"):
        df[f"raw_{c}"] = b[c].astype(str)
    return df


def codes(spark, df):
    out = Q.validated(spark.createDataFrame(df), F.lit(NOW).cast("timestamp")).collect()
    return {(r.symbol, r.row): list(r.issues) for r in out}


@pytest.mark.parametrize(
    "column,value,code",
    [("raw_open", "", "E001"), ("raw_close", "nan", "E001"), ("raw_high", "inf", "E001"), ("raw_timestamp", "x", "E002"), ("raw_timestamp", "1000", "E002"), ("raw_timestamp", "9999999999", "E002"), ("raw_low", "-1", "E003"), ("raw_volume", "-1", "E004"), ("raw_high", "0.01", "E005"), ("raw_volume", "0", "W102")],
)
def test_one_bad_cell_gives_one_code(spark, column, value, code):
    df = raw()
    df.loc[50, column] = value
    got = codes(spark, df)
    assert code in got["AAA", 52]
    others = [c for k, v in got.items() if k[1] not in (52, 53) for c in v]
    assert not others


def test_duplicates(spark):
    df = raw()
    df = pd.concat([df, df.iloc[[10]].assign(row=900), df.iloc[[20]].assign(row=901, raw_close="1.5", raw_low="1.0")])
    got = codes(spark, df)
    assert got["AAA", 12] == [] and got["AAA", 900] == ["E007"]
    assert got["AAA", 22] == ["E006"] == got["AAA", 901]


def test_calendar_gap_and_stale(spark):
    a, b, c = raw("A"), raw("B", seed=2), raw("C", seed=3)
    b = b.drop(index=[30, 31])
    for x in ("open", "high", "low", "close"):
        c.loc[60:65, f"raw_{x}"] = "50.0"
    got = codes(spark, pd.concat([a, b, c]))
    assert got["B", 34] == ["W103"] and all("W105" in got["C", 62 + i] for i in range(6))
    usable = Q.errors(spark.createDataFrame(pd.concat([a, b, c])), F.lit(NOW).cast("timestamp"))
    assert Q.gaps(usable, Q.calendar(usable)).count() == 2


def test_robust_z_against_pandas(spark):
    df = raw(n=400)
    got = Q.robust_z(Q.errors(spark.createDataFrame(df), F.lit(NOW).cast("timestamp"))).orderBy("ts").toPandas()
    r = np.log(got.close / got.close.shift())
    for i in (10, 59, 61, 120, 300, 399):
        past = r[max(0, i - 252) : i].dropna()
        if len(past) < 60:
            assert pd.isna(got.z[i])
        else:
            mad = (past - past.median()).abs().median()
            assert got.z[i] == pytest.approx((r[i] - past.median()) / (1.4826 * mad))


def test_clean_keeps_types_and_logs_removals(spark):
    df = raw()
    df.loc[5, "raw_close"] = "bad"
    rows = Q.validated(spark.createDataFrame(df), F.lit(NOW).cast("timestamp"))
    assert Q.clean(rows).count() == 119 and len(Q.clean(rows).columns) == 13
    log = Q.removed(rows).collect()
    assert [(r.row, r.codes, r.reasons, r.raw_close) for r in log] == [(7, "E001", "missing_value", "bad")]
    total = [r for r in Q.report(rows).collect() if r.symbol is None][0]
    assert (total.rows, total.kept, total.removed) == (120, 119, 1)


def test_daylight_saving(spark):
    df = spark.createDataFrame([("2024-03-08 14:30:00",), ("2024-03-11 13:30:00",)], "t string").select(F.from_utc_timestamp(F.col("t").cast("timestamp"), "America/New_York").alias("l"))
    assert {(r.l.hour, r.l.minute) for r in df.collect()} == {(9, 30)}


def test_labels_never_cross_a_gap(spark):
    b = frame(spark, series("A", 40)).withColumn("gap_before", F.when(F.dayofyear("ts") == 20, 1).otherwise(0)).withColumn("session_date", F.to_date("ts"))
    got = D.with_labels(b).orderBy("ts").toPandas()
    gap = int(np.flatnonzero(got.gap_before > 0)[0])
    none = set(np.flatnonzero(got.y_return.isna()))
    assert none == set(range(gap - 5, gap)) | set(range(35, 40))
    assert got.y_return[0] == pytest.approx(np.log(got.close[5] / got.close[0])) and got.label_end[0] == got.session_date[5]


def test_splits_are_purged(spark):
    b = frame(spark, series("A", 200), series("B", 200, 2)).withColumn("gap_before", F.lit(0)).withColumn("session_date", F.to_date("ts"))
    df, cut = D.with_labels(b), dt.date(2016, 4, 1)
    train, test = D.purged(df, F.lit("2016-04-01").cast("date"), 5)
    assert all(r.label_end <= cut for r in train.collect())
    assert min(r.session_date for r in test.collect()) == cut + dt.timedelta(days=6)
    folds = D.walk_forward(df, [2016]).groupBy("role").count().collect()
    assert {r.role for r in folds} <= {"train", "test"}


def test_auc_with_ties_and_metrics(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 8, 300) / 8
    df = spark.createDataFrame(pd.DataFrame({"y": y.astype(float), "s": s}))
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert E.roc_auc(df, "y", "s").first().roc_auc == pytest.approx(want)
    assert E.roc_auc(df.where("y = 1"), "y", "s").first().roc_auc is None
    p = np.clip(s, 1e-6, 1 - 1e-6)
    assert df.agg(E.log_loss(F.col("y"), F.col("s")).alias("l")).first().l == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
    m = E.classification(df.withColumn("c", (F.col("s") >= 0.5).cast("int")), "y", "c").first()
    assert m.accuracy == pytest.approx(np.mean((s >= 0.5) == (y == 1)))


def test_backtest_by_hand(spark):
    """One name held, then the other: gross 10 % and 4 %, turnover 1 and 2 at 10 bps."""
    d = [dt.date(2024, 1, k) for k in (1, 2)]
    rows = [("A", d[0], 2.0, float(np.log(1.10))), ("B", d[0], 1.0, 0.0), ("A", d[1], 1.0, 0.0), ("B", d[1], 2.0, float(np.log(1.04)))]
    df = spark.createDataFrame(rows, "symbol string, session_date date, score double, y_return double")
    got = B.periods(B.weights(B.rebalances(df, 1), "top_k", 1), 10.0).orderBy("session_date").collect()
    assert [[pytest.approx(x) for x in (r.gross, r.turnover, r.cost, r.net)] for r in got] == [[0.10, 1.0, 0.001, 0.099], [0.04, 2.0, 0.002, 0.038]]


@pytest.mark.parametrize("net,growth,down", [((0.1, -1.0, 0.1), 0.0, -1.0), ((0.1, -1.5, 0.2), -0.66, -1.6), ((-2.0, -2.0), 1.0, -2.0), ((0.1, 0.2), 1.32, 0.0)])
def test_losses_stay(spark, net, growth, down):
    rows = [(0, dt.date(2024, 1, k + 1), x, 0.0, 0.0, 0.0, x) for k, x in enumerate(net)]
    df = spark.createDataFrame(rows, "offset int, session_date date, net double, turnover double, exposure double, cost double, gross double")
    s = B.summary(df, 5).first()
    equity = np.cumprod(1 + np.array(net))
    assert s.growth == pytest.approx(growth) and s.max_drawdown == pytest.approx(down) == pytest.approx((equity / np.maximum.accumulate(np.concatenate([[1.0], equity]))[1:] - 1).min())
    assert s.annual_return == pytest.approx(growth ** (50.4 / len(net)) - 1 if growth > 0 else -1.0) and s.years == pytest.approx(len(net) / 50.4)


def test_leavers_are_closed(spark):
    d = [dt.date(2024, 1, k) for k in (1, 2, 3)]
    rows = [("A", d[0], 2.0, 0.0), ("B", d[1], 1.0, 0.0), ("B", d[2], 1.0, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, score double, y_return double")
    got = B.periods(B.weights(B.rebalances(df, 1), "buy_hold"), 0.0).orderBy("session_date").collect()
    assert [r.turnover for r in got] == [1.0, 2.0, 0.0]
    s = B.summary(B.periods(B.weights(B.rebalances(df.limit(1), 1), "buy_hold"), 0.0), 1).first()
    assert s.periods == 1 and s.growth is None
    with pytest.raises(ValueError):
        B.weights(df, "other")
