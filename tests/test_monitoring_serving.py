import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from bars import at
from pyspark.sql import functions as F

from barflow.operators import contract as C, models as M, monitoring as R, ops as O, serving as S
from barflow.sources import readers, sinks as K, schemas


def profile(x):
    edges = np.unique(np.quantile(x, np.arange(1, 10) / 10))
    return edges, np.bincount(np.searchsorted(edges, x, "left"), minlength=len(edges) + 1) / len(x), np.quantile(x, np.arange(101) / 100)


def test_profile_psi_and_ks(spark):
    rng = np.random.default_rng(0)
    ref, live = rng.normal(size=3000), rng.normal(0.4, 1.2, 800).round(1)
    rows = lambda x: spark.createDataFrame(pd.DataFrame({"feature": "f", "value": x}))
    p = R.profile(rows(ref), ["feature"])
    edges, shares, q = profile(ref)
    got = p.first()
    np.testing.assert_allclose(got.edges, edges)
    np.testing.assert_allclose(got.proportions, shares)
    np.testing.assert_allclose(got.quantiles, q)
    _, now, _ = edges, np.bincount(np.searchsorted(edges, live, "left"), minlength=10) / 800, q
    want = sum((max(a, 1e-4) - max(r, 1e-4)) * np.log(max(a, 1e-4) / max(r, 1e-4)) for a, r in zip(now, shares))
    d = R.drift(rows(live), p, ["feature"]).first()
    assert d.psi == pytest.approx(want) and d.status == R_status(want)
    s = np.sort(live)
    cdf = np.interp(s, q, np.arange(101) / 100, left=0, right=1)
    ks = max((np.arange(1, 801) / 800 - cdf).max(), (cdf - np.arange(800) / 800).max())
    assert d.ks == pytest.approx(ks) and d.ks_reject
    same = R.drift(rows(rng.normal(size=800)), p, ["feature"]).first()
    assert same.status == "ok" and not same.ks_reject
    assert R.drift(rows(live[:50]), p, ["feature"]).count() == 0


def R_status(x):
    return "ok" if x < 0.1 else "warning" if x < 0.25 else "alert"


def test_outcomes_resolve_once_and_never_late(spark):
    bars = spark.createDataFrame([("A", "1m", at(14, m), 100.0 + m) for m in range(10)], "symbol string, interval string, ts timestamp, close double")
    rows = [(f"p{m}", "A", "1m", at(14, m), at(14, m) + dt.timedelta(minutes=5), d, 0.0) for m, d in ((0, "up"), (1, "down"), (8, "up"))]
    preds = spark.createDataFrame(rows, "prediction_id string, symbol string, bar_interval string, ts timestamp, target_ts timestamp, predicted_direction string, predicted_return double")
    none = preds.limit(0).select("prediction_id")
    args = F.lit("2026-01-05 00:00:00").cast("timestamp"), F.lit("2026-01-05 20:00:00").cast("timestamp")
    got = {r.prediction_id: r for r in R.resolved(preds, bars, none, *args).collect()}
    assert set(got) == {"p0", "p1"} and got["p0"].actual_return == pytest.approx(np.log(1.05)) and got["p0"].is_correct and not got["p1"].is_correct
    done = spark.createDataFrame([("p0",), ("p1",)], "prediction_id string")
    assert R.resolved(preds, bars, done, *args).count() == 0


def test_pages_have_no_gap_and_no_overlap(spark):
    df = spark.range(25).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("A").alias("symbol"))
    seen, before = [], None
    while True:
        page = S.page(df, 10, before=before, symbol="A").collect()
        seen = [r.ts for r in page] + seen
        if page[0].next_before is None:
            break
        before = F.lit(page[0].next_before.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    assert seen == sorted(seen) and len(seen) == 25


def test_champion(spark):
    rows = [(1, "m", "v1", "champion"), (2, "m", "v2", "champion"), (3, "m", "v1", "archived"), (4, "n", "v1", "champion"), (5, "n", "v1", "archived")]
    df = spark.createDataFrame(rows, "id long, model_name string, model_version string, to_stage string").withColumn("created_at", F.current_timestamp())
    assert [(r.model_name, r.model_version) for r in S.champion(df).collect()] == [("m", "v2")]


def envelope(**changes):
    bar = dict(event_id="e", event_type="market.bar", schema_version=1, symbol="AAPL", timestamp="2026-01-05T14:30:00Z", interval="1m", open=100.0, high=101.5, low=99.5, close=101.0, volume=12345)
    return json.dumps({k: v for k, v in (bar | changes).items() if v is not ...})


CASES = [
    (envelope(), None), (envelope(extra=1), None), ("", "deserialization"), ("{", "deserialization"), ("[1]", "deserialization"), (None, "deserialization"), (envelope(event_type=...), "validation"),
    (envelope(schema_version=...), "validation"), (envelope(event_type="x"), "unknown_event_type"), (envelope(schema_version=9), "unknown_event_type"), (envelope(open=-1.0), "validation"), (envelope(high=50.0), "validation"),
    (envelope(low=200.0), "validation"), (envelope(volume=-1), "validation"), (envelope(symbol="aapl"), "validation"), (envelope(interval="7m"), "validation"), (envelope(timestamp="2026-01-05T14:30:00"), "validation"), (envelope(close="x"), "validation"),
]


def test_contract(spark):
    rows = [(b"AAPL" if i % 2 else None, None if v is None else v.encode(), "bars", 0, i) for i, (v, _) in enumerate(CASES)]
    log = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset long")
    df = C.decoded(log)
    assert {r.offset: r.reason for r in df.collect()} == {i: w for i, (_, w) in enumerate(CASES)}
    good, bad = C.split(df, log.columns)
    assert good.count() == 2 and bad.count() == len(CASES) - 2
    dead = C.dead_letters(bad.withColumn("error", F.repeat(F.lit("x"), 3000)), "g", F.current_timestamp()).collect()
    assert all(len(r.error_message) == 2000 and r.error_message.endswith("...") for r in dead)
    assert {r.routing_key for r in dead} == {"AAPL", "bars"}


def test_schemas_parse():
    for kind, version in schemas.EVENTS:
        assert schemas.schema(kind, version)["event_id"].dataType.simpleString() == "string"


def test_sinks_are_idempotent(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, v string")
    for batch in (df, df, df.unionByName(spark.createDataFrame([(3, "c")], "id int, v string"))):
        K.append_absent(batch, path, [["id"]])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_latest_only_moves_forward(spark):
    schema = "symbol string, ts timestamp, v int"
    old = spark.createDataFrame([("A", at(10), 1), ("B", at(10), 1), ("C", at(10), 1)], schema)
    new = spark.createDataFrame([("A", at(11), 2), ("B", at(9), 2), ("C", at(10), 2), ("D", at(1), 2)], schema)
    assert {r.symbol: r.v for r in K.latest(old, new).collect()} == {"A": 2, "B": 1, "C": 1, "D": 2}


def test_replay_skips_bad_rows(spark):
    rows = [("A", 1, at(9), 1.0, 2.0, 1.0, 1.5, 5), ("A", 2, at(8), 1.0, 2.0, 1.0, 1.5, 5), ("A", 3, at(10), 1.0, 0.5, 1.0, 1.5, 5), ("B", 1, at(9), 1.0, 2.0, 1.0, 1.5, 5), ("A", 4, at(11), 1.0, 2.0, 1.0, 1.5, 5)]
    df = spark.createDataFrame(rows, "symbol string, row int, ts timestamp, open double, high double, low double, close double, volume int")
    got = readers.replay(df, F.lit("2026-01-01 00:00:00").cast("timestamp"), 1.0).collect()
    assert [(r.batch, r.symbol) for r in got] == [(0, "A"), (0, "B"), (1, "A")]


def test_snapshot_refuses_a_changed_file(spark, tmp_path):
    import hashlib

    (tmp_path / "a.csv").write_text("x\n")
    lock = spark.createDataFrame([("a.csv", hashlib.sha256(b"x\n").hexdigest())], "path string, sha256 string")
    assert readers.snapshot(spark, str(tmp_path / "*.csv"), lock) == ["a.csv"]
    (tmp_path / "a.csv").write_text("y\n")
    with pytest.raises(ValueError):
        readers.snapshot(spark, str(tmp_path / "*.csv"), lock)


def test_lag(spark):
    committed = spark.createDataFrame([("g", "t", 0, 5)], "group string, topic string, partition int, offset long")
    bounds = spark.createDataFrame([("t", 0, 0, 9), ("t", 1, 2, 7), ("u", 0, 0, 3)], "topic string, partition int, low long, end long")
    assert {(r.topic, r.partition): r.lag for r in O.lag(committed, bounds).collect()} == {("t", 0): 4, ("t", 1): 5}


def test_nearest_rank_latency(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "x double")
    r = O.latency(df, "x").first()
    assert (r.p50, r.p90, r.p95, r.p99, r.max) == (5.0, 9.0, 10.0, 10.0, 10.0)


def test_gates(spark):
    good, weak, none = (0.68, 0.69, 0.68, 0.69), (0.68, 0.69, 0.6899, 0.69), (0.68, 0.69, None, 0.69)
    rows = [
        ("1", "champion", "fs", False, *good), ("2", "champion", "old", True, *good), ("3", "champion", "fs", True, *none), ("4", "archived", "old", False, *none), ("5", "challenger", "fs", False, *weak),
        ("6", "candidate", "fs", False, *none), ("7", "challenger", "fs", False, *none), ("8", "candidate", "old", True, *good),
    ]
    df = spark.createDataFrame(rows, "version string, to_stage string, feature_set_version string, override boolean, " + ", ".join(f"{c} double" for c in M.EVALUATION))
    got = M.gates(df, "fs")
    assert {(r.version, r.gate) for r in got.where("blocking").collect()} == {("2", "feature_set_compatible"), ("5", "beats_base_rate"), ("7", "has_evaluation"), ("8", "feature_set_compatible")}
    assert {r.gate for r in got.where("version = '6'").collect()} == {"feature_set_compatible"} and got.where("version = '7' and gate = 'beats_base_rate'").isEmpty()


def test_moves_and_displacement(spark):
    moves = [(None, "candidate"), (None, "champion"), ("archived", "candidate"), ("candidate", "champion"), ("champion", "challenger"), ("challenger", "candidate")]
    df = spark.createDataFrame(moves, "from_stage string, to_stage string")
    assert {(r.from_stage, r.to_stage) for r in M.bad_transitions(df).collect()} == {(None, "champion"), ("archived", "candidate"), ("champion", "challenger"), ("challenger", "candidate")}
    asked = spark.createDataFrame([("m", "v2", "candidate", "champion", "better", "ann"), ("n", "v5", None, "candidate", "new", "bob")], "model_name string, model_version string, from_stage string, to_stage string, reason string, actor string")
    held = spark.createDataFrame([("m", "v1", "champion"), ("m", "v0", "challenger"), ("n", "v4", "champion")], "model_name string, model_version string, stage string")
    got = {(r.model_version, r.from_stage, r.to_stage, r.reason) for r in M.promoted(asked, held, F.current_timestamp()).collect()}
    assert got == {("v2", "candidate", "champion", "better"), ("v5", None, "candidate", "new"), ("v1", "champion", "archived", "replaced by version v2: better")}


@pytest.mark.parametrize("order", [1, -1])
def test_of_equally_new_holders_the_last_moved_counts(spark, order):
    from barflow.operators import models as M

    rows = [(1, "m", "v3", "champion", at(9)), (7, "m", "v1", "champion", at(10)), (5, "m", "v2", "champion", at(10)), (9, "m", "v4", "archived", at(11)), (8, "m", "v0", "champion", at(8))]
    df = spark.createDataFrame(rows[::order], "id long, model_name string, model_version string, to_stage string, created_at timestamp").coalesce(1)
    assert [(r.stage, r.model_version) for r in M.holders(M.version_status(df)).collect()] == [("champion", "v1")]


def test_absent_keeps_the_least_row_and_null_keys(spark):
    from barflow.sources import sinks as K

    batch = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 5, "z"), ("b", 3, "w")], "k string, v int, w string")
    target = spark.createDataFrame([("b", 9, "q")], "k string, v int, w string")
    assert {(r.k, r.v) for r in K.absent(batch, target, [["k"]]).collect()} == {("a", 1), (None, 5)} and K.absent(batch, target, [["k"]]).count() == 3
    assert set(K.KEYS) == set(K.CHECKS)


def test_a_cycle_says_what_it_lacks(spark):
    from barflow.operators import monitoring as N, serving as S
    from barflow.sources import sinks as K

    bars = spark.range(300).selectExpr("'A' symbol", "'1h' interval", "timestamp'2026-01-05 00:00:00' + make_interval(0, 0, 0, 0, int(id)) ts", "100 + pmod(id * 37, 11) close")
    made = bars.selectExpr("concat('p', unix_seconds(ts)) prediction_id", "symbol", "interval bar_interval", "ts", "ts + interval 2 hours target_ts", "'up' predicted_direction", "0.1D predicted_return", "map('up', 0.6D, 'down', 0.4D) class_probabilities", "if(hour(ts) % 2 = 0, 'm0', 'm1') model_name", "map('x', close + 40) features")
    old = bars.selectExpr("'m0' model_name", "double(close) x", "to_date(ts) session_date", "0.6D p_up", "double(close > 104) y_up")
    profiles = N.reference_profile(old, ["x"], old, ["model_name"])
    none = made.selectExpr("prediction_id", "string(null) actual_direction", "boolean(null) is_correct").limit(0)
    new, found = N.cycle(made, bars, none, profiles, ["model_name"], F.lit("2026-01-17 00:00:00").cast("timestamp"), lookback="400 hours", span="400 hours", samples=50, resolved_least=50)
    got = {(r.report_type, r.model_name, r.metric_name, r.feature_name): r for r in found.collect()}
    assert new.count() == 287
    assert got["data_drift", "m0", "psi", "x"].status == "alert" and got["data_drift", "m0", "psi", "x"].threshold == 0.25
    again = got["operational", "m0", "retrain_recommended", None]
    assert again.status == "warning" and '"drifted_features":["x"]' in again.details and "1/1 features in alert" in again.details
    assert got["operational", "m1", "reference_profile_missing", None].status == "warning"
    assert ("prediction_drift", "m0", "psi", None) in got and not any(k[0] == "data_drift" and k[1] == "m1" for k in got)
    assert got["performance", "m1", "accuracy_minus_majority", None].status == "ok" and got["performance", "m1", "log_loss_minus_null", None].threshold == 0.01
    assert K.constrained(found, K.checks("monitoring_reports"))[1].isEmpty()
    summary = S.monitoring_summary(found.unionByName(found.withColumn("created_at", F.col("created_at") - F.expr("interval 1 day")))).first()
    assert summary.retrain and summary.ok + summary.warning + summary.alert == len(got) and (summary.window_end - summary.window_start).total_seconds() == 400 * 3600
    assert not S.monitoring_summary(found.where("metric_name <> 'retrain_recommended'")).first().retrain
