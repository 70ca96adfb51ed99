import json
from collections import OrderedDict

import numpy as np
import pandas as pd
import pytest
from bars import frame, series
from pyspark.sql import functions as F

from barflow.operators import detectors as D, features as X, indicators as I
from barflow.sources import sinks as S
from barflow.streaming import bootstrap as B, enrich, sinks as T, vector as V
from barflow.streaming.kernel import FeatureState, SymbolState


@pytest.fixture
def arrivals(spark, tmp_path):
    b = pd.concat([series("A", 90, 1), series("B", 60, 2)]).reset_index(drop=True)
    b["event_id"] = b.symbol + b.groupby("symbol").cumcount().astype(str)
    b["arrival"] = b.groupby("symbol").cumcount() * 10
    twice = b[b.arrival % 300 == 0].assign(arrival=lambda x: x.arrival + 5)
    rows = pd.concat([b, twice]).sort_values("arrival")
    for i in range(3):  # three files, so three batches in order
        part = rows[(rows.arrival // 300) == i] if i < 2 else rows[rows.arrival >= 600]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.createDataFrame(b), str(tmp_path)


def test_stream_equals_batch(spark, arrivals):
    bars, folder = arrivals
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    enrich.enriched(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    assert {r.outcome: r.n for r in got.groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {"processed": 150, "duplicate": 5}
    names = ["return_1", "sma_20", "ema_12", "ema_26", "macd_signal", "rsi_14"]
    a = got.where("outcome = 'processed'").select("symbol", "ts", *names).orderBy("symbol", "ts").toPandas()
    b = I.indicators(bars).select("symbol", "ts", *names).orderBy("symbol", "ts").toPandas()
    pd.testing.assert_frame_equal(a, b, rtol=1e-9)


def test_sinks_run_twice_without_change(spark, arrivals):
    bars, folder = arrivals
    schema = spark.read.parquet(f"{folder}/in").schema
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for turn in (1, 2):
        T.append_once(read(), f"{folder}/table", [["event_id"]], f"{folder}/c{turn}").awaitTermination()
    assert spark.read.parquet(f"{folder}/table").count() == 150
    T.keep_latest(read(), f"{folder}/latest", f"{folder}/cl").awaitTermination()
    assert {r.symbol: r.event_id for r in T.latest_state(spark, f"{folder}/latest").collect()} == {"A": "A89", "B": "B59"}


def test_live_features_are_those_of_batch(spark):
    bars = X.with_gaps(frame(spark, series("AAA", 150, 3).drop(index=[70]))).orderBy("ts")
    want = {r.ts: r for r in X.features(bars).where("ready").collect()}
    state, got = FeatureState(), {}
    for r in bars.collect():
        found = state.push(r.ts.timestamp(), r.gap_before, (r.open, r.high, r.low, r.close, float(r.volume)), r.ts.weekday(), r.ts.month)
        if found:
            got[r.ts] = found
    assert 5 < len(got) and got.keys() == want.keys()
    for ts, found in got.items():
        assert found == {n: pytest.approx(want[ts][n], abs=1e-9) for n in X.NAMES}
    assert state.push(0.0, 0, (1.0, 1.0, 1.0, 1.0, 1.0), 0, 1) is None


def test_all_indicators_are_those_of_batch(spark):
    bars = frame(spark, series("AAA", 120, 4)).orderBy("ts")
    want, state = I.indicators(bars).orderBy("ts").collect(), SymbolState(interval="1d")
    for r in want:
        found, _ = state.push(r.ts.timestamp(), str(r.ts), r.close, D.Limits(), r.volume)
        assert {n: found[n] for n in I.FIELDS} == {n: r[n] if r[n] is None else pytest.approx(r[n], abs=1e-9) for n in I.FIELDS}


def test_fan_out_counts_what_it_drops(spark):
    rows = [("anomaly", "A", i) for i in range(7)] + [("bar", "A", 1), ("bar", "A", 3), ("bar", "B", 2)]
    latest, found, dropped = T.coalesced(spark.createDataFrame(rows, "event_type string, symbol string, ts int"), 4)
    assert {(r.symbol, r.ts) for r in latest.collect()} == {("A", 3), ("B", 2)} and [r.ts for r in found.collect()] == [6, 5, 4, 3] and dropped.first().dropped == 3


def plain_rows(n, seed):
    """(interval, ts, id, close, volume) with repeats, late rows, ids that come again and changes of interval."""
    rng = np.random.default_rng(seed)
    out, ts = [], 0.0
    for i in range(n):
        ts += float(rng.choice([60, 60, 60, 180, 0, -120]))
        out.append(("1m" if i < n * 0.7 else "5m", ts, f"e{i if rng.random() > 0.05 else max(0, i - 3)}", float(np.exp(rng.normal(0, 0.01 if rng.random() > 0.03 else 0.2)) * 100), float(rng.integers(0, 50) * (1 if rng.random() > 0.03 else 40))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_rows_equal_one_row_at_a_time(seed):
    limits, rng = D.Limits(return_limit=0.05, z_limit=2.5, volume_ratio=3.0), np.random.default_rng(seed)
    rows, one, state, at = plain_rows(700, seed), SymbolState(), V.new_symbol(), 0
    step = enrich.enrichment(limits).step
    while at < len(rows):
        part = rows[at : at + int(rng.integers(1, 90))]
        at += len(part)
        frame_ = pd.DataFrame([("A", pd.Timestamp(t, unit="s"), k, e, c, v) for k, t, e, c, v in part], columns=["symbol", "ts", "interval", "event_id", "close", "volume"])
        got = pd.DataFrame(step(state, frame_))
        for r, (kind, t, key, close, volume) in zip(got.to_dict("records"), part):
            outcome = one.outcome(kind, t, key)
            assert r["outcome"] == outcome
            if outcome == "processed":
                assert r["missing_bars"] == one.missing(t)
                values, found = one.push(t, key, close, limits, volume)
                assert all(np.isnan(r[n]) if values[n] is None else r[n] == pytest.approx(values[n], rel=1e-9, abs=1e-9) for n in (*I.FIELDS, "zscore"))
                assert [x["detector"] for x in r["found"]] == [x[0] for x in found]
                assert [y for x in r["found"] for y in list(x.values())[1:]] == [pytest.approx(y, rel=1e-9) if isinstance(y, float) else y for x in found for y in x[1:]]
        assert len(state["ids"]) <= V.MEMORY and len(state["closes"]) <= V.CLOSES and len(state["kept"]) <= limits.z_window


def test_feature_runs_equal_one_row_at_a_time():
    b = series("A", 220, 6)
    rng, state, one, at = np.random.default_rng(0), V.new_feature(), FeatureState(), 0
    b["gap_before"] = np.where(np.arange(len(b)) % 75 == 74, 2, 0)
    b = pd.concat([b, b.iloc[100:103]]).assign(event_id="x", interval="1d")  # the last three are stale
    step = enrich.featuring(2).step
    while at < len(b):
        part = b.iloc[at : at + int(rng.integers(1, 50))].reset_index(drop=True)
        at += len(part)
        got = pd.DataFrame(step(state, part))
        for r, s in zip(got.to_dict("records"), part.itertuples()):
            stale = one.last_ts is not None and s.ts.timestamp() <= one.last_ts
            want = one.push(s.ts.timestamp(), s.gap_before, (s.open, s.high, s.low, s.close, float(s.volume)), s.ts.weekday(), s.ts.month)
            assert r["status"] == ("stale" if stale else "not_ready" if want is None else "sampled_out" if one.seen % 2 else "ready")
            if r["status"] == "ready":
                assert {n: r[n] for n in X.NAMES} == {n: pytest.approx(want[n], rel=1e-8, abs=1e-10) for n in X.NAMES}


def test_least_recently_updated_goes_first():
    order = OrderedDict.fromkeys("abc")
    cold, gone = enrich.evicted(order, list("adaebad"), 3)
    # d pushes out b, e pushes out c, b pushes out d, d pushes out e
    assert cold == {"d": [1, 6], "e": [3], "b": [4]} and gone == {"c", "e"} and list(order) == ["b", "a", "d"]


def streamed(spark, bars, folder, **options):
    bars.write.parquet(f"{folder}/bars")
    stream = spark.readStream.schema(bars.schema).parquet(f"{folder}/bars")
    enrich.enriched(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_state_has_a_bound(spark, tmp_path):
    rows = [(f"s{i:02}", i, j) for j in range(2) for i in range(40)] + [("s39", 39, 2)]
    bars = spark.createDataFrame(rows, "symbol string, i int, j int").selectExpr("symbol", "timestamp_seconds(60 * (j * 40 + i)) ts", "'1m' interval", "concat(symbol, '-', j) event_id", "j * 40L + i arrival", "100.0D + j close", "1.0D volume")
    out = {r.event_id: r.return_1 for r in streamed(spark, bars, tmp_path, symbols=10, buckets=2).collect()}
    assert len(out) == 81 and all(out[f"s{i:02}-1"] is None for i in range(30))  # forgotten between its bars
    assert out["s39-2"] == 0.0 or out["s39-2"] == pytest.approx(1 / 101)
    held = spark.read.format("statestore").option("stateVarName", "recent").load(f"{tmp_path}/check")
    assert 0 < held.count() <= 10


def test_a_killed_job_goes_on_as_if_it_had_not_stopped(spark, tmp_path):
    b = pd.concat([series(s, 90, k) for k, s in enumerate("ABCD")]).reset_index(drop=True)
    b["n"] = b.groupby("symbol").cumcount()
    b = b.assign(event_id=b.symbol + b.n.astype(str), arrival=b.n, topic="bars", partition=(b.symbol > "B").astype(int)).sort_values(["partition", "n", "symbol"])
    b["offset"] = b.groupby("partition").cumcount()
    log = spark.createDataFrame(b[["topic", "partition", "offset", "symbol", "ts", "interval", "event_id", "arrival", "close"]].assign(volume=b.volume.astype(float), interval="1d"))
    whole = {r.event_id: r for r in streamed(spark, log, tmp_path / "whole").collect()}
    first = streamed(spark, log.where("offset < 70 + 41 * partition"), tmp_path / "first")
    offsets = B.committed(log.join(first.select("event_id"), "event_id", "left_semi"))
    assert {r.partition: (r.start, r.committed) for r in B.points(log, offsets, 60).collect()} == {0: (10, 70), 1: (51, 111)}
    assert B.points(log, offsets.limit(0)).where("start <> committed or start <> 0").isEmpty()
    assert json.loads(B.starting_offsets(offsets.where("partition = 0"), log)) == {"bars": {"0": 70, "1": -2}}
    history = B.history(log, offsets)
    assert history.count() == 181
    rest = streamed(spark, B.remaining(log, log, offsets), tmp_path / "rest", history=history)
    both = {r.event_id: r for r in first.unionByName(rest).collect()}
    assert both.keys() == whole.keys()
    for key, r in both.items():
        assert r.outcome == "processed" and all(r[n] is None and whole[key][n] is None or r[n] == pytest.approx(whole[key][n], rel=1e-9, abs=1e-12) for n in I.FIELDS)


def test_appends_read_only_the_folders_of_a_batch(spark, tmp_path):
    rows = spark.range(100).selectExpr("id event_id", "date_add(date'2026-01-01', int(id % 10)) day", "id v")
    for part in (rows, rows.where("id < 7"), rows.where("event_id % 10 = 3").unionByName(rows.selectExpr("event_id + 1000 event_id", "day", "v").where("event_id = 1003"))):
        S.append_absent(part, f"{tmp_path}/t", [["event_id"]], "day")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert table.count() == 101 and table.select("event_id").distinct().count() == 101
    pruned = S.within_folders(table, rows.where("event_id in (4, 14)"), "day")
    assert pruned.count() == 10 and len(pruned.select("_metadata.file_path").distinct().collect()) < len(table.select("_metadata.file_path").distinct().collect())
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString() or "PartitionFilters: [(day" in pruned._jdf.queryExecution().executedPlan().toString()
    assert S.within_folders(table, rows.withColumn("day", F.lit(None).cast("date")), "day").count() == 0


def test_roll_ups_hold_the_last_bars_and_bars_that_change(spark, tmp_path):
    rows = [(1, "a", "2026-01-05 09:10:00", 5.0), (2, "a", "2026-01-05 09:50:00", 7.0), (4, "a", "2026-01-05 09:55:00", 6.0), (3, "a", "2026-01-05 09:55:00", 9.0), (5, "b", "2026-01-05 09:59:00", 1.0), (6, "a", "2026-01-05 14:00:00", 8.0)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    for part in (df.where("event_id < 3"), df.where("event_id >= 3")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    T.keep_updated(T.rolled_up(stream, "ts", "1 hour", "2 hours", ["event_type"], "value", ["event_id"]), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = {(r.event_type, r.ts.hour): (r.open, r.high, r.low, r.close, r.volume) for r in T.updated(spark, f"{tmp_path}/out", ["event_type", "ts"]).collect()}
    assert got == {("a", 9): (5.0, 9.0, 5.0, 6.0, 4), ("b", 9): (1.0, 1.0, 1.0, 1.0, 1), ("a", 14): (8.0, 8.0, 8.0, 8.0, 1)}


def test_roll_up_of_the_events_holds_every_one(spark, sf_dir):
    from barflow.plans.streams import stream_rollup

    assert stream_rollup(spark, sf_dir).agg(F.sum("volume")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
