"""Queries of drift, outcomes, performance and serving, over derived hourly bars and predictions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barflow.functions import timegrid as G
from barflow.functions.ranks import ranked
from barflow.operators import detectors as D, indicators as I, monitoring as M, serving as S
from barflow.plans.common import rd, sql_stamp, sq, sqs, stamp, table
from barflow.plans.modelling import _DEPLOY, _UUID, deployments
from barflow.plans.stream_rules import _NUMBERED, numbered
from barflow.sources import sinks as K
from barflow.sources.bars import EVENT_SQL, event_bars
from barflow.sources.session import checkpointed

_SQL_NOW = "TIMESTAMP '2024-01-25'"


def _now():
    return F.lit("2024-01-25 00:00:00").cast("timestamp")

_MID = "2024-01-15"


# -- drift: line items before and after a date -------------------------------------------------------------------------------
def _values(spark, d):
    df = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_shipdate") >= "1997-01-01").alias("live"), "l_quantity", F.when(F.col("l_shipdate") >= "1997-01-01", F.col("l_extendedprice") * 1.3).otherwise(F.col("l_extendedprice")).alias("price"), "l_discount")
    return M.unpivoted(df, ["l_quantity", "price", "l_discount"], ["model", "live"])


def _split(spark, d):
    rows = _values(spark, d)
    profiles = M.profile(rows.where("not live").drop("live"), ["model", "feature"])
    return rows.where("live").drop("live"), profiles


_VALUES = """u AS (SELECT l_returnflag AS model, l_shipdate >= DATE '1997-01-01' AS live, f.feature, CASE f.feature WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount
    ELSE CASE WHEN l_shipdate >= DATE '1997-01-01' THEN l_extendedprice * 1.3::DOUBLE ELSE l_extendedprice END END AS value
  FROM lineitem, (VALUES ('l_quantity'), ('price'), ('l_discount')) AS f(feature)),
rf AS (SELECT model, feature, list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges, quantile_cont(value, list_transform(range(101), lambda x: x / 100)) AS quantiles, count(*) AS n
       FROM u WHERE NOT live GROUP BY 1, 2),
bn AS (SELECT u.model, u.feature, live, len(list_filter(edges, lambda e: e < value)) AS bin, count(*) AS c FROM u JOIN rf ON u.model = rf.model AND u.feature = rf.feature GROUP BY 1, 2, 3, 4),
pt AS (SELECT rf.model, rf.feature, i.b, coalesce(max(c) FILTER (NOT live), 0) / (SELECT sum(c) FROM bn x WHERE x.model = rf.model AND x.feature = rf.feature AND NOT live) AS r,
              coalesce(max(c) FILTER (live), 0) / (SELECT sum(c) FROM bn x WHERE x.model = rf.model AND x.feature = rf.feature AND live) AS a
       FROM rf JOIN (SELECT unnest(range(10)) AS b) i ON i.b <= len(edges) LEFT JOIN bn ON bn.model = rf.model AND bn.feature = rf.feature AND bn.bin = i.b GROUP BY rf.model, rf.feature, i.b),
ps AS (SELECT model, feature, sum((greatest(a, 1e-4) - greatest(r, 1e-4)) * ln(greatest(a, 1e-4) / greatest(r, 1e-4))) AS psi FROM pt GROUP BY 1, 2),
vc AS (SELECT model, feature, value, count(*) AS c FROM u WHERE live GROUP BY 1, 2, 3),
vd AS (SELECT vc.*, rf.quantiles AS q, sum(c) OVER (PARTITION BY vc.model, vc.feature ORDER BY value) AS hi, sum(c) OVER (PARTITION BY vc.model, vc.feature) AS n FROM vc JOIN rf ON vc.model = rf.model AND vc.feature = rf.feature),
ve AS (SELECT *, len(list_filter(q, lambda x: x <= value)) AS i FROM vd),
vf AS (SELECT *, CASE WHEN i = 0 THEN 0.0::DOUBLE WHEN i = 101 THEN 1.0::DOUBLE ELSE (i - 1 + (value - q[i]) / (q[i + 1] - q[i])) / 100 END AS cdf FROM ve),
kk AS (SELECT model, feature, max(greatest(hi / n - cdf, cdf - (hi - c) / n)) AS ks, max(n) AS n FROM vf GROUP BY 1, 2),
kl AS (SELECT *, (sqrt(n) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n)) * ks AS l FROM kk),
kp AS (SELECT model, feature, n, ks, CASE WHEN l < 0.2 THEN 1.0::DOUBLE ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0::DOUBLE * j * j * l * l))))) END AS p_value FROM kl),
md AS (SELECT model, feature, median(value) AS live_median FROM u WHERE live GROUP BY 1, 2),
dr AS (SELECT kp.model, kp.feature, kp.n, psi, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.25 THEN 'warning' ELSE 'alert' END AS status, ks, p_value, p_value < 0.001 AS ks_reject, live_median, quantiles[51] AS reference_median
       FROM kp JOIN ps ON kp.model = ps.model AND kp.feature = ps.feature JOIN md ON kp.model = md.model AND kp.feature = md.feature JOIN rf ON kp.model = rf.model AND kp.feature = rf.feature WHERE kp.n >= 200)"""


def mon_profile(spark, d):
    """Reference profiles: number of values and edges, quartiles, first and last bin."""
    _, p = _split(spark, d)
    return p.select("model", "feature", "n", F.size("edges").alias("n_edges"), *[rd(F.element_at("quantiles", k), 4, f"q{k - 1}") for k in (1, 26, 51, 76, 101)], rd(F.element_at("proportions", 1), 6, "first_bin"), rd(F.element_at("proportions", -1), 6, "last_bin"))


def mon_psi(spark, d):
    live, p = _split(spark, d)
    df = M.binned(live, p, ["model", "feature"]).join(p.select("model", "feature", F.col("proportions").alias("r")), ["model", "feature"])
    return df.select("model", "feature", rd(M.psi(F.col("proportions"), F.col("r")), 6, "psi"))


def mon_ks(spark, d):
    live, p = _split(spark, d)
    return M.ks(ranked(M.cells(live, ["model", "feature"]), ["model", "feature"]), p, ["model", "feature"]).select("model", "feature", "n", rd("ks", 6), rd("p_value", 6))


def mon_drift(spark, d):
    live, p = _split(spark, d)
    df = M.drift(live, p, ["model", "feature"])
    return df.select("report_type", "model", "feature", "n", rd("psi", 6), "status", rd("ks", 6), "ks_reject", rd("live_median", 4), rd("reference_median", 4))


# -- predictions on hourly bars ------------------------------------------------------------------------------------------------
def predictions(spark, d):
    """A prediction three hours ahead for every bar: direction and P(up) from the bar's number."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    df = event_bars(spark, d).withColumn("n", n).withColumn("p", (F.col("n") * 37 % 101) / 101)
    return df.select(
        F.concat_ws("-", "symbol", F.col("n").cast("string")).alias("prediction_id"), "symbol", F.col("interval").alias("bar_interval"), "ts", G.plus_seconds(F.col("ts"), F.lit(10_800)).alias("target_ts"),
        F.when(F.col("p") >= 0.5, "up").otherwise("down").alias("predicted_direction"), (F.col("p") - 0.5).alias("predicted_return"), F.create_map(F.lit("up"), F.col("p"), F.lit("down"), 1 - F.col("p")).alias("class_probabilities"),
        F.concat(F.lit("m"), F.col("n") % 2).alias("model_name"), "n",
    )


_PRED = f"""{EVENT_SQL},
pb AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM ev),
pd AS (SELECT symbol || '-' || n AS prediction_id, symbol, ts, ts + INTERVAL 3 HOUR AS target_ts, n, (n * 37 % 101) / 101 AS p, 'm' || (n % 2) AS model_name FROM pb),
oc AS (SELECT prediction_id, any_value(p) AS p, any_value(a.close) AS c0, arg_min(b.close, b.ts) AS c1
       FROM pd JOIN pb a ON a.symbol = pd.symbol AND a.ts = pd.ts JOIN pb b ON b.symbol = pd.symbol AND b.ts >= target_ts AND b.ts <= target_ts + (target_ts - pd.ts)
       WHERE target_ts > TIMESTAMP '2024-01-02' AND target_ts <= {_SQL_NOW} AND pd.n % 10 <> 0 GROUP BY 1),
ou AS (SELECT *, ln(c1 / c0) AS r, CASE WHEN ln(c1 / c0) > 0 THEN 'up' WHEN ln(c1 / c0) < 0 THEN 'down' ELSE 'neutral' END AS actual_direction FROM oc),
ov AS (SELECT *, CASE WHEN actual_direction <> 'neutral' THEN (p >= 0.5) = (actual_direction = 'up') END AS is_correct, abs(p - 0.5 - r) AS abs_error FROM ou)"""


def _outcomes(spark, d):
    p = predictions(spark, d)
    known = p.where("n % 10 = 0").select("prediction_id")
    return M.resolved(p, event_bars(spark, d), known, F.lit("2024-01-02 00:00:00").cast("timestamp"), _now())


def mon_outcomes(spark, d):
    return _outcomes(spark, d).select("prediction_id", rd("actual_return", 6), "actual_direction", "is_correct", rd("abs_error", 6))


def mon_window(spark, d):
    df = M.window(predictions(spark, d), _outcomes(spark, d), F.lit(f"{_MID} 00:00:00").cast("timestamp"), _now(), 500)
    return df.select("prediction_id", rd("p_up", 6), "actual_direction")


def mon_performance(spark, d):
    p = predictions(spark, d)
    rows = M.window(p, _outcomes(spark, d), F.lit("2024-01-01 00:00:00").cast("timestamp"), _now(), 1_000_000)
    base = spark.createDataFrame([("m0", 0.6)], "model_name string, base_rate double")
    df = M.performance(rows, base, ["model_name"])
    return df.select("model_name", "n", *[rd(c, 6) for c in ("log_loss", "null_log_loss", "accuracy", "majority", "excess", "edge")], "status")


def mon_retrain(spark, d):
    live, p = _split(spark, d)
    drifts = M.drift(live, p, ["model", "feature"])
    bad = spark.createDataFrame([("A", "alert"), ("R", "ok")], "model string, status string")
    df = M.retrain(drifts, bad, ["model"])
    return df.select("model", "drifted", "features", rd("share", 6), "drifted_features", "performance_alert", "retrain")


def mon_reports(spark, d):
    """A cycle's drift results as rows of the report table, with the versions that lack a profile; none breaks the table's checks."""
    live, p = _split(spark, d)
    found = M.drift(live, p, ["model", "feature"])
    df = M.reports(found, ["model"], "data_drift", "psi", F.col("psi"), F.col("status"), M.ALERT, F.col("feature"), [F.col("n"), F.col("ks_reject")])
    df = df.unionByName(M.missing_reports(live, p.where("model <> 'N'"), ["model"])).withColumns({"window_start": _now() - F.expr("interval 24 hours"), "window_end": _now(), "created_at": _now()})
    kept, broken = K.constrained(df, K.checks("monitoring_reports"))
    rows = kept.withColumn("kept", F.lit(True)).unionByName(broken.drop("broken").withColumn("kept", F.lit(False)))
    return rows.select("report_type", "model", "feature_name", "metric_name", "status", rd("value", 6), "threshold", F.get_json_object("details", "$.ks_reject").alias("ks_reject"), "kept")


# -- serving ---------------------------------------------------------------------------------------------------------------------
def srv_latest(spark, d):
    return S.latest_per(event_bars(spark, d), ["symbol"]).select("symbol", stamp("ts", "at"), rd("close", 2), "volume")


def srv_page(spark, d):
    """The page of 50 before a key, with the next key."""
    df = S.page(event_bars(spark, d), 50, before=F.lit("2024-01-20 00:00:00").cast("timestamp"), start=F.lit("2024-01-02 00:00:00").cast("timestamp"), symbol="click")
    return df.select(stamp("ts", "at"), rd("close", 2), stamp("next_before", "next_before"))


def srv_indicators_latest(spark, d):
    """Each symbol's newest indicators."""
    return S.latest_per(I.indicators(event_bars(spark, d)), ["symbol"]).select("symbol", stamp("ts", "at"), rd("return_1", 6), rd("sma_20", 4))


def srv_indicators_page(spark, d):
    """The page of 40 indicator rows of a symbol before a key."""
    df = I.bollinger(I.returns(event_bars(spark, d))).select("symbol", "ts", "return_1", "sma_20")
    df = S.page(df, 40, before=F.lit("2024-01-18 00:00:00").cast("timestamp"), symbol="view")
    return df.select(stamp("ts", "at"), rd("return_1", 6), rd("sma_20", 4), stamp("next_before", "next_before"))


def srv_anomalies(spark, d):
    """The 60 newest jumps before a time, of all symbols and of one."""
    found = D.anomalies(D.return_threshold(numbered(spark, d), D.Limits(return_limit=0.5)), ["det_return"])
    before, out = F.lit("2024-01-20 00:00:00").cast("timestamp"), None
    for symbol in (None, "click"):
        part = S.anomaly_feed(found, 60, symbol, before).select(F.lit(symbol or "all").alias("feed"), "anomaly_id", "symbol", stamp("ts", "at"), "anomaly_type", rd("score", 5))
        out = part if out is None else out.unionByName(part)
    return out


def srv_symbols(spark, d):
    """Symbols with a latest row, registered ones, and those of them that are active."""
    known = table(spark, d, "events").select(F.col("event_type").alias("symbol")).distinct().withColumn("is_active", F.col("symbol") != "view")
    quotes = S.latest_per(event_bars(spark, d).where("symbol <> 'click'"), ["symbol"])
    parts = {"quoted": S.active_symbols(quotes), "known": S.known_symbols(known).select("symbol"), "active": S.known_symbols(known, True).select("symbol")}
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("list"), "symbol")
        out = part if out is None else out.unionByName(part)
    return out


def _cycle(spark, d):
    """The reports of a cycle over predictions with two inputs: one model has a profile of the first half of the time, one has none."""
    df = I.volatility(I.returns(event_bars(spark, d))).select("symbol", "ts", "return_1", "volatility_20")
    made = predictions(spark, d).join(df, ["symbol", "ts"]).withColumn("features", F.create_map(F.lit("return_1"), "return_1", F.lit("volatility_20"), "volatility_20"))
    half = made.where(f"ts < timestamp'{_MID}'").withColumn("session_date", F.to_date("ts")).withColumn("p_up", F.col("class_probabilities")["up"]).withColumn("y_up", (F.col("return_1") > 0).cast("double"))
    own = half.where("model_name = 'm0'")
    profiles = M.reference_profile(own, ["return_1", "volatility_20"], own, ["model_name"])
    _, found = M.cycle(made, event_bars(spark, d), made.select("prediction_id").limit(0).selectExpr("prediction_id", "string(null) actual_direction", "boolean(null) is_correct"), profiles, ["model_name"], _now(), span="240 hours")
    return checkpointed(found)


def mon_cycle(spark, d):
    """All report rows of a cycle, with what their details say."""
    json = lambda path: F.get_json_object("details", f"$.{path}")
    return _cycle(spark, d).select(
        "report_type", "model_name", "metric_name", "feature_name", rd("value", 6), "threshold", "status", stamp("window_start", "window_start"), stamp("window_end", "window_end"), json("n").cast("long").alias("n"),
        rd(json("ks_statistic"), 6, "ks"), rd(json("live_median"), 5, "live_median"), rd(json("live_mean_p_up"), 6, "mean_p_up"), rd(json("null_log_loss"), 6, "null_log_loss"), rd(json("accuracy"), 6, "accuracy"), json("drifted_features").alias("drifted"),
    )


def srv_session(spark, d):
    df = S.session_stats(event_bars(spark, d), S.session_start(F.lit("2024-01-20 15:00:00").cast("timestamp"), "1h"))
    return df.select("symbol", "bars", "volume", *[rd(c, 4) for c in ("open", "high", "low", "close", "change", "change_pct")])


def srv_predictions(spark, d):
    df = S.with_outcomes(predictions(spark, d), _outcomes(spark, d)).orderBy(F.desc("ts"), "symbol").limit(100)
    return df.select("prediction_id", stamp("ts", "at"), "predicted_direction", "actual_direction", "is_correct")


def srv_open_prediction(spark, d):
    return S.open_predictions(predictions(spark, d), _now()).select("symbol", "prediction_id", stamp("target_ts", "target"))


def srv_champion(spark, d):
    return S.champion(deployments(spark, d)).select("model_name", "model_version", F.to_date("promoted_at").alias("promoted"))


def _reports(spark, d):
    """The reports of that cycle and of one an hour before, which had all its rows in alert."""
    found = _cycle(spark, d)
    return found.unionByName(found.withColumns({"created_at": F.col("created_at") - F.expr("interval 1 hour"), "status": F.lit("alert")}))


def srv_monitoring(spark, d):
    return S.monitoring_summary(_reports(spark, d)).select(stamp("created_at", "at"), stamp("window_start", "window_start"), "ok", "warning", "alert", "retrain")


def srv_drifted(spark, d):
    """Inputs in alert in the last of two cycles."""
    live, p = _split(spark, d)
    found = M.reports(M.drift(live, p, ["model", "feature"]), ["model"], "data_drift", "psi", F.col("psi"), F.col("status"), M.ALERT, F.col("feature"), [F.col("n")]).withColumn("created_at", _now())
    before = found.withColumns({"created_at": _now() - F.expr("interval 1 hour"), "status": F.lit("alert")})
    return S.drifted(S.monitoring_cycle(found.unionByName(before))).select("model", "feature_name", rd("value", 6))


def srv_summary(spark, d):
    """Every event type or nation with its latest quote."""
    quotes = S.latest_per(I.returns(event_bars(spark, d)), ["symbol"])
    names = table(spark, d, "nation").select(F.col("n_name").alias("symbol"))
    df = S.summaries(names, event_bars(spark, d).select("symbol").distinct(), quotes)
    return df.select("symbol", stamp("ts", "at"), rd("close", 2), rd("change_pct", 4))


def srv_detail(spark, d):
    bars = event_bars(spark, d)
    latest = S.latest_per(bars, ["symbol"])
    ind = S.latest_per(I.bollinger(bars).where("hour(ts) % 2 = 0").select("symbol", "ts", "sma_20"), ["symbol"])
    df = S.detail(latest, ind, S.session_stats(bars, F.lit("2024-01-25 00:00:00").cast("timestamp")), S.open_predictions(predictions(spark, d), _now()), _now())
    return df.select("symbol", stamp("ts", "at"), rd("sma_20", 4), rd("session_change", 4), "predicted_direction", stamp("as_of", "as_of"), rd("age_s", 1), "stale")


def srv_status(spark, d):
    b = event_bars(spark, d)
    rows = b.select(F.lit("bars").alias("stage"), "symbol", "ts", "interval").unionByName(b.where("symbol <> 'view' or ts < '2024-01-10'").select(F.lit("indicators").alias("stage"), "symbol", "ts", "interval"))
    now = F.lit("2024-01-31 02:00:00").cast("timestamp")
    return S.stage_status(rows, now).select("stage", stamp("last", "last"), "status", "stale_symbols")


def srv_watchlist(spark, d):
    quotes = S.latest_per(event_bars(spark, d), ["symbol"]).select("symbol", "close")
    items = table(spark, d, "events").select((F.col("user_id") % 5).cast("string").alias("user_id"), F.col("event_type").alias("symbol"), F.col("event_id").alias("position"), F.col("ts").alias("added_at"))
    return S.watchlist(items, quotes, "3").select("position", "symbol", rd("close", 2))


def srv_chart(spark, d):
    b = event_bars(spark, d).select("symbol", "ts", "close")
    live = b.where("hour(ts) = 5").withColumn("close", F.col("close") + 1)
    ind = I.returns(event_bars(spark, d)).select("symbol", "ts", "return_1")
    return S.chart(b, ind, live).select("symbol", stamp("ts", "at"), rd("close", 2), rd("return_1", 6))


def srv_newest(spark, d):
    b = S.latest_per(event_bars(spark, d), ["symbol"]).select("symbol", "ts", "close")
    live = b.withColumn("ts", F.when(F.col("symbol") == "click", F.col("ts") - F.expr("interval 1 hour")).otherwise(F.col("ts"))).withColumn("close", F.lit(0.0))
    return S.newest_of(live, b).select("symbol", rd("close", 2))


def srv_track_record(spark, d):
    rows = S.with_outcomes(predictions(spark, d), _outcomes(spark, d))
    return S.track_record(rows, ["model_name"]).select("model_name", "resolved", "pending", rd("hit_rate", 6), rd("majority_rate", 6))


QUERIES = {q.__name__: q for q in (srv_indicators_latest, srv_indicators_page, srv_anomalies, srv_symbols, mon_cycle, mon_profile, mon_psi, mon_ks, mon_drift, mon_outcomes, mon_window, mon_performance, mon_retrain, mon_reports, srv_latest, srv_page, srv_session, srv_predictions, srv_open_prediction, srv_champion, srv_monitoring, srv_drifted, srv_summary, srv_detail, srv_status, srv_watchlist, srv_chart, srv_newest, srv_track_record)}
_LAST = "lt AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"
_W = "(PARTITION BY symbol ORDER BY ts)"
_IND = f"{EVENT_SQL}, ir AS (SELECT symbol, ts, (close - lag(close) OVER w) / lag(close) OVER w AS return_1, CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) END AS sma_20 FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
_CYCLE = f"""{_PRED.replace("target_ts > TIMESTAMP '2024-01-02'", f"target_ts > {_SQL_NOW} - INTERVAL 336 HOUR").replace(" AND pd.n % 10 <> 0", "")},
ix AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS return_1, ln(close / lag(close) OVER w) AS lr FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
iy AS (SELECT symbol, ts, return_1, CASE WHEN count(lr) OVER w = 20 THEN stddev_samp(lr) OVER w END AS volatility_20 FROM ix WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
mk AS (SELECT pd.*, return_1, volatility_20, pd.ts > {_SQL_NOW} - INTERVAL 240 HOUR AND pd.ts <= {_SQL_NOW} AS live, pd.ts < DATE '{_MID}' AS half FROM pd JOIN iy USING (symbol, ts)),
u AS (SELECT model_name AS model, live, f.feature, CASE f.feature WHEN 'return_1' THEN return_1 WHEN 'volatility_20' THEN volatility_20 ELSE p END AS value
      FROM mk, (VALUES ('return_1'), ('volatility_20'), ('p_up')) AS f(feature) WHERE model_name = 'm0' AND (live OR half) AND CASE f.feature WHEN 'return_1' THEN return_1 WHEN 'volatility_20' THEN volatility_20 ELSE p END IS NOT NULL),
{_VALUES[_VALUES.index("rf AS (") :]},
br AS (SELECT avg(CASE WHEN return_1 IS NOT NULL THEN (return_1 > 0)::INT END) AS b FROM mk WHERE half AND model_name = 'm0'),
pf AS (SELECT model_name, mk.p, CASE WHEN model_name = 'm0' THEN (SELECT b FROM br) ELSE 0.5::DOUBLE END AS b, (actual_direction = 'up')::INT AS y FROM mk JOIN ou USING (prediction_id) WHERE live AND actual_direction IN ('up', 'down')),
pg AS (SELECT model_name, count(*) AS n, avg(-(y * ln(greatest(p, 1e-6)) + (1 - y) * ln(1 - greatest(p, 1e-6)))) - avg(-(y * ln(b) + (1 - y) * ln(1 - b))) AS excess, avg(-(y * ln(b) + (1 - y) * ln(1 - b))) AS null_log_loss,
              avg(((p >= 0.5) = (y = 1))::INT) AS accuracy, greatest(avg(y), 1 - avg(y)) AS majority FROM pf GROUP BY 1 HAVING count(*) >= 100),
rp AS (
  SELECT CASE WHEN feature = 'p_up' THEN 'prediction_drift' ELSE 'data_drift' END AS report_type, model AS model_name, 'psi' AS metric_name, CASE WHEN feature <> 'p_up' THEN feature END AS feature_name, psi AS value, 0.25::DOUBLE AS threshold, status, n,
         CASE WHEN feature <> 'p_up' THEN ks END AS ks, CASE WHEN feature <> 'p_up' THEN live_median END AS live_median, CASE WHEN feature = 'p_up' THEN (SELECT avg(p) FROM mk WHERE live AND model_name = 'm0') END AS mean_p_up, NULL::DOUBLE AS null_log_loss, NULL::DOUBLE AS accuracy, NULL AS drifted FROM dr
  UNION ALL SELECT 'performance', model_name, 'log_loss_minus_null', NULL, excess, 0.01, CASE WHEN excess > 0.01 THEN 'alert' ELSE 'ok' END, n, NULL, NULL, NULL, null_log_loss, accuracy, NULL FROM pg
  UNION ALL SELECT 'performance', model_name, 'accuracy_minus_majority', NULL, accuracy - majority, NULL, 'ok', n, NULL, NULL, NULL, NULL, accuracy, NULL FROM pg
  UNION ALL SELECT 'operational', 'm1', 'reference_profile_missing', NULL, 1, NULL, 'warning', NULL, NULL, NULL, NULL, NULL, NULL, NULL WHERE EXISTS (SELECT 1 FROM mk WHERE live AND model_name = 'm1')
  UNION ALL SELECT 'operational', m.model_name, 'retrain_recommended', NULL, 1, 0.3, 'warning', NULL, NULL, NULL, NULL, NULL, NULL, concat('[', coalesce(d.which, ''), ']')
  FROM (VALUES ('m0'), ('m1')) AS m(model_name)
  LEFT JOIN (SELECT model AS model_name, count(*) FILTER (status = 'alert') / count(*) AS share, string_agg(concat('"', feature, '"'), ',' ORDER BY feature) FILTER (status = 'alert') AS which FROM dr WHERE feature <> 'p_up' GROUP BY 1) AS d USING (model_name)
  LEFT JOIN pg USING (model_name) WHERE coalesce(d.share, 0) >= 0.3 OR coalesce(pg.excess, 0) > 0.01)"""
ORACLES = {
    "srv_indicators_latest": f"WITH {_IND} SELECT symbol, {sql_stamp('ts', 'at')}, {sq('return_1', 6)}, {sq('sma_20', 4)} FROM ir QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1",
    "srv_indicators_page": f"WITH {_IND}, t AS (SELECT * FROM ir WHERE symbol = 'view' AND ts < TIMESTAMP '2024-01-18' ORDER BY ts DESC LIMIT 40) SELECT {sql_stamp('ts', 'at')}, {sq('return_1', 6)}, {sq('sma_20', 4)}, CASE WHEN (SELECT count(*) FROM t) = 40 THEN strftime((SELECT min(ts) FROM t), '%Y-%m-%d %H:%M:%S') END AS next_before FROM t",
    "srv_anomalies": f"""WITH {_NUMBERED}, r AS (SELECT symbol, ts, event_id, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM nb), k AS (SELECT *, CASE WHEN r > 0 THEN 'price_spike' ELSE 'price_drop' END AS anomaly_type FROM r WHERE abs(r) > 0.5 AND ts < TIMESTAMP '2024-01-20'),
h AS (SELECT *, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(event_id || ':return_threshold:' || anomaly_type)) AS h FROM k), a AS (SELECT *, {_UUID} AS anomaly_id FROM h), f AS (SELECT 'all' AS feed, * FROM a UNION ALL SELECT 'click', * FROM a WHERE symbol = 'click')
SELECT feed, anomaly_id, symbol, {sql_stamp('ts', 'at')}, anomaly_type, {sq('abs(r)', 5, 'score')} FROM f QUALIFY row_number() OVER (PARTITION BY feed ORDER BY ts DESC, anomaly_id) <= 60""",
    "srv_symbols": "SELECT DISTINCT l.list, event_type AS symbol FROM events, (VALUES ('quoted', 'click'), ('known', ''), ('active', 'view')) AS l(list, without) WHERE event_type <> without",
    "mon_profile": f"WITH {_VALUES}, f AS (SELECT model, feature, max(r) FILTER (b = 0) AS fb, arg_max(r, b) AS lb FROM pt GROUP BY 1, 2) SELECT rf.model, rf.feature, n, len(edges) AS n_edges, {', '.join(sq(f'quantiles[{k}]', 4, f'q{k - 1}') for k in (1, 26, 51, 76, 101))}, {sq('fb', 6, 'first_bin')}, {sq('lb', 6, 'last_bin')} FROM rf JOIN f USING (model, feature)",
    "mon_psi": f"WITH {_VALUES} SELECT model, feature, {sq('psi', 6)} FROM ps",
    "mon_ks": f"WITH {_VALUES} SELECT model, feature, n::BIGINT AS n, {sq('ks', 6)}, {sq('p_value', 6)} FROM kp",
    "mon_drift": f"WITH {_VALUES} SELECT 'data_drift' AS report_type, model, feature, n::BIGINT AS n, {sq('psi', 6)}, status, {sq('ks', 6)}, ks_reject, {sq('live_median', 4)}, {sq('reference_median', 4)} FROM dr",
    "mon_outcomes": f"WITH {_PRED} SELECT prediction_id, {sq('r', 6, 'actual_return')}, actual_direction, is_correct, {sq('abs_error', 6)} FROM ov",
    "mon_window": f"WITH {_PRED}, t AS (SELECT * FROM pd WHERE ts > DATE '{_MID}' AND ts <= {_SQL_NOW} ORDER BY ts DESC, prediction_id LIMIT 500) SELECT prediction_id, {sq('t.p', 6, 'p_up')}, actual_direction FROM t LEFT JOIN ov USING (prediction_id)",
    "mon_performance": f"""WITH {_PRED}, t AS (SELECT model_name, pd.p, CASE WHEN model_name = 'm0' THEN 0.6 ELSE 0.5 END::DOUBLE AS b, (actual_direction = 'up')::INT AS y FROM pd JOIN ov USING (prediction_id) WHERE actual_direction IN ('up', 'down') AND ts > DATE '2024-01-01' AND ts <= {_SQL_NOW}),
g AS (SELECT model_name, count(*) AS n, avg(-(y * ln(greatest(p, 1e-6)) + (1 - y) * ln(1 - greatest(p, 1e-6)))) AS log_loss, avg(-(y * ln(b) + (1 - y) * ln(1 - b))) AS null_log_loss, avg(((p >= 0.5) = (y = 1))::INT) AS accuracy, greatest(avg(y), 1 - avg(y)) AS majority FROM t GROUP BY 1 HAVING count(*) >= 100),
h AS (SELECT *, log_loss - null_log_loss AS excess, accuracy - majority AS edge FROM g) SELECT model_name, n, {sqs({c: 6 for c in ("log_loss", "null_log_loss", "accuracy", "majority", "excess", "edge")})}, CASE WHEN excess > 0.01 THEN 'alert' ELSE 'ok' END AS status FROM h""",
    "mon_retrain": f"""WITH {_VALUES}, g AS (SELECT model, count(*) FILTER (status = 'alert') AS drifted, count(*) AS features, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (status = 'alert'), '') AS drifted_features FROM dr GROUP BY 1)
SELECT model, drifted, features, {sq('drifted / features', 6, 'share')}, drifted_features, model = 'A' AS performance_alert, drifted / features >= 0.3 OR model = 'A' AS retrain FROM g""",
    "mon_cycle": f"""WITH {_CYCLE} SELECT report_type, model_name, metric_name, feature_name, {sq('value', 6)}, threshold, status, '2024-01-15 00:00:00' AS window_start, '2024-01-25 00:00:00' AS window_end, n::BIGINT AS n,
{sq('ks', 6)}, {sq('live_median', 5)}, {sq('mean_p_up', 6)}, {sq('null_log_loss', 6)}, {sq('accuracy', 6)}, drifted FROM rp""",
    "mon_reports": f"WITH {_VALUES} SELECT 'data_drift' AS report_type, model, feature AS feature_name, 'psi' AS metric_name, status, {sq('psi', 6, 'value')}, 0.25::DOUBLE AS threshold, ks_reject::VARCHAR AS ks_reject, true AS kept FROM dr UNION ALL SELECT 'operational', model, NULL, 'reference_profile_missing', 'warning', 1.0, NULL, NULL, true FROM u WHERE live AND model = 'N' GROUP BY model",
    "srv_latest": f"WITH {EVENT_SQL}, {_LAST} SELECT symbol, {sql_stamp('ts', 'at')}, {sq('close', 2)}, volume FROM lt",
    "srv_page": f"WITH {EVENT_SQL}, t AS (SELECT * FROM ev WHERE symbol = 'click' AND ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC LIMIT 50) SELECT {sql_stamp('ts', 'at')}, {sq('close', 2)}, CASE WHEN count(*) OVER () = 50 THEN strftime(min(ts) OVER (), '%Y-%m-%d %H:%M:%S') END AS next_before FROM t",
    "srv_session": f"WITH {EVENT_SQL}, g AS (SELECT symbol, count(*) AS bars, sum(volume)::BIGINT AS volume, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM ev WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1), h AS (SELECT *, close - open AS change, CASE WHEN open <> 0 THEN 100 * (close - open) / open END AS change_pct FROM g) SELECT symbol, bars, volume, {sqs({c: 4 for c in ('open', 'high', 'low', 'close', 'change', 'change_pct')})} FROM h",
    "srv_predictions": f"WITH {_PRED}, t AS (SELECT * FROM pd ORDER BY ts DESC, symbol LIMIT 100) SELECT prediction_id, {sql_stamp('ts', 'at')}, CASE WHEN t.p >= 0.5 THEN 'up' ELSE 'down' END AS predicted_direction, actual_direction, is_correct FROM t LEFT JOIN ov USING (prediction_id)",
    "srv_open_prediction": f"WITH {_PRED} SELECT symbol, arg_max(prediction_id, ts) AS prediction_id, {sql_stamp('max(target_ts)', 'target')} FROM pd WHERE target_ts > {_SQL_NOW} GROUP BY symbol",
    "srv_champion": f"""WITH {_DEPLOY}, p AS (SELECT * FROM dp WHERE to_stage = 'champion' QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY id DESC) = 1)
SELECT model_name, model_version, CAST(created_at AS DATE) AS promoted FROM p WHERE NOT EXISTS (SELECT 1 FROM dp WHERE dp.model_name = p.model_name AND dp.model_version = p.model_version AND dp.to_stage = 'archived' AND dp.id > p.id)""",
    "srv_monitoring": f"WITH {_CYCLE} SELECT '2024-01-25 00:00:00' AS at, '2024-01-15 00:00:00' AS window_start, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'alert') AS alert, coalesce(bool_or(metric_name = 'retrain_recommended'), false) AS retrain FROM rp",
    "srv_drifted": f"WITH {_VALUES} SELECT model, feature AS feature_name, {sq('psi', 6, 'value')} FROM dr WHERE status = 'alert'",
    "srv_summary": f"WITH {EVENT_SQL}, r AS (SELECT symbol, ts, close, 100 * (close - lag(close) OVER {_W}) / lag(close) OVER {_W} AS c FROM ev), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), s AS (SELECT n_name AS symbol FROM nation UNION SELECT symbol FROM ev) SELECT s.symbol, {sql_stamp('ts', 'at')}, {sq('close', 2)}, {sq('c', 4, 'change_pct')} FROM s LEFT JOIN l USING (symbol)",
    "srv_detail": f"""WITH {_PRED}, {_LAST},
i AS (SELECT symbol, ts, CASE WHEN count(*) OVER x = 20 THEN avg(close) OVER x END AS sma_20 FROM ev WINDOW x AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
j AS (SELECT * FROM i WHERE hour(ts) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1),
g AS (SELECT symbol, arg_max(close, ts) - arg_min(open, ts) AS ch FROM ev WHERE ts >= {_SQL_NOW} GROUP BY 1),
op AS (SELECT symbol, CASE WHEN arg_max(p, ts) >= 0.5 THEN 'up' ELSE 'down' END AS pdir FROM pd WHERE target_ts > {_SQL_NOW} GROUP BY 1)
SELECT lt.symbol, {sql_stamp('lt.ts', 'at')}, {sq('CASE WHEN j.ts = lt.ts THEN sma_20 END', 4, 'sma_20')}, {sq('ch', 4, 'session_change')}, pdir AS predicted_direction, {sql_stamp('lt.ts + INTERVAL 1 HOUR', 'as_of')}, {sq(f"date_diff('second', lt.ts + INTERVAL 1 HOUR, {_SQL_NOW})", 1, 'age_s')}, date_diff('second', lt.ts + INTERVAL 1 HOUR, {_SQL_NOW}) > 18000 AS stale
FROM lt LEFT JOIN j USING (symbol) LEFT JOIN g USING (symbol) LEFT JOIN op USING (symbol)""",
    "srv_status": f"""WITH {EVENT_SQL}, s AS (SELECT 'bars' AS stage, symbol, max(ts) AS ts FROM ev GROUP BY 2 UNION ALL SELECT 'indicators', symbol, max(ts) FROM ev WHERE symbol <> 'view' OR ts < TIMESTAMP '2024-01-10' GROUP BY 2), t AS (SELECT *, date_diff('second', ts + INTERVAL 1 HOUR, TIMESTAMP '2024-01-31 02:00:00') > 18000 AS st FROM s)
SELECT stage, {sql_stamp('max(ts)', '"last"')}, CASE WHEN bool_and(st) THEN 'stale' ELSE 'ok' END AS status, coalesce(string_agg(symbol, ',' ORDER BY symbol) FILTER (st), '') AS stale_symbols FROM t GROUP BY 1""",
    "srv_watchlist": f"WITH {EVENT_SQL}, {_LAST} SELECT event_id AS position, event_type AS symbol, {sq('close', 2)} FROM events LEFT JOIN lt ON event_type = symbol WHERE user_id % 5 = 3",
    "srv_chart": f"WITH {EVENT_SQL}, r AS (SELECT symbol, ts, close, (close - lag(close) OVER {_W}) / lag(close) OVER {_W} AS return_1 FROM ev) SELECT symbol, {sql_stamp('ts', 'at')}, {sq('close + CASE WHEN hour(ts) = 5 THEN 1 ELSE 0 END', 2, 'close')}, {sq('return_1', 6)} FROM r",
    "srv_newest": f"WITH {EVENT_SQL}, {_LAST} SELECT symbol, {sq('CASE WHEN symbol = $$click$$ THEN close ELSE 0 END', 2, 'close')} FROM lt",
    "srv_track_record": f"""WITH {_PRED}, t AS (SELECT model_name, is_correct, actual_direction FROM pd LEFT JOIN ov USING (prediction_id)), g AS (SELECT model_name, count(is_correct) AS resolved, count(*) FILTER (actual_direction IS NULL) AS pending, count(*) FILTER (is_correct) AS hit, count(*) FILTER (is_correct IS NOT NULL AND actual_direction = 'up') AS up FROM t GROUP BY 1)
SELECT model_name, resolved, pending, {sq('hit / nullif(resolved, 0)', 6, 'hit_rate')}, {sq('greatest(up, resolved - up) / nullif(resolved, 0)', 6, 'majority_rate')} FROM g""",
}
