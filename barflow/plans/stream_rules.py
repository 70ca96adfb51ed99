"""Queries of the event-time policy and of the anomaly detectors over derived hourly bars."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barflow.functions import timegrid as G
from barflow.operators import detectors as D, features as X, policy as P
from barflow.plans.common import day, rd, sql_stamp, sq, stamp
from barflow.sources.bars import EVENT_SQL, event_bars, order_bars, ORDER_SQL

_LIMITS = D.Limits(return_limit=0.5, z_limit=2.0, volume_ratio=1.5)


def numbered(spark, d):
    """Hourly bars with their number, an id, and an interval that changes once for one symbol."""
    df = event_bars(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    df = df.withColumn("event_id", F.concat_ws("-", "symbol", F.col("n").cast("string")))
    return df.withColumn("interval", F.when((F.col("symbol") == "click") & (F.col("n") > 400), "30m").otherwise("1h"))


_NUMBERED = f"""{EVENT_SQL},
b AS (SELECT symbol, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM ev),
nb AS (SELECT *, symbol || '-' || n AS event_id, CASE WHEN symbol = 'click' AND n > 400 THEN '30m' ELSE '1h' END AS interval FROM b)"""


def arrivals(spark, d):
    """Every 17th bar comes seven late, every 50th twice, and every 100th a third time long after; every 60th bar's id comes again with a
    time twenty minutes newer."""
    df = numbered(spark, d).select("symbol", "ts", "interval", "event_id", "n")
    first = df.withColumn("arrival", F.col("n") * 10 + F.when(F.col("n") % 17 == 0, 75).otherwise(0))
    twice = df.where("n % 50 = 0").withColumn("arrival", F.col("n") * 10 + 3)
    late = df.where("n % 100 = 0").withColumn("arrival", F.col("n") * 10 + 3007)
    newer = df.where("n % 60 = 0").withColumn("arrival", F.col("n") * 10 + 5).withColumn("ts", F.col("ts") + F.expr("interval 20 minutes"))
    return first.unionByName(twice).unionByName(late).unionByName(newer)


_ARRIVALS = f"""{_NUMBERED},
ar AS (SELECT symbol, ts, interval, event_id, n, n * 10 + CASE WHEN n % 17 = 0 THEN 75 ELSE 0 END AS arrival FROM nb
       UNION ALL SELECT symbol, ts, interval, event_id, n, n * 10 + 3 FROM nb WHERE n % 50 = 0
       UNION ALL SELECT symbol, ts, interval, event_id, n, n * 10 + 3007 FROM nb WHERE n % 100 = 0
       UNION ALL SELECT symbol, ts + INTERVAL 20 MINUTE, interval, event_id, n, n * 10 + 5 FROM nb WHERE n % 60 = 0),
c AS (SELECT *, coalesce((interval <> lag(interval) OVER (PARTITION BY symbol ORDER BY arrival))::INT, 0) AS ch FROM ar),
s AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY arrival) AS segment FROM c),
i AS (SELECT *, row_number() OVER (PARTITION BY symbol, segment, event_id ORDER BY arrival) = 1 AS first FROM s),
m AS (SELECT *, max(ts) FILTER (first) OVER (PARTITION BY symbol, segment ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM i),
f AS (SELECT *, first AND (newest IS NULL OR ts > newest) AS fresh FROM m),
k AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY symbol, segment ORDER BY arrival) AS no FROM f),
z AS (SELECT *, last_value(CASE WHEN fresh THEN no END IGNORE NULLS) OVER (PARTITION BY symbol, segment, event_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM k),
o AS (SELECT *, CASE WHEN fresh THEN 'processed' WHEN coalesce(ts = newest OR no - seen < 256, false) THEN 'duplicate' ELSE 'late' END AS outcome,
        CASE WHEN fresh THEN greatest(0, coalesce(round_even(date_diff('second', newest, ts) / CASE interval WHEN '1h' THEN 3600.0 ELSE 1800.0 END, 0) - 1, 0))::INT ELSE 0 END AS missing_bars FROM z)"""


def policy_outcomes(spark, d):
    return P.outcomes(arrivals(spark, d)).select("symbol", "event_id", F.col("arrival").cast("long").alias("arrival"), F.col("segment").cast("long").alias("segment"), "outcome")


def policy_missing_bars(spark, d):
    df = P.outcomes(arrivals(spark, d)).where("missing_bars > 0")
    return df.select("symbol", stamp("ts", "at"), "missing_bars")


def policy_counts(spark, d):
    return P.outcome_counts(P.outcomes(arrivals(spark, d)), "symbol")


def feature_gap_weekday(spark, d):
    """Gaps of daily bars by the weekday rule."""
    df = X.with_gaps(order_bars(spark, d), daily=True)
    return df.select("symbol", day(), "gap_before")


def feature_stale_dropped(spark, d):
    df = X.drop_stale(arrivals(spark, d), "arrival")
    return X.sampled(df, 3).select("symbol", "event_id")


def policy_bar_end(spark, d):
    """End of each bar, the start of the grid three bars before it, and the target five business days on."""
    from barflow.operators.models import target_time

    df = numbered(spark, d)
    return df.select("event_id", stamp(G.bar_end(F.col("ts"), F.col("interval")), "bar_end"), stamp(G.grid_start(F.col("ts"), F.lit("5m"), 3), "grid"), stamp(target_time(F.col("ts"), F.lit("1d"), 5), "target"), stamp(target_time(F.col("ts"), F.col("interval"), 5), "target_bars"))


def _flagged(spark, d):
    return D.return_zscore(D.volume_median(D.return_threshold(numbered(spark, d), _LIMITS), _LIMITS), _LIMITS)


def det_return(spark, d):
    return D.return_threshold(numbered(spark, d), _LIMITS).where("det_return is not null").select("event_id", "det_return.anomaly_type", "det_return.severity", rd("det_return.observed_value", 6, "observed"))


def det_volume(spark, d):
    return D.volume_median(numbered(spark, d), _LIMITS).where("det_volume is not null").select("event_id", "det_volume.severity", rd("det_volume.expected_value", 3, "expected"), rd("det_volume.score", 6, "score"))


def det_zscore(spark, d):
    return D.return_zscore(numbered(spark, d), _LIMITS).where("det_zscore is not null").select("event_id", "det_zscore.anomaly_type", "det_zscore.severity", rd("det_zscore.score", 5, "score"))


def det_anomalies(spark, d):
    """All detections as anomaly rows with derived ids."""
    df = D.anomalies(_flagged(spark, d), ["det_return", "det_zscore", "det_volume"])
    return df.select("anomaly_id", "symbol", "detector", "anomaly_type", "severity", "source_event_id")


def det_severity(spark, d):
    df = D.anomalies(_flagged(spark, d), ["det_return", "det_zscore", "det_volume"])
    return df.groupBy("detector", "severity").agg(F.count(F.lit(1)).alias("n"))


def det_scoring(spark, d):
    n = F.col("n")
    kinds = F.concat_ws(",", F.when(n % 40 == 0, "price_spike"), F.when(n % 30 == 0, "volume_spike"))
    df = _flagged(spark, d).withColumn("injected", kinds)
    out = D.scored(df, {"return_threshold": F.col("det_return").isNotNull(), "return_zscore": F.col("det_zscore").isNotNull(), "volume_median": F.col("det_volume").isNotNull()})
    return out.select("detector", "tp", "fp", "fn", rd("precision", 6), rd("recall", 6))


_DETECTED = f"""
WITH RECURSIVE {_NUMBERED},
w AS (SELECT *, lag(close) OVER x AS pc, ln(close / lag(close) OVER x) AS lr,
             count(*) OVER v AS nv, median(volume::DOUBLE) OVER v AS med FROM nb
      WINDOW x AS (PARTITION BY symbol ORDER BY ts), v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
zr AS (
  SELECT symbol, n, CAST([] AS DOUBLE[]) AS kept, CAST(NULL AS DOUBLE) AS z FROM w WHERE n = 1
  UNION ALL
  SELECT symbol, n, CASE WHEN len(k) > 120 THEN k[2:] ELSE k END, z FROM (
    SELECT symbol, n, z, list_append(kept, CASE WHEN z IS NULL THEN lr ELSE mu + sign(z) * 2 * sd END) AS k FROM (
      SELECT *, CASE WHEN len(kept) >= 30 AND sd > 0 AND abs((lr - mu) / sd) > 2 THEN (lr - mu) / sd END AS z FROM (
        SELECT w.symbol, w.n, w.lr, zr.kept, list_avg(zr.kept) AS mu, CASE WHEN len(zr.kept) > 1 THEN list_stddev_samp(zr.kept) END AS sd
        FROM zr JOIN w ON w.symbol = zr.symbol AND w.n = zr.n + 1)))),
d AS (
  SELECT event_id, w.symbol, w.n, 'return_threshold' AS detector, CASE WHEN close > pc THEN 'price_spike' ELSE 'price_drop' END AS anomaly_type, abs(close / pc - 1) AS score, 0.5 AS threshold, close / pc - 1 AS observed, 0.0 AS expected
  FROM w WHERE abs(close / pc - 1) > 0.5
  UNION ALL
  SELECT event_id, symbol, n, 'volume_median', 'volume_spike', volume / med, 1.5, volume, med FROM w WHERE nv >= 20 AND med > 0 AND volume / med > 1.5
  UNION ALL
  SELECT event_id, w.symbol, w.n, 'return_zscore', CASE WHEN z > 0 THEN 'price_spike' ELSE 'price_drop' END, abs(z), 2.0, lr, 0.0 FROM zr JOIN w USING (symbol, n) WHERE z IS NOT NULL),
a AS (SELECT *, CASE WHEN score / threshold < 1.5 THEN 'low' WHEN score / threshold < 2.5 THEN 'medium' WHEN score / threshold < 4 THEN 'high' ELSE 'critical' END AS severity,
             sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(event_id || ':' || detector || ':' || anomaly_type)) AS h FROM d)
"""
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"

QUERIES = {q.__name__: q for q in (policy_outcomes, policy_missing_bars, policy_counts, feature_gap_weekday, feature_stale_dropped, policy_bar_end, det_return, det_volume, det_zscore, det_anomalies, det_severity, det_scoring)}
_BUSINESS = "CAST(ts AS TIMESTAMP) + to_days((CASE WHEN isodow(ts) > 5 THEN 8 - isodow(ts) ELSE 0 END + 5 + 2 * ((CASE WHEN isodow(ts) > 5 THEN 0 ELSE isodow(ts) - 1 END + 5) // 5))::INT)"
ORACLES = {
    "policy_outcomes": f"WITH {_ARRIVALS} SELECT symbol, event_id, arrival::BIGINT AS arrival, segment::BIGINT AS segment, outcome FROM o",
    "policy_missing_bars": f"WITH {_ARRIVALS} SELECT symbol, {sql_stamp('ts', 'at')}, missing_bars FROM o WHERE missing_bars > 0",
    "policy_counts": f"WITH {_ARRIVALS} SELECT symbol, outcome, count(*) AS n FROM o GROUP BY ALL",
    "feature_gap_weekday": f"""WITH {ORDER_SQL}, p AS (SELECT symbol, CAST(ts AS DATE) AS day, CAST(lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS DATE) AS a FROM od)
SELECT symbol, day, CASE WHEN a IS NULL THEN 0 ELSE greatest(0, len(list_filter(range(a::TIMESTAMP, day::TIMESTAMP, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) - 1) END::INT AS gap_before FROM p""",
    "feature_stale_dropped": f"WITH {_ARRIVALS}, u AS (SELECT *, max(ts) OVER (PARTITION BY symbol ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ar), q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM u WHERE b IS NULL OR ts > b) SELECT symbol, event_id FROM q WHERE i % 3 = 0",
    "policy_bar_end": f"""WITH {_NUMBERED} SELECT event_id, {sql_stamp("ts + CASE interval WHEN '1h' THEN INTERVAL 1 HOUR ELSE INTERVAL 30 MINUTE END", 'bar_end')}, {sql_stamp("ts - INTERVAL 15 MINUTE", 'grid')},
{sql_stamp(_BUSINESS, 'target')}, {sql_stamp("ts + 5 * CASE interval WHEN '1h' THEN INTERVAL 1 HOUR ELSE INTERVAL 30 MINUTE END", 'target_bars')} FROM nb""",
    "det_return": f"{_DETECTED} SELECT event_id, anomaly_type, severity, {sq('observed', 6)} FROM a WHERE detector = 'return_threshold'",
    "det_volume": f"{_DETECTED} SELECT event_id, severity, {sq('expected', 3)}, {sq('score', 6)} FROM a WHERE detector = 'volume_median'",
    "det_zscore": f"{_DETECTED} SELECT event_id, anomaly_type, severity, {sq('score', 5)} FROM a WHERE detector = 'return_zscore'",
    "det_anomalies": f"{_DETECTED} SELECT {_UUID} AS anomaly_id, symbol, detector, anomaly_type, severity, event_id AS source_event_id FROM a",
    "det_severity": f"{_DETECTED} SELECT detector, severity, count(*) AS n FROM a GROUP BY ALL",
    "det_scoring": f"""{_DETECTED},
e AS (SELECT event_id, n % 40 = 0 AS jump, n % 30 = 0 AS vol FROM nb),
t AS (SELECT detector, CASE WHEN detector = 'volume_median' THEN vol ELSE jump END AS t, EXISTS (SELECT 1 FROM d WHERE d.event_id = e.event_id AND d.detector = k.detector) AS f
      FROM e, (VALUES ('return_threshold'), ('return_zscore'), ('volume_median')) AS k(detector) WHERE detector <> 'volume_median' OR NOT jump),
g AS (SELECT detector, count(*) FILTER (t AND f) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (t AND NOT f) AS fn FROM t GROUP BY 1)
SELECT detector, tp, fp, fn, {sq("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 'nan' END", 6, 'precision')}, {sq("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 'nan' END", 6, 'recall')} FROM g""",
}
