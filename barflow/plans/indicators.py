"""Queries of indicators, features and labels over derived daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions.blocks import in_blocks
from barflow.operators import dataset as D, features as X, indicators as I
from barflow.plans.common import day, rd, sq, sqs
from barflow.sources.bars import LINE_SQL, line_bars

_W = "(PARTITION BY symbol ORDER BY ts)"
_DIGITS = {c: 6 for c in I.FIELDS} | {c: 3 for c in ("sma_20", "ema_12", "ema_26", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_middle", "bb_lower", "volume_sma_20")} | {"price_change": 2, "rsi_14": 5, "sma_20": 4, "bb_middle": 4}


def _query(f, columns):
    return lambda spark, d: f(line_bars(spark, d)).select("symbol", day(), *[rd(c, _DIGITS[c]) for c in columns])


_GROUPS = {
    "ind_returns": (I.returns, ["price_change", "return_1", "log_return_1", "volume_change_pct"]),
    "ind_sma_bollinger": (I.bollinger, ["sma_20", "bb_middle", "bb_upper", "bb_lower", "bb_width"]),
    "ind_volatility": (lambda b: I.volatility(I.returns(b)), ["volatility_20"]),
    "ind_volume": (I.volume, ["volume_sma_20", "volume_ratio"]),
    "ind_ema": (I.macd, ["ema_12", "ema_26"]),
    "ind_macd": (I.macd, ["macd", "macd_signal", "macd_hist"]),
    "ind_rsi": (I.rsi, ["rsi_14"]),
}


def ind_snapshot(spark, d):
    """All 18 indicators of every bar, as the snapshot's fields."""
    df = I.snapshot(line_bars(spark, d))
    return df.select("symbol", day(), "indicator_version", *[rd(F.col(f"indicators.{c}"), _DIGITS[c], c) for c in I.FIELDS])


_IND = f"""
WITH RECURSIVE {LINE_SQL},
n AS (SELECT *, row_number() OVER w AS k, close - lag(close) OVER w AS ch, lag(close) OVER w AS pc, lag(volume) OVER w AS pv,
             ln(close / lag(close) OVER w) AS lr FROM li WINDOW w AS {_W}),
r AS (
  SELECT symbol, k, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS sig, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS dn FROM n WHERE k = 1
  UNION ALL
  SELECT n.symbol, n.k, r.e12 + (n.close - r.e12) * 2 / 13, r.e26 + (n.close - r.e26) * 2 / 27,
         CASE WHEN n.k = 26 THEN r.e12 + (n.close - r.e12) * 2 / 13 - (r.e26 + (n.close - r.e26) * 2 / 27)
              WHEN n.k > 26 THEN r.sig + (r.e12 + (n.close - r.e12) * 2 / 13 - (r.e26 + (n.close - r.e26) * 2 / 27) - r.sig) / 5 END,
         CASE WHEN n.k <= 15 THEN r.up + greatest(n.ch, 0) / 14 ELSE (r.up * 13 + greatest(n.ch, 0)) / 14 END,
         CASE WHEN n.k <= 15 THEN r.dn + greatest(-n.ch, 0) / 14 ELSE (r.dn * 13 + greatest(-n.ch, 0)) / 14 END
  FROM r JOIN n ON n.symbol = r.symbol AND n.k = r.k + 1),
f AS (
  SELECT n.*, r.e12, r.e26, r.sig, r.up, r.dn,
         CASE WHEN n.k >= 20 THEN avg(close) OVER x END AS sma_20, CASE WHEN n.k >= 20 THEN stddev_pop(close) OVER x END AS sd,
         CASE WHEN n.k >= 21 THEN stddev_samp(lr) OVER x END AS volatility_20, CASE WHEN n.k >= 20 THEN avg(volume) OVER x END AS volume_sma_20
  FROM n JOIN r USING (symbol, k) WINDOW x AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)),
i AS (
  SELECT symbol, CAST(ts AS DATE) AS day, '1.0.0' AS indicator_version, ch AS price_change, ch / pc AS return_1, lr AS log_return_1,
         CASE WHEN pv <> 0 THEN (volume - pv) / pv END AS volume_change_pct, sma_20, sma_20 AS bb_middle, sma_20 + 2 * sd AS bb_upper,
         sma_20 - 2 * sd AS bb_lower, 4 * sd / sma_20 AS bb_width, volatility_20, volume_sma_20, volume / volume_sma_20 AS volume_ratio,
         CASE WHEN k >= 12 THEN e12 END AS ema_12, CASE WHEN k >= 26 THEN e26 END AS ema_26, CASE WHEN k >= 26 THEN e12 - e26 END AS macd,
         CASE WHEN k >= 34 THEN sig END AS macd_signal, CASE WHEN k >= 34 THEN e12 - e26 - sig END AS macd_hist,
         CASE WHEN k >= 15 THEN CASE WHEN dn = 0 THEN CASE WHEN up > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + up / dn) END END AS rsi_14
  FROM f)
"""

# -- features ------------------------------------------------------------------------------------------------------------------
_FEATURE_GROUPS = {
    "feat_returns": ["ret_1", "ret_5", "ret_10", "ret_20", "ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_4", "gap"],
    "feat_shape": ["hl_range", "close_pos"],
    "feat_trend": ["close_sma10", "close_sma20", "close_sma50", "sma10_sma50"],
    "feat_macd": ["macd_norm", "macd_hist_norm"],
    "feat_vol": ["vol_10", "vol_20", "vol_ratio_10_60", "bb_width_20", "bb_pos_20"],
    "feat_atr_rsi": ["atr_14_norm", "rsi_14"],
    "feat_volume": ["volume_ratio_20", "volume_change"],
    "feat_calendar": ["day_of_week", "month"],
}


def gapped(spark, d):
    return X.with_gaps(line_bars(spark, d)).withColumn("session_date", F.to_date("ts"))


def _feature_query(columns):
    return lambda spark, d: X.features(gapped(spark, d)).select("symbol", day(), "segment", *[rd(c, 6) for c in columns])


_S = "(PARTITION BY symbol, segment ORDER BY ts)"
FEATURES_SQL = f"""
WITH RECURSIVE {LINE_SQL},
g0 AS (SELECT *, greatest(0, coalesce(round_even(date_diff('second', lag(ts) OVER w, ts) / 86400.0, 0) - 1, 0))::INT AS gap_before FROM li WINDOW w AS {_W}),
g AS (SELECT *, sum(CASE WHEN gap_before > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS segment FROM g0),
n AS (SELECT *, row_number() OVER s AS k, lag(close) OVER s AS pc, close - lag(close) OVER s AS ch, ln(close / lag(close) OVER s) AS ret_1,
             greatest(high, lag(close) OVER s) - least(low, lag(close) OVER s) AS tr FROM g WINDOW s AS {_S}),
r AS (
  SELECT symbol, segment, k, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS sig, CAST(0 AS DOUBLE) AS up, CAST(0 AS DOUBLE) AS dn, CAST(0 AS DOUBLE) AS atr FROM n WHERE k = 1
  UNION ALL
  SELECT n.symbol, n.segment, n.k, r.e12 + (n.close - r.e12) * 2 / 13, r.e26 + (n.close - r.e26) * 2 / 27,
         CASE WHEN n.k = 26 THEN r.e12 + (n.close - r.e12) * 2 / 13 - (r.e26 + (n.close - r.e26) * 2 / 27)
              WHEN n.k > 26 THEN r.sig + (r.e12 + (n.close - r.e12) * 2 / 13 - (r.e26 + (n.close - r.e26) * 2 / 27) - r.sig) / 5 END,
         CASE WHEN n.k <= 15 THEN r.up + greatest(n.ch, 0) / 14 ELSE (r.up * 13 + greatest(n.ch, 0)) / 14 END,
         CASE WHEN n.k <= 15 THEN r.dn + greatest(-n.ch, 0) / 14 ELSE (r.dn * 13 + greatest(-n.ch, 0)) / 14 END,
         CASE WHEN n.k <= 15 THEN r.atr + n.tr / 14 ELSE (r.atr * 13 + n.tr) / 14 END
  FROM r JOIN n ON n.symbol = r.symbol AND n.segment = r.segment AND n.k = r.k + 1),
f AS (
  SELECT n.*, r.e12, r.e26, r.sig, r.up, r.dn, r.atr,
         CASE WHEN n.k >= 10 THEN avg(close) OVER a10 END AS s10, CASE WHEN n.k >= 20 THEN avg(close) OVER a20 END AS s20, CASE WHEN n.k >= 50 THEN avg(close) OVER a50 END AS s50,
         CASE WHEN n.k >= 11 THEN stddev_samp(ret_1) OVER a10 END AS vol_10, CASE WHEN n.k >= 21 THEN stddev_samp(ret_1) OVER a20 END AS vol_20,
         CASE WHEN n.k >= 61 THEN stddev_samp(ret_1) OVER a60 END AS v60, CASE WHEN n.k >= 20 THEN stddev_pop(close) OVER a20 END AS sd, CASE WHEN n.k >= 20 THEN avg(volume) OVER a20 END AS mv,
         ln(close / lag(close, 5) OVER s) AS ret_5, ln(close / lag(close, 10) OVER s) AS ret_10, ln(close / lag(close, 20) OVER s) AS ret_20,
         lag(ret_1, 1) OVER s AS ret_lag_1, lag(ret_1, 2) OVER s AS ret_lag_2, lag(ret_1, 3) OVER s AS ret_lag_3, lag(ret_1, 4) OVER s AS ret_lag_4,
         lag(volume) OVER s AS pv
  FROM n JOIN r USING (symbol, segment, k)
  WINDOW s AS {_S}, a10 AS (PARTITION BY symbol, segment ORDER BY ts ROWS 9 PRECEDING), a20 AS (PARTITION BY symbol, segment ORDER BY ts ROWS 19 PRECEDING),
         a50 AS (PARTITION BY symbol, segment ORDER BY ts ROWS 49 PRECEDING), a60 AS (PARTITION BY symbol, segment ORDER BY ts ROWS 59 PRECEDING)),
x AS (
  SELECT symbol, ts, CAST(ts AS DATE) AS day, segment, k, close, gap_before, ret_1, ret_5, ret_10, ret_20, ret_lag_1, ret_lag_2, ret_lag_3, ret_lag_4, ln(open / pc) AS gap,
         (high - low) / close AS hl_range, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_pos,
         close / s10 - 1 AS close_sma10, close / s20 - 1 AS close_sma20, close / s50 - 1 AS close_sma50, s10 / s50 - 1 AS sma10_sma50,
         CASE WHEN k >= 26 THEN (e12 - e26) / close END AS macd_norm, CASE WHEN k >= 34 THEN (e12 - e26 - sig) / close END AS macd_hist_norm,
         vol_10, vol_20, CASE WHEN v60 <> 0 THEN vol_10 / v60 END AS vol_ratio_10_60, CASE WHEN k >= 15 THEN atr / close END AS atr_14_norm,
         4 * sd / s20 AS bb_width_20, CASE WHEN sd = 0 THEN 0.5 ELSE (close - (s20 - 2 * sd)) / (4 * sd) END AS bb_pos_20,
         CASE WHEN k >= 15 THEN CASE WHEN dn = 0 THEN CASE WHEN up > 0 THEN 1 ELSE 0.5 END ELSE 1 - 1 / (1 + up / dn) END END AS rsi_14,
         ln((volume + 1) / (mv + 1)) AS volume_ratio_20, ln((volume + 1) / (pv + 1)) AS volume_change,
         isodow(ts) - 1 AS day_of_week, month(ts) AS month
  FROM f)
"""
_READY = " AND ".join(["k >= 61", *[f"{c} IS NOT NULL" for c in X.NAMES]])


def feat_all_ready(spark, d):
    df = X.features(gapped(spark, d)).where("ready")
    return df.select("symbol", day(), "bar_no", *[rd(c, 6) for c in X.NAMES])


def ind_blocks(spark, d):
    """All indicators of series that are cut into blocks of 700 bars, as one task's share of a long series is."""
    df = in_blocks(line_bars(spark, d), I.snapshot, size=700)
    return df.select("symbol", day(), *[rd(F.col(f"indicators.{c}"), _DIGITS[c], c) for c in I.FIELDS])


def feat_blocks(spark, d):
    """All features of series in such blocks; a segment that began before a block is ready in it."""
    df = in_blocks(line_bars(spark, d), lambda x: X.features(X.with_gaps(x)), size=700).where("ready")
    return df.select("symbol", day(), *[rd(c, 6) for c in X.NAMES])


LABELS_SQL = f"""{FEATURES_SQL.rstrip()},
l AS (
  SELECT x.*, CASE WHEN max(CASE WHEN gap_before > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 0
                   THEN ln(lead(close, 5) OVER w / close) END AS y_return, lead(day, 5) OVER w AS label_end
  FROM x WINDOW w AS {_W}),
y AS (SELECT *, CASE WHEN y_return > 0 THEN 1.0 WHEN y_return < 0 THEN -1.0 WHEN y_return IS NOT NULL THEN 0.0 END AS y_class,
             CASE WHEN y_return > 0 THEN 1.0 WHEN y_return < 0 THEN 0.0 END AS y_up FROM l)
"""


def labels(spark, d):
    df = D.with_labels(gapped(spark, d))
    return df.select("symbol", day(), rd("y_return", 6), rd("y_class", 1), rd("y_up", 1), "label_end")


def dataset(spark, d):
    df = D.complete(D.with_labels(X.features(gapped(spark, d))))
    return df.select("symbol", day(), rd("ret_5", 6), rd("rsi_14", 6), rd("vol_20", 6), rd("y_return", 6), "label_end")


QUERIES = {
    "ind_snapshot": ind_snapshot, **{name: _query(f, c) for name, (f, c) in _GROUPS.items()},
    **{name: _feature_query(c) for name, c in _FEATURE_GROUPS.items()}, "feat_all_ready": feat_all_ready, "ind_blocks": ind_blocks, "feat_blocks": feat_blocks, "labels": labels, "dataset": dataset,
}
ORACLES = {
    "ind_snapshot": f"{_IND} SELECT symbol, day, indicator_version, {sqs({c: _DIGITS[c] for c in I.FIELDS})} FROM i",
    **{name: f"{_IND} SELECT symbol, day, {sqs({c: _DIGITS[c] for c in cols})} FROM i" for name, (_, cols) in _GROUPS.items()},
    **{name: f"{FEATURES_SQL} SELECT symbol, day, segment::BIGINT AS segment, {sqs({c: 6 for c in cols})} FROM x" for name, cols in _FEATURE_GROUPS.items()},
    "feat_all_ready": f"{FEATURES_SQL} SELECT symbol, day, k::INT AS bar_no, {sqs({c: 6 for c in X.NAMES})} FROM x WHERE {_READY}",
    "ind_blocks": f"{_IND} SELECT symbol, day, {sqs({c: _DIGITS[c] for c in I.FIELDS})} FROM i",
    "feat_blocks": f"{FEATURES_SQL} SELECT symbol, day, {sqs({c: 6 for c in X.NAMES})} FROM x WHERE {_READY}",
    "labels": f"{LABELS_SQL} SELECT symbol, day, {sqs({'y_return': 6, 'y_class': 1, 'y_up': 1})}, label_end FROM y",
    "dataset": f"{LABELS_SQL} SELECT symbol, day, {sqs({'ret_5': 6, 'rsi_14': 6, 'vol_20': 6, 'y_return': 6})}, label_end FROM y WHERE y_return IS NOT NULL AND {_READY.replace('k >= 61 AND ', '')}",
}
