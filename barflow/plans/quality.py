"""Queries of data quality, over daily bars of orders as raw strings with planted faults."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from barflow.operators import quality as Q
from barflow.plans.common import rd, sq
from barflow.sources.bars import ORDER_SQL, order_bars



def _now():
    return F.lit("2026-10-01 00:00:00").cast("timestamp")


def raw(spark, d):
    """Raw rows: bad values, times, signs and prices, zero volumes, flat runs, equal and conflicting copies, each by a modulus."""
    n = F.col("n")
    df = order_bars(spark, d).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    flat = (n % 61).between(1, 5)
    price = lambda c: F.when(flat, "150000.50").otherwise(F.format_string("%.2f", F.col(c)))
    df = df.select(
        "symbol", (n * 10).alias("row"), F.when(n % 101 == 0, "abc").otherwise((F.unix_timestamp("ts") + 52_200).cast("string")).alias("raw_timestamp"), F.when(n % 103 == 0, "-1").otherwise(price("open")).alias("raw_open"),
        F.when(n % 109 == 0, "0.5").otherwise(price("high")).alias("raw_high"), price("low").alias("raw_low"), F.when(n % 97 == 0, " ").otherwise(price("close")).alias("raw_close"),
        F.when(n % 107 == 0, "-5").when(n % 59 == 0, "0").otherwise(F.col("volume").cast("string")).alias("raw_volume"), "n",
    )
    same = df.where("n % 113 = 0").withColumn("row", F.col("row") + 1)
    other = df.where("n % 127 = 0").withColumn("row", F.col("row") + 2).withColumn("raw_volume", F.lit("999"))
    return df.unionByName(same).unionByName(other).drop("n")


_RAW = f"""{ORDER_SQL},
n0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM od),
r0 AS (
  SELECT symbol, n, n * 10 AS "row", CASE WHEN n % 101 = 0 THEN 'abc' ELSE (epoch(ts)::BIGINT + 52200)::VARCHAR END AS raw_timestamp,
         CASE WHEN n % 103 = 0 THEN '-1' WHEN n % 61 BETWEEN 1 AND 5 THEN '150000.50' ELSE printf('%.2f', open) END AS raw_open,
         CASE WHEN n % 109 = 0 THEN '0.5' WHEN n % 61 BETWEEN 1 AND 5 THEN '150000.50' ELSE printf('%.2f', high) END AS raw_high,
         CASE WHEN n % 61 BETWEEN 1 AND 5 THEN '150000.50' ELSE printf('%.2f', low) END AS raw_low,
         CASE WHEN n % 97 = 0 THEN ' ' WHEN n % 61 BETWEEN 1 AND 5 THEN '150000.50' ELSE printf('%.2f', close) END AS raw_close,
         CASE WHEN n % 107 = 0 THEN '-5' WHEN n % 59 = 0 THEN '0' ELSE volume::VARCHAR END AS raw_volume FROM n0),
raw AS (SELECT * FROM r0 UNION ALL SELECT * REPLACE ("row" + 1 AS "row") FROM r0 WHERE n % 113 = 0
        UNION ALL SELECT * REPLACE ("row" + 2 AS "row", '999' AS raw_volume) FROM r0 WHERE n % 127 = 0),
t AS (SELECT symbol, "row", raw_timestamp, raw_close, try_cast(trim(raw_open) AS DOUBLE) AS open, try_cast(trim(raw_high) AS DOUBLE) AS high, try_cast(trim(raw_low) AS DOUBLE) AS low,
             try_cast(trim(raw_close) AS DOUBLE) AS close, try_cast(trim(raw_volume) AS DOUBLE) AS volume, try_cast(trim(raw_timestamp) AS DOUBLE) AS s FROM raw),
o AS (SELECT *, list_filter([CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'E001' END,
               CASE WHEN s IS NULL OR s < 631152000 OR s > epoch(TIMESTAMP '2026-10-02') THEN 'E002' END, CASE WHEN open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 THEN 'E003' END,
               CASE WHEN volume < 0 THEN 'E004' END, CASE WHEN high < greatest(open, close, low) OR low > least(open, close) THEN 'E005' END], lambda x: x IS NOT NULL) AS own FROM t),
k AS (SELECT symbol, s, count(*) AS copies, count(DISTINCT (open, high, low, close, volume)) AS kinds, min("row") AS first_row FROM o WHERE len(own) = 0 GROUP BY 1, 2),
e AS (SELECT o.*, to_timestamp(o.s)::TIMESTAMP AS ts, CAST(timezone('America/New_York', to_timestamp(o.s)) AS DATE) AS session_date, timezone('America/New_York', to_timestamp(o.s)) AS local,
             CASE WHEN len(own) > 0 THEN own WHEN kinds > 1 THEN ['E006'] WHEN "row" > first_row THEN ['E007'] ELSE CAST([] AS VARCHAR[]) END AS errors
      FROM o LEFT JOIN k ON len(own) = 0 AND o.symbol = k.symbol AND o.s = k.s),
u AS (SELECT * FROM e WHERE len(errors) = 0),
span AS (SELECT symbol, min(session_date) AS a, max(session_date) AS b FROM u GROUP BY 1),
pres AS (SELECT session_date, count(DISTINCT symbol) AS present FROM u GROUP BY 1),
cal AS (SELECT session_date, present, count(*) AS listed FROM pres JOIN span ON session_date BETWEEN a AND b GROUP BY 1, 2 HAVING present >= 0.5 * count(*)),
"""
_WARN = (
    _RAW
    + """
l1 AS (SELECT *, ln(close / lag(close) OVER w) AS log_return, lag(session_date) OVER w AS pd, CASE WHEN close = lag(close) OVER w THEN 0 ELSE 1 END AS nw FROM u WINDOW w AS (PARTITION BY symbol ORDER BY ts, "row")),
l2 AS (SELECT *, list(log_return) FILTER (log_return IS NOT NULL) OVER (PARTITION BY symbol ORDER BY ts, "row" ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS rs,
              lead(log_return) OVER w AS nx, sum(nw) OVER w AS run, count(volume) OVER v AS nv, median(volume) OVER v AS mv
       FROM l1 WINDOW w AS (PARTITION BY symbol ORDER BY ts, "row"), v AS (PARTITION BY symbol ORDER BY ts, "row" ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
l3 AS (SELECT *, list_median(rs) AS m FROM l2),
l4 AS (SELECT *, list_median(list_transform(rs, lambda x: abs(x - m))) AS mad FROM l3),
l5 AS (SELECT *, CASE WHEN len(rs) >= 60 AND mad > 0 THEN (log_return - m) / (1.4826 * mad) END AS z, count(*) OVER (PARTITION BY symbol, run) >= 5 AS stale,
              CASE WHEN pd IS NULL THEN 0 ELSE (SELECT count(*) FROM cal WHERE cal.session_date > pd AND cal.session_date < l4.session_date) END AS missing FROM l4),
l6 AS (SELECT *, coalesce(abs(z) >= 6, false) AS extreme, coalesce(nv >= 20 AND volume >= 2 * mv, false) AS vc, coalesce(sign(nx) = -sign(log_return) AND abs(nx) >= 0.8 * abs(log_return), false) AS rev,
              avg(CASE WHEN abs(z) >= 3 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY session_date) >= 0.5 AS mw, NOT (hour(local) = 9 AND minute(local) = 30) AS irr FROM l5),
wn AS (SELECT *, CASE WHEN extreme THEN CASE WHEN mw THEN 'market_wide' WHEN vc THEN 'volume_confirmed' WHEN rev THEN 'suspect_reversal' ELSE 'idiosyncratic' END END AS extreme_class,
              list_filter([CASE WHEN extreme THEN 'W101' END, CASE WHEN missing > 0 THEN 'W103' END, CASE WHEN volume = 0 THEN 'W102' END, CASE WHEN irr THEN 'W104' END, CASE WHEN stale THEN 'W105' END], lambda x: x IS NOT NULL) AS warnings FROM l6),
al AS (SELECT symbol, "row", errors AS issues, errors, NULL AS extreme_class, NULL::DATE AS session_date, 0 AS missing FROM e WHERE len(errors) > 0
       UNION ALL SELECT symbol, "row", warnings, errors, extreme_class, session_date, missing FROM wn)
"""
)


def _valid(spark, d):
    return Q.validated(raw(spark, d), _now())


def _usable(spark, d):
    return Q.errors(raw(spark, d), _now()).where(F.size("errors") == 0)


def q_issues(spark, d):
    return _valid(spark, d).select("symbol", "row", F.array_join("issues", ",").alias("issues"))


def q_duplicates(spark, d):
    df = Q.errors(raw(spark, d), _now())
    return df.where(F.arrays_overlap("errors", F.array(F.lit("E006"), F.lit("E007")))).select("symbol", "row", F.array_join("errors", ",").alias("codes"))


def q_calendar(spark, d):
    return Q.calendar(_usable(spark, d)).select("session_date", "present", "listed")


def q_gaps(spark, d):
    df = _usable(spark, d)
    return Q.gaps(df, Q.calendar(df))


def q_robust_z(spark, d):
    return Q.robust_z(_usable(spark, d)).select("symbol", "row", rd("log_return", 6), rd("z", 5))


def q_extreme_class(spark, d):
    return _valid(spark, d).where("extreme_class is not null").select("symbol", "row", "extreme_class")


def q_stale(spark, d):
    return _valid(spark, d).where("stale").select("symbol", "row")


def q_clean(spark, d):
    df = Q.clean(_valid(spark, d))
    return df.select("symbol", "session_date", rd("open", 2), rd("close", 2), "volume", "extreme_class", "flag_zero_volume", "flag_stale_price", "flag_irregular_time", "missing_sessions_before")


def q_removed(spark, d):
    return Q.removed(_valid(spark, d))


def q_counts(spark, d):
    return Q.rule_counts(_valid(spark, d))


def q_report_symbol(spark, d):
    return Q.report(_valid(spark, d))


_C = "SELECT symbol, \"row\""
QUERIES = {q.__name__: q for q in (q_issues, q_duplicates, q_calendar, q_gaps, q_robust_z, q_extreme_class, q_stale, q_clean, q_removed, q_counts, q_report_symbol)}
_NAMES = "CASE c " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in Q.RULES.items()) + " END"
ORACLES = {
    "q_issues": f"WITH {_WARN} {_C}, array_to_string(issues, ',') AS issues FROM al",
    "q_duplicates": f"WITH {_RAW} x AS (SELECT 1) {_C}, array_to_string(errors, ',') AS codes FROM e WHERE list_has_any(errors, ['E006', 'E007'])",
    "q_calendar": f"WITH {_RAW} x AS (SELECT 1) SELECT session_date, present, listed FROM cal",
    "q_gaps": f"WITH {_RAW} x AS (SELECT 1) SELECT symbol, session_date FROM span JOIN cal ON session_date BETWEEN a AND b EXCEPT SELECT symbol, session_date FROM u",
    "q_robust_z": f"WITH {_WARN} {_C}, {sq('log_return', 6)}, {sq('z', 5)} FROM wn",
    "q_extreme_class": f"WITH {_WARN} {_C}, extreme_class FROM wn WHERE extreme_class IS NOT NULL",
    "q_stale": f"WITH {_WARN} {_C} FROM wn WHERE stale",
    "q_clean": f"WITH {_WARN} SELECT symbol, session_date, {sq('open', 2)}, {sq('close', 2)}, volume::BIGINT AS volume, extreme_class, volume = 0 AS flag_zero_volume, stale AS flag_stale_price, irr AS flag_irregular_time, missing::INT AS missing_sessions_before FROM wn",
    "q_removed": f"WITH {_RAW} x AS (SELECT 1) {_C}, array_to_string(errors, ',') AS codes, array_to_string(list_transform(errors, lambda c: {_NAMES}), '; ') AS reasons, raw_timestamp, raw_close FROM e WHERE len(errors) > 0",
    "q_counts": f"WITH {_WARN}, p AS (SELECT symbol, unnest(issues) AS code FROM al) SELECT symbol, code, count(*) AS n FROM p GROUP BY ALL",
    "q_report_symbol": f"""WITH {_WARN} SELECT symbol, count(*) AS rows, count(*) FILTER (len(errors) = 0) AS kept, count(*) FILTER (len(errors) > 0) AS removed, min(session_date) AS first_session, max(session_date) AS last_session,
count(*) FILTER (list_contains(issues, 'W101')) AS extreme_moves, count(*) FILTER (list_contains(issues, 'W102')) AS zero_volume, count(*) FILTER (list_contains(issues, 'W104')) AS irregular_time, count(*) FILTER (list_contains(issues, 'W105')) AS stale_price,
sum(missing)::BIGINT AS missing_sessions, {", ".join(f"count(*) FILTER (extreme_class = '{c}') AS {c}" for c in ("market_wide", "volume_confirmed", "suspect_reversal", "idiosyncratic"))}
FROM al GROUP BY ROLLUP (symbol)""",
}
