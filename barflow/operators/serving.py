"""Lookups that a market screen asks for: latest rows, keyset pages, session statistics, freshness, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions import timegrid as G


def latest_per(df: DataFrame, keys: list[str], ts: str = "ts", ties: list[str] = []) -> DataFrame:
    """The newest row of each key, as one aggregation that Spark takes in part before its shuffle."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(ts, *ties)).alias("_r")).select("_r.*")


def page(df: DataFrame, limit: int, ts: str = "ts", before: Column | None = None, start: Column | None = None, end: Column | None = None, **equal: str) -> DataFrame:
    """The ``limit`` newest rows of [start, end) that lie before the key, oldest first, with next_before.

    next_before is the oldest time if the page is full, else null. Filters reach the scan; the top rows are taken by partition.
    """
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    for test in ((before is not None) and F.col(ts) < before, (start is not None) and F.col(ts) >= start, (end is not None) and F.col(ts) < end):
        df = df.where(test) if test is not False else df
    top = df.orderBy(F.desc(ts)).limit(limit)
    w = Window.partitionBy()  # over one page
    return top.withColumn("next_before", F.when(F.count(F.lit(1)).over(w) == limit, F.min(ts).over(w))).orderBy(ts)


def session_stats(bars: DataFrame, since: Column) -> DataFrame:
    """Per symbol from ``since`` on: first open, extremes, volume, last close, bars, change and change in percent."""
    df = bars.where(F.col("ts") >= since).groupBy("symbol").agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("bars")
    )
    return df.withColumn("change", F.col("close") - F.col("open")).withColumn("change_pct", F.when(F.col("open") != 0, 100 * F.col("change") / F.col("open")))


def session_start(now: Column, interval: str) -> Column:
    """Midnight, or a year back for daily bars."""
    return F.timestamp_seconds(F.unix_timestamp(now) - 365 * 86400) if interval == "1d" else F.date_trunc("day", now)


def with_outcomes(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    return predictions.join(outcomes, "prediction_id", "left")


def open_predictions(predictions: DataFrame, now: Column) -> DataFrame:
    """Each symbol's newest prediction whose target lies ahead."""
    return latest_per(predictions.where(F.col("target_ts") > now), ["symbol"], "ts", ["prediction_id"])


def champion(deployments: DataFrame, stage: str = "champion") -> DataFrame:
    """Per model the version last promoted to the stage, unless it was archived after that."""
    d = deployments.where(F.col("to_stage") == stage).groupBy("model_name").agg(F.max_by(F.struct("model_version", "id", "created_at"), "id").alias("p"))
    d = d.select("model_name", "p.model_version", F.col("p.id").alias("id"), F.col("p.created_at").alias("promoted_at"))
    gone = deployments.where("to_stage = 'archived'").groupBy("model_name", "model_version").agg(F.max("id").alias("archived"))
    d = d.join(gone, ["model_name", "model_version"], "left")
    return d.where("archived is null or archived < id").select("model_name", "model_version", "promoted_at")


def monitoring_cycle(reports: DataFrame) -> DataFrame:
    """Report rows of the last cycle."""
    last = reports.agg(F.max("created_at").alias("created_at"))
    return reports.join(F.broadcast(last), "created_at")


def monitoring_summary(reports: DataFrame) -> DataFrame:
    """Number of rows by status in the last cycle, its window, and whether any row asks to retrain."""
    df = monitoring_cycle(reports)
    span = [F.min(c).alias(c) for c in ("window_start", "window_end") if c in df.columns]
    return df.groupBy("created_at").agg(*span, *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "warning", "alert")], F.coalesce(F.bool_or(F.col("metric_name") == "retrain_recommended"), F.lit(False)).alias("retrain"))


def drifted(reports: DataFrame) -> DataFrame:
    """Features in alert, the most drifted first."""
    return reports.where("report_type = 'data_drift' and status = 'alert'").orderBy(F.desc("value"), "feature_name")


def freshness(ts: Column, interval: Column, now: Column, bars: int = 5, least: int = 10) -> dict[str, Column]:
    """as_of (the bar's end), its age in seconds, and stale: older than ``bars`` intervals and ``least`` seconds."""
    as_of = G.bar_end(ts, interval)
    age = (F.unix_micros(now) - F.unix_micros(as_of)) / 1e6
    return {"as_of": as_of, "age_s": age, "stale": age > F.greatest(bars * G.duration(interval), F.lit(least))}


def summaries(symbols: DataFrame, active: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every known or active symbol with its latest close and change in percent, by symbol; null without a quote."""
    every = symbols.select("symbol").union(active.select("symbol")).distinct()
    return every.join(quotes, "symbol", "left").select("symbol", "ts", "close", (100 * F.col("return_1")).alias("change_pct")).orderBy("symbol")


def detail(bar: DataFrame, indicators: DataFrame, session: DataFrame, prediction: DataFrame, now: Column) -> DataFrame:
    """One row a symbol: its bar, indicators of just that bar, session, open prediction and freshness."""
    df = bar.join(indicators.withColumnRenamed("ts", "_its"), "symbol", "left")
    names = [c for c in indicators.columns if c not in ("symbol", "ts")]
    df = df.withColumns({c: F.when(F.col("_its") == F.col("ts"), F.col(c)) for c in names}).drop("_its")
    df = df.join(session.select("symbol", F.col("change").alias("session_change"), F.col("change_pct").alias("session_change_pct")), "symbol", "left")
    df = df.join(prediction.select("symbol", "prediction_id", "predicted_direction"), "symbol", "left")
    return df.withColumns(freshness(F.col("ts"), F.col("interval"), now))


def stage_status(stages: DataFrame, now: Column) -> DataFrame:
    """(stage, last, status) of ``stages(stage, symbol, ts, interval)``: missing without rows, stale if all its newest are, else ok; and the stale symbols."""
    newest = stages.groupBy("stage", "symbol").agg(F.max("ts").alias("ts"), F.max_by("interval", "ts").alias("interval"))
    df = newest.withColumn("stale", freshness(F.col("ts"), F.col("interval"), now)["stale"])
    out = df.groupBy("stage").agg(F.max("ts").alias("last"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("stale"), F.col("symbol")))), ",").alias("stale_symbols"), F.bool_and("stale").alias("_all"))
    return out.select("stage", "last", F.when(F.col("last").isNull(), "missing").when(F.col("_all"), "stale").otherwise("ok").alias("status"), "stale_symbols")


def watchlist(items: DataFrame, quotes: DataFrame, user: str) -> DataFrame:
    rows = items.where(F.col("user_id") == user)
    return rows.join(quotes, "symbol", "left").orderBy("position", "added_at")


def anomaly_feed(anomalies: DataFrame, limit: int, symbol: str | None = None, before: Column | None = None) -> DataFrame:
    """The newest anomalies, of one symbol or of all, before a time; newest first."""
    for test in ([F.col("symbol") == symbol] if symbol is not None else []) + ([F.col("ts") < before] if before is not None else []):
        anomalies = anomalies.where(test)
    return anomalies.orderBy(F.desc("ts"), "anomaly_id").limit(limit)


def active_symbols(quotes: DataFrame) -> DataFrame:
    """Symbols that have a latest row, by symbol."""
    return quotes.select("symbol").distinct().orderBy("symbol")


def known_symbols(symbols: DataFrame, active_only: bool = False) -> DataFrame:
    """The registered symbols, by symbol; all, or those that are active."""
    return (symbols.where("is_active") if active_only else symbols).orderBy("symbol")


def chart(bars: DataFrame, indicators: DataFrame, live: DataFrame) -> DataFrame:
    """Bars with their indicators by time; a live bar takes the place of a stored one."""
    rows = bars.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)))
    rows = latest_per(rows, ["symbol", "ts"], "_p").drop("_p")
    return rows.join(indicators, ["symbol", "ts"], "left").orderBy("symbol", "ts")


def newest_of(live: DataFrame, stored: DataFrame) -> DataFrame:
    """By symbol the newer of two rows, the live one at the same time."""
    rows = stored.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)))
    return latest_per(rows, ["symbol"], "ts", ["_p"]).drop("_p")


def track_record(rows: DataFrame, keys: list[str] = []) -> DataFrame:
    """Resolved and pending predictions, hit rate, and the rate that always naming the commoner direction would have."""
    judged = F.col("is_correct").isNotNull()
    up = F.count_if(judged & (F.col("actual_direction") == "up"))
    n = F.count_if(judged)
    return rows.groupBy(*keys).agg(n.alias("resolved"), F.count_if(F.col("actual_direction").isNull()).alias("pending"), F.when(n > 0, F.count_if(F.col("is_correct")) / n).alias("hit_rate"), F.when(n > 0, F.greatest(up, n - up) / n).alias("majority_rate"))
