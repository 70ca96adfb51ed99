"""Model monitoring: distribution profiles, PSI and KS drift, outcome resolution, performance and the signal to retrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions import timegrid as G
from barflow.functions.ranks import bisected, quantiles, ranked
from barflow.sources.session import checkpointed, few

#: Fixed limits: clip of a proportion, PSI bands, least samples, KS level, log-loss margin, share of drifted features.
CLIP, WARNING, ALERT = 1e-4, 0.10, 0.25
DRIFT_LEAST, KS_LEVEL, PERFORMANCE_LEAST, LOSS_MARGIN, RETRAIN_SHARE = 200, 0.001, 100, 0.01, 0.30


def unpivoted(df: DataFrame, features: list[str], keys: list[str] = []) -> DataFrame:
    """(keys, feature, value) of finite values."""
    rows = df.select(*keys, F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))])).alias("feature", "value"))
    return rows.where("value is not null and not isnan(value) and abs(value) < double('infinity')")


def cells(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, c): each distinct value once, with its number. What else is asked of the values is asked of these."""
    return rows if "c" in rows.columns else rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))


def profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """edges (distinct inner deciles), quantiles (101), proportions of the bins between the edges, and n, of each key's values; checkpointed, a
    row a key."""
    rows = checkpointed(ranked(cells(rows, keys), keys))
    stats = checkpointed(quantiles(rows, keys))
    stats = stats.withColumn("edges", F.array_distinct(F.array(*[F.element_at("quantiles", 10 * k + 1) for k in range(1, 10)])))
    return checkpointed(stats.join(binned(rows, stats, keys), keys))


def binned(rows: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, proportions): the share of the values in each bin of the checkpointed profiles, empty bins included. Values are counted where
    they are; only the counts of bins move."""
    rows = rows if "c" in rows.columns else rows.withColumn("c", F.lit(1).cast("long"))
    df = bisected(rows.join(few(profiles.select(*keys, "edges")), keys), "bin", "edges", "value")
    counts = df.groupBy(*keys, "edges", "bin").agg(F.sum("c").alias("c"))
    maps = counts.groupBy(*keys, "edges").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("m"), F.sum("c").alias("t"))
    shares = F.transform(F.sequence(F.lit(0), F.size("edges")), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)) / F.col("t"))
    return maps.select(*keys, shares.alias("proportions"))


def psi(actual: Column, reference: Column, clip: float = CLIP) -> Column:
    """Population stability index of two arrays of proportions."""
    pairs = F.zip_with(actual, reference, lambda a, r: F.struct(F.greatest(a, F.lit(clip)).alias("a"), F.greatest(r, F.lit(clip)).alias("r")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - p["r"]) * F.log(p["a"] / p["r"]))


def psi_status(x: Column) -> Column:
    return F.when(F.isnan(x) | (x < WARNING), "ok").when(x < ALERT, "warning").otherwise("alert")


def ks(ranks: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, ks, p_value): Kolmogorov's distance of ``ranked`` values from the checkpointed profiles' interpolated distribution.

    The distribution rises linearly between the 101 quantiles; at tied quantiles the last one counts.
    """
    df = ranks.join(few(profiles.select(*keys, "quantiles")), keys)
    q, v = F.col("quantiles"), F.col("value")
    df = bisected(df, "_i", "quantiles", "value", equal=True)  # knots at or below
    low, high = F.get(q, F.col("_i") - 1), F.get(q, F.col("_i"))
    cdf = F.when(F.col("_i") == 0, 0.0).when(F.col("_i") == F.size(q), 1.0).otherwise((F.col("_i") - 1 + F.try_divide(v - low, high - low)) / (F.size(q) - 1))
    gap = F.greatest(F.col("upto") / F.col("n") - cdf, cdf - (F.col("upto") - F.col("c")) / F.col("n"))
    out = df.groupBy(*keys).agg(F.max(gap).alias("ks"), F.max("n").alias("n"))
    lam = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("ks")
    out = out.withColumn("_l", lam)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * F.col("_l") * F.col("_l")))
    p = F.when(F.col("_l") < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * series)))
    return out.select(*keys, "n", "ks", p.alias("p_value"))


def drift(live: DataFrame, profiles: DataFrame, keys: list[str], report_type: str = "data_drift", least: int = DRIFT_LEAST) -> DataFrame:
    """One report row per key with enough live values: PSI with its status, KS with rejection, both medians and the live mean; checkpointed."""
    ranks, profiles = checkpointed(ranked(cells(live, keys), keys).where(F.col("n") >= least)), checkpointed(profiles)
    n = ranks.groupBy(*keys).agg(F.max("n").alias("n"), (F.sum(F.col("value") * F.col("c")) / F.max("n")).alias("live_mean"))
    medians = quantiles(ranks, keys, 2).select(*keys, F.element_at("quantiles", 2).alias("live_median"))
    df = n.join(medians, keys).join(binned(ranks, profiles, keys), keys).join(profiles.select(*keys, F.col("proportions").alias("_r"), F.element_at("quantiles", 51).alias("reference_median")), keys)
    df = df.withColumn("psi", psi(F.col("proportions"), F.col("_r"))).withColumn("status", psi_status(F.col("psi")))
    tests = ks(ranks, profiles, keys).select(*keys, "ks", "p_value")
    found = df.join(tests, keys).select(F.lit(report_type).alias("report_type"), *keys, "n", "psi", "status", "ks", "p_value", (F.col("p_value") < KS_LEVEL).alias("ks_reject"), "live_median", "reference_median", "live_mean")
    return checkpointed(found)


#: Bars of a bucket of time in which predictions and bars meet.
_SPAN = 8


def resolved(predictions: DataFrame, bars: DataFrame, outcomes: DataFrame, since: Column, now: Column) -> DataFrame:
    """Outcomes of predictions whose target fell in (since, now] and that have none yet.

    The price then is the first close in [target, target + (target - ts)], the price before that of the bar at ts. Bars and
    predictions meet by symbol, interval and bucket of eight bars: a prediction asks the few buckets that its window touches, so
    that it meets no other bars and a symbol of many bars is many keys. A prediction without either price stays open. Run
    again, it resolves nothing twice.
    """
    due = predictions.where((F.col("target_ts") > since) & (F.col("target_ts") <= now)).join(outcomes.select("prediction_id"), "prediction_id", "left_anti")
    bucket = lambda micros: F.floor(micros / (G.duration(F.col("bar_interval")) * (_SPAN * 1_000_000)))
    b = bars.select("symbol", F.col("interval").alias("bar_interval"), F.col("ts").alias("bar_ts"), "close").withColumn("_bucket", bucket(F.unix_micros("bar_ts")))
    at = due.join(b.select("symbol", "bar_interval", F.col("bar_ts").alias("ts"), F.col("close").alias("close_then")), ["symbol", "bar_interval", "ts"])
    target = F.unix_micros("target_ts")
    limit = 2 * target - F.unix_micros("ts")
    asks = at.withColumn("_limit", F.timestamp_micros(limit)).withColumn("_bucket", F.explode(F.sequence(bucket(target), bucket(limit))))
    later = asks.join(b, ["symbol", "bar_interval", "_bucket"]).where((F.col("bar_ts") >= F.col("target_ts")) & (F.col("bar_ts") <= F.col("_limit")))
    first = later.groupBy("prediction_id").agg(F.min_by("close", "bar_ts").alias("close_after"), F.any_value("close_then").alias("close_then"), F.any_value("predicted_direction").alias("d"), F.any_value("predicted_return").alias("r"))
    real = F.log(F.col("close_after") / F.col("close_then"))
    first = first.withColumn("actual_return", real).withColumn("actual_direction", F.when(real > 0, "up").when(real < 0, "down").otherwise("neutral"))
    right = F.when(F.col("actual_direction") != "neutral", F.col("d") == F.col("actual_direction"))
    return first.select("prediction_id", "actual_return", "actual_direction", right.alias("is_correct"), F.abs(F.col("r") - F.col("actual_return")).alias("abs_error"), now.alias("resolved_at"))


def window(predictions: DataFrame, outcomes: DataFrame, start: Column, end: Column, limit: int) -> DataFrame:
    """The newest ``limit`` predictions of a direction with ts in (start, end], with P(up) and what came of them."""
    predictions = predictions.where("task = 'direction'") if "task" in predictions.columns else predictions
    rows = predictions.where((F.col("ts") > start) & (F.col("ts") <= end)).orderBy(F.desc("ts"), "prediction_id").limit(limit)
    return rows.withColumn("p_up", F.col("class_probabilities")["up"]).join(outcomes.select("prediction_id", "actual_direction", "is_correct"), "prediction_id", "left")


def performance(rows: DataFrame, base_rates: DataFrame, keys: list[str], least: int = PERFORMANCE_LEAST) -> DataFrame:
    """Log loss against that of the training base rate (0.5 if unknown), and accuracy against the majority, with the status."""
    df = rows.where("actual_direction in ('up', 'down') and p_up is not null").join(base_rates, keys, "left").withColumn("_y", (F.col("actual_direction") == "up").cast("double"))
    loss = lambda p: F.avg(-(F.col("_y") * F.log(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))) + (1 - F.col("_y")) * F.log(1 - F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)))))
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), loss(F.col("p_up")).alias("log_loss"), loss(F.coalesce("base_rate", F.lit(0.5))).alias("null_log_loss"),
        F.any_value(F.coalesce("base_rate", F.lit(0.5))).alias("base_rate"), F.avg(((F.col("p_up") >= 0.5) == (F.col("_y") == 1)).cast("double")).alias("accuracy"), F.greatest(F.avg("_y"), 1 - F.avg("_y")).alias("majority"),
    ).where(F.col("n") >= least)
    excess = F.col("log_loss") - F.col("null_log_loss")
    return out.withColumn("excess", excess).withColumn("edge", F.col("accuracy") - F.col("majority")).withColumn("status", F.when(excess > LOSS_MARGIN, "alert").otherwise("ok"))


def retrain(drifts: DataFrame, performances: DataFrame, keys: list[str]) -> DataFrame:
    """Per model: the share of features in alert, which ones, whether performance is, and whether to retrain."""
    d = drifts.groupBy(*keys).agg(F.count_if(F.col("status") == "alert").alias("drifted"), F.count(F.lit(1)).alias("features"), F.array_sort(F.collect_list(F.when(F.col("status") == "alert", F.col("feature")))).alias("which"))
    p = performances.groupBy(*keys).agg(F.bool_or(F.col("status") == "alert").alias("bad"))
    df = d.join(p, keys, "full").na.fill(0, ["drifted", "features"]).withColumn("bad", F.coalesce("bad", F.lit(False)))
    share = F.when(F.col("features") > 0, F.col("drifted") / F.col("features")).otherwise(0.0)
    return df.select(*keys, "drifted", "features", share.alias("share"), F.array_join("which", ",").alias("drifted_features"), F.col("bad").alias("performance_alert"), ((share >= RETRAIN_SHARE) | F.col("bad")).alias("retrain"))


def as_reports(df: DataFrame, metrics: list[str], created_at: Column) -> DataFrame:
    """Wide results as the long rows of a report table, all with one time of creation."""
    cells = F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric_name", "value")
    return df.select(*[c for c in df.columns if c not in metrics], cells, created_at.alias("created_at"))


P_UP = "p_up"


def reference_profile(train: DataFrame, features: list[str], scored: DataFrame, keys: list[str]) -> DataFrame:
    """``profile`` of a model's training features and, under the feature p_up, of its ``scored`` rows of their last year (session_date,
    p_up); each row with the share of up labels (y_up) as base_rate."""
    last = scored.groupBy(*keys).agg(F.add_months(F.max("session_date"), -12).alias("_cut"))
    recent = scored.join(last, keys).where(F.col("session_date") > F.col("_cut"))
    rows = unpivoted(train, features, keys).unionByName(unpivoted(recent, [P_UP], keys))
    return profile(rows, [*keys, "feature"]).join(train.groupBy(*keys).agg(F.avg("y_up").alias("base_rate")), keys)


#: Hours in which outcomes are sought and of which predictions are judged, and the newest predictions that are.
LOOKBACK, SPAN, ROWS = "336 hours", "24 hours", 200_000


def reports(df: DataFrame, keys: list[str], kind: str | Column, metric: str, value: Column, status: Column | str, threshold: float | None = None, feature: Column | None = None, details: list[Column] = []) -> DataFrame:
    """Rows of the report table: one metric of ``df``, with its threshold and what else there is to say as JSON."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(
        lit(kind).alias("report_type"), *keys, F.lit(metric).alias("metric_name"), (F.lit(None) if feature is None else feature).cast("string").alias("feature_name"), value.cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold"), lit(status).alias("status"), F.to_json(F.struct(*details)).alias("details"),
    )


def missing_reports(models: DataFrame, profiles: DataFrame, keys: list[str]) -> DataFrame:
    """A report row for every served model version that no profile describes: nothing is said of its drift, and its base rate counts as 0.5."""
    lost = models.select(*keys).distinct().join(profiles.select(*keys), keys, "left_anti")
    return reports(lost, keys, "operational", "reference_profile_missing", F.lit(1.0), "warning", details=[F.lit("no drift is judged for this version").alias("effect")])


def cycle(
    predictions: DataFrame, bars: DataFrame, outcomes: DataFrame, profiles: DataFrame, keys: list[str], now: Column, lookback: str = LOOKBACK, span: str = SPAN, most: int = ROWS, samples: int = DRIFT_LEAST, resolved_least: int = PERFORMANCE_LEAST
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, reports) of one run at ``now``: what newly came of predictions, and the checks of the window before ``now``.

    Predictions carry their ``features``. Of a served model version without a profile (``reference_profile``) the reports say so and
    nothing of drift. Others get a PSI of each feature and of P(up), with its KS test in the details, where there are ``samples``
    values. Each with ``resolved_least`` outcomes gets its log loss less that of its base rate, 0.5 if that is not known, and its accuracy less the
    majority's share. It is asked to retrain where enough features or its loss are in alert. Reports are rows of the report table:
    (report_type, keys, metric_name, feature_name, value, threshold, status, details, window_start, window_end, created_at).
    """
    predictions, profiles = checkpointed(predictions), checkpointed(profiles)
    new = checkpointed(resolved(predictions, bars, outcomes, now - F.expr(f"interval {lookback}"), now))
    every = outcomes.select("prediction_id", "actual_direction", "is_correct").unionByName(new.select("prediction_id", "actual_direction", "is_correct"))
    start = now - F.expr(f"interval {span}")
    rows = checkpointed(window(predictions, every, start, now, most))
    served = rows.select(*keys).distinct()
    live = rows.select(*keys, F.explode("features").alias("feature", "value")).unionByName(rows.select(*keys, F.lit(P_UP).alias("feature"), F.col("p_up").alias("value")))
    live = live.where("value is not null and not isnan(value) and abs(value) < double('infinity')")
    found = drift(live.join(profiles.select(*keys).distinct(), keys, "left_semi"), profiles, [*keys, "feature"], least=samples)
    inputs, output = found.where(F.col("feature") != P_UP), found.where(F.col("feature") == P_UP)
    done = checkpointed(performance(rows, profiles.select(*keys, "base_rate").distinct(), keys, resolved_least))
    again = retrain(inputs, done, keys).where("retrain")
    as_ = lambda c, name: F.col(c).alias(name)
    why = F.filter(F.array(F.when(F.col("share") >= RETRAIN_SHARE, F.concat_ws("", F.col("drifted"), F.lit("/"), F.col("features"), F.lit(" features in alert"))), F.when(F.col("performance_alert"), F.lit("log loss in alert"))), lambda x: x.isNotNull())
    parts = [
        reports(inputs, keys, "data_drift", "psi", F.col("psi"), F.col("status"), ALERT, F.col("feature"), [F.col("n"), as_("ks", "ks_statistic"), as_("p_value", "ks_p_value"), F.col("ks_reject"), F.col("live_median"), F.col("reference_median")]),
        reports(output, keys, "prediction_drift", "psi", F.col("psi"), F.col("status"), ALERT, None, [F.col("n"), as_("live_mean", "live_mean_p_up"), as_("reference_median", "reference_median_p_up")]),
        reports(done, keys, "performance", "log_loss_minus_null", F.col("excess"), F.col("status"), LOSS_MARGIN, None, [F.col("n"), F.col("null_log_loss"), as_("base_rate", "training_base_rate"), F.col("accuracy"), as_("majority", "live_majority_rate")]),
        reports(done, keys, "performance", "accuracy_minus_majority", F.col("edge"), "ok", None, None, [F.col("n"), F.col("accuracy"), as_("majority", "live_majority_rate")]),
        reports(again, keys, "operational", "retrain_recommended", F.lit(1.0), "warning", RETRAIN_SHARE, None, [why.alias("reasons"), F.filter(F.split(F.coalesce("drifted_features", F.lit("")), ","), lambda x: x != "").alias("drifted_features")]),
    ]
    out = missing_reports(served, profiles, keys)
    for part in parts:
        out = out.unionByName(part)
    return new, out.withColumns({"window_start": start, "window_end": now, "created_at": now})
