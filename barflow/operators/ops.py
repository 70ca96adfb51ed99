"""Operational analytics: reconciliation, latency, lag, alerts, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.functions import rolling as R


def reconciled(sent: DataFrame, received: DataFrame) -> DataFrame:
    """One row of ``sent(id)`` against ``received(id, symbol, ts, arrival)``: sent, received, missing, duplicates, out of order.

    A row is out of order if it is older than the first arrival before it of its symbol.
    """
    first = received.groupBy("id").agg(F.min_by(F.struct("symbol", "ts", "arrival"), "arrival").alias("f"), F.count(F.lit(1)).alias("times"))
    first = first.select("id", "times", "f.*")
    w = Window.partitionBy("symbol").orderBy("arrival")
    order = first.withColumn("_back", (F.col("ts") < F.lag("ts").over(w)).cast("int")).agg(F.count(F.lit(1)).alias("received"), F.coalesce(F.sum(F.col("times") - 1), F.lit(0)).alias("duplicates"), F.coalesce(F.sum("_back"), F.lit(0)).alias("out_of_order"))
    lost = sent.select("id").distinct().withColumn("_s", F.lit(1)).join(first.select("id", "times"), "id", "left").agg(F.count(F.lit(1)).alias("sent"), F.count_if(F.col("times").isNull()).alias("missing"))
    return lost.crossJoin(F.broadcast(order))


def latency(df: DataFrame, x: str, keys: list[str] = []) -> DataFrame:
    """Mean, nearest-rank percentiles and maximum: the value at place ceil(q * n)."""
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by {x})").alias(f"p{round(q * 100)}")
    return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), at(0.5), at(0.9), at(0.95), at(0.99), F.max(x).alias("max"))


def rounded_percentile(df: DataFrame, x: str, q: float, keys: list[str] = []) -> DataFrame:
    """The value at index round(q * (n - 1)), halves to even."""
    w = Window.partitionBy(*keys)
    df = df.where(F.col(x).isNotNull()).withColumn("_i", F.row_number().over(w.orderBy(x)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return df.where(F.col("_i") == F.bround((F.col("_n") - 1) * q, 0)).select(*keys, F.col(x).alias("value"))


def largest_gap(df: DataFrame, ts: str, keys: list[str] = []) -> DataFrame:
    """The longest time, in seconds, between two rows on end."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumn("_g", (F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))) / 1e6).groupBy(*keys).agg(F.max("_g").alias("largest_gap_s"))


def arrivals(df: DataFrame, ts: str, unit: str, keys: list[str]) -> DataFrame:
    """Rows per unit of time, with zeros between the first and the last one of each key."""
    counts = df.groupBy(*keys, F.date_trunc(unit, F.col(ts)).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.groupBy(*keys).agg(F.explode(F.sequence(F.min("at"), F.max("at"), F.expr(f"interval 1 {unit}"))).alias("at"))
    return every.join(counts, [*keys, "at"], "left").na.fill(0, ["n"])


def first_after(df: DataFrame, ts: str, recovered: Column, keys: list[str]) -> DataFrame:
    """The first row after a recovery and how long it took."""
    first = F.min(F.when(F.col(ts) >= recovered, F.col(ts)))
    return df.groupBy(*keys).agg(first.alias("first_output")).withColumn("after_s", (F.unix_micros("first_output") - F.unix_micros(recovered)) / 1e6)


def lag(committed: DataFrame, bounds: DataFrame) -> DataFrame:
    """(group, topic, partition, lag): end less the committed offset, or less the lowest one if there is none, at least 0,
    for every partition of the topics that the group has committed on."""
    topics = committed.select("group", "topic").distinct()
    df = bounds.join(topics, "topic").join(committed, ["group", "topic", "partition"], "left")
    return df.select("group", "topic", "partition", F.greatest(F.lit(0), F.col("end") - F.coalesce("offset", "low")).alias("lag"))


def increase(samples: DataFrame, seconds: int, keys: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Increase of a counter over the window up to each sample, and per second; after a reset the new value counts whole."""
    w = Window.partitionBy(*keys).orderBy(ts)
    prev = F.lag(value).over(w)
    df = samples.withColumn("_d", F.when(prev.isNull(), 0.0).when(F.col(value) < prev, F.col(value)).otherwise(F.col(value) - prev))
    frame = Window.partitionBy(*keys).orderBy(F.unix_timestamp(ts)).rangeBetween(1 - seconds, 0)
    return df.withColumn("increase", F.sum("_d").over(frame)).withColumn("rate", F.col("increase") / seconds).drop("_d")


def histogram_quantile(buckets: DataFrame, q: float, keys: list[str]) -> DataFrame:
    """The q-quantile of cumulative ``buckets(le, count)``, linear within a bucket; the last finite bound if it lies beyond."""
    w = Window.partitionBy(*keys)
    before = w.orderBy("le")
    df = buckets.withColumn("_low", F.coalesce(F.lag("le").over(before), F.lit(0.0))).withColumn("_c0", F.coalesce(F.lag("count").over(before), F.lit(0))).withColumn("_rank", q * F.max("count").over(w))
    hit = df.where((F.col("count") >= F.col("_rank")) & (F.col("_c0") < F.col("_rank")))
    value = F.when(F.col("le") == float("inf"), F.col("_low")).otherwise(F.col("_low") + (F.col("le") - F.col("_low")) * (F.col("_rank") - F.col("_c0")) / (F.col("count") - F.col("_c0")))
    return hit.groupBy(*keys).agg(F.min(value).alias("quantile"))


def held(samples: DataFrame, condition: Column, seconds: int, keys: list[str], ts: str = "ts") -> DataFrame:
    """Stretches over which a condition held for ``seconds`` or longer: since, until, and when the alert fired."""
    w = Window.partitionBy(*keys).orderBy(ts)
    df = samples.withColumn("_c", F.coalesce(condition, F.lit(False)))
    df = df.withColumn("_run", F.sum((~F.col("_c")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_c")
    out = df.groupBy(*keys, "_run").agg(F.min(ts).alias("since"), F.max(ts).alias("until"))
    fired = F.timestamp_micros(F.unix_micros("since") + seconds * 1_000_000)
    return out.where(F.unix_micros("until") - F.unix_micros("since") >= seconds * 1_000_000).select(*keys, "since", "until", fired.alias("fired_at"))


def ratio_alert(df: DataFrame, part: Column, limit: float, keys: list[str]) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count_if(part).alias("part"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("ratio", F.col("part") / F.col("total")).withColumn("alert", F.col("ratio") > limit)


def count_alert(df: DataFrame, part: Column, least: int, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(part).alias("n")).withColumn("alert", F.col("n") >= least)


def calibration(bars: DataFrame, rows: int = 757, least: int = 60, days: int = 252) -> DataFrame:
    """Per symbol from its last ``rows`` usable bars: annual drift and volatility, median volume, spread of log volume, last
    close and the window. Symbols with fewer than ``least`` bars are left out."""
    usable = bars.where("close > 0 and volume > 0")
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    df = usable.withColumn("_n", nth).where(F.col("_n") <= rows)
    df = df.withColumn("_r", F.log(F.col("close") / F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))))
    out = df.groupBy("symbol").agg(
        F.round(F.avg("_r") * days, 4).alias("annual_drift"), F.round(F.stddev_samp("_r") * days**0.5, 4).alias("annual_volatility"), F.floor(R.median(F.col("volume").cast("double"))).cast("long").alias("median_volume"),
        F.round(F.stddev_samp(F.log("volume")), 4).alias("log_volume_sd"), F.round(F.max_by("close", "ts"), 6).alias("last_close"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"),
    )
    return out.where(F.col("n") >= least)
