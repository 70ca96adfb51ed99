"""Causal model features, 28 columns. A gap starts a new segment, and every window stays within its segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barflow.functions import rolling as R, timegrid as G
from barflow.operators import indicators as I

VERSION = "fs-1.0.0"
#: Fixed names and order of the features.
NAMES = [
    "ret_1", "ret_5", "ret_10", "ret_20", "ret_lag_1", "ret_lag_2", "ret_lag_3", "ret_lag_4", "gap", "hl_range", "close_pos", "close_sma10",
    "close_sma20", "close_sma50", "sma10_sma50", "macd_norm", "macd_hist_norm", "vol_10", "vol_20", "vol_ratio_10_60", "atr_14_norm",
    "bb_width_20", "bb_pos_20", "rsi_14", "volume_ratio_20", "volume_change", "day_of_week", "month",
]
#: Bars of a segment before its rows can be used.
WARM = 61


def with_gaps(bars: DataFrame, daily: bool = False) -> DataFrame:
    """gap_before: bars missing before each; daily bars count weekdays between the dates, so that a weekend is none."""
    w = Window.partitionBy("symbol").orderBy("ts")
    prev = F.lag("ts").over(w)
    missing = F.greatest(F.lit(0), G.weekdays_between(F.to_date(prev), F.to_date("ts")) - 1) if daily else G.missing_bars(prev, F.col("ts"), G.duration(F.col("interval")))
    return bars.withColumn("gap_before", F.coalesce(missing, F.lit(0)))


def with_segments(bars: DataFrame) -> DataFrame:
    """segment: a number that goes up at every gap; bar_no: the bar's place in its segment, from 1."""
    w = Window.partitionBy("symbol").orderBy("ts")
    df = bars.withColumn("segment", F.sum((F.col("gap_before") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("bar_no", F.row_number().over(Window.partitionBy("symbol", "segment").orderBy("ts")))


def features(bars: DataFrame) -> DataFrame:
    """Bars with gap_before -> the same with segment, bar_no, 28 features and ready."""
    keys = ["symbol", "segment"]
    df, w = with_segments(bars), Window.partitionBy("symbol", "segment").orderBy("ts")
    c, o, h, low, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    prev = F.lag("close").over(w)
    ret = F.log(c / prev)
    df = df.withColumn("ret_1", ret).withColumn("_tr", F.when(prev.isNotNull(), F.greatest(h, prev) - F.least(low, prev)))
    df = df.withColumns({f"ret_{k}": F.log(c / F.lag("close", k).over(w)) for k in (5, 10, 20)} | {f"ret_lag_{k}": F.lag("ret_1", k).over(w) for k in (1, 2, 3, 4)})
    sma = {n: R.full(F.avg, c, w, n) for n in (10, 20, 50)}
    vol = {n: R.full(F.stddev_samp, F.col("ret_1"), w, n) for n in (10, 20, 60)}
    dev, mean_v = R.full(F.stddev_pop, c, w, 20), R.full(F.avg, v, w, 20)
    df = df.withColumns({"_sma10": sma[10], "_sma20": sma[20], "_sma50": sma[50], "_dev": dev, "_vol60": vol[60], "vol_10": vol[10], "vol_20": vol[20]})
    df = df.withColumns({
        "gap": F.log(o / prev), "hl_range": (h - low) / c, "close_pos": F.when(h > low, (c - low) / (h - low)).otherwise(0.5),
        **{f"close_sma{n}": c / F.col(f"_sma{n}") - 1 for n in (10, 20, 50)}, "sma10_sma50": F.col("_sma10") / F.col("_sma50") - 1,
        "vol_ratio_10_60": F.when(F.col("_vol60") != 0, F.col("vol_10") / F.col("_vol60")),
        "bb_width_20": 4 * F.col("_dev") / F.col("_sma20"),
        "bb_pos_20": F.when(F.col("_dev") == 0, 0.5).otherwise((c - (F.col("_sma20") - 2 * F.col("_dev"))) / (4 * F.col("_dev"))),
        "volume_ratio_20": F.log((v + 1) / (mean_v + 1)), "volume_change": F.log((v + 1) / (F.lag("volume").over(w) + 1)),
        "day_of_week": F.weekday("ts").cast("double"), "month": F.month("ts").cast("double"),
    })
    df = R.wilder(df, "_tr", "_atr", 14, keys, "ts").withColumn("atr_14_norm", F.col("_atr") / c)
    df = I.rsi(I.macd(df, keys=keys), keys=keys, scale=1.0)
    df = df.withColumn("macd_norm", F.col("macd") / c).withColumn("macd_hist_norm", F.col("macd_hist") / c)
    ready = F.col("bar_no") >= WARM
    for name in NAMES:
        ready = ready & F.col(name).isNotNull()
    return df.select(*bars.columns, "segment", "bar_no", *NAMES, ready.alias("ready"))


def feature_map(df: DataFrame, out: str = "features") -> DataFrame:
    """The 28 columns as one map, the snapshot that a prediction keeps."""
    return df.withColumn(out, F.map_from_arrays(F.array(*[F.lit(n) for n in NAMES]), F.array(*NAMES)))


def sampled(df: DataFrame, every: int) -> DataFrame:
    """Every n-th bar of a symbol, as a live feed that predicts once in n bars."""
    seen = F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))
    return df.withColumn("_n", seen).where(F.col("_n") % every == 0).drop("_n")


def drop_stale(arrivals: DataFrame, order: str) -> DataFrame:
    """Rows, in arrival order, that are newer than all before them of their symbol."""
    before = F.max("ts").over(Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return arrivals.withColumn("_before", before).where("_before is null or ts > _before").drop("_before")
