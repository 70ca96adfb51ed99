"""Technical indicators of bars, 18 columns; each is null until it is warm."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barflow.functions import rolling as R

VERSION = "1.0.0"
#: Fixed names of the snapshot's fields, in their order.
FIELDS = [
    "return_1", "log_return_1", "price_change", "volume_change_pct", "sma_20", "ema_12", "ema_26", "volatility_20", "volume_sma_20",
    "volume_ratio", "rsi_14", "macd", "macd_signal", "macd_hist", "bb_upper", "bb_middle", "bb_lower", "bb_width",
]


def _w(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("ts")


def returns(bars: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """price_change, return_1, log_return_1 and volume_change_pct against the bar before; the last is null after no volume."""
    w = _w(keys)
    prev, v = F.lag("close").over(w), F.lag("volume").over(w)
    return bars.withColumns({
        "price_change": F.col("close") - prev, "return_1": (F.col("close") - prev) / prev, "log_return_1": F.log(F.col("close") / prev),
        "volume_change_pct": F.when(v != 0, (F.col("volume") - v) / v),
    })


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0, keys: list[str] = ["symbol"]) -> DataFrame:
    """sma_20 = bb_middle, and bands at ``width`` population deviations."""
    w = _w(keys)
    mean, dev = R.full(F.avg, F.col("close"), w, n), R.full(F.stddev_pop, F.col("close"), w, n)
    df = bars.withColumns({"sma_20": mean, "bb_middle": mean, "bb_upper": mean + width * dev, "bb_lower": mean - width * dev})
    return df.withColumn("bb_width", F.when(F.col("sma_20") != 0, (F.col("bb_upper") - F.col("bb_lower")) / F.col("sma_20")))


def volatility(bars: DataFrame, n: int = 20, keys: list[str] = ["symbol"]) -> DataFrame:
    """Sample deviation of n log returns; needs log_return_1."""
    return bars.withColumn("volatility_20", R.full(F.stddev_samp, F.col("log_return_1"), _w(keys), n))


def volume(bars: DataFrame, n: int = 20, keys: list[str] = ["symbol"]) -> DataFrame:
    """Mean volume of n bars and the bar's ratio to it, null if that is 0."""
    df = bars.withColumn("volume_sma_20", R.full(F.avg, F.col("volume"), _w(keys), n))
    return df.withColumn("volume_ratio", F.when(F.col("volume_sma_20") != 0, F.col("volume") / F.col("volume_sma_20")))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, keys: list[str] = ["symbol"]) -> DataFrame:
    """ema_12, ema_26, macd from the slow span on, its average from the first macd (shown ``signal`` later), and the difference."""
    df = R.ema(bars, "close", "ema_12", fast, keys, "ts")
    df = R.ema(df, "close", "ema_26", slow, keys, "ts").withColumn("macd", F.col("ema_12") - F.col("ema_26"))
    return R.ema(df, "macd", "macd_signal", signal, keys, "ts").withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def rsi(bars: DataFrame, n: int = 14, keys: list[str] = ["symbol"], scale: float = 100.0, out: str = "rsi_14") -> DataFrame:
    """Relative strength by Wilder averages of gains and losses; without losses ``scale`` after gains and half of it else."""
    change = F.col("close") - F.lag("close").over(_w(keys))
    df = bars.withColumn("_gain", F.greatest(change, F.when(change.isNotNull(), 0.0))).withColumn("_loss", F.greatest(-change, F.when(change.isNotNull(), 0.0)))
    df = R.wilder(R.wilder(df, "_gain", "_up", n, keys, "ts"), "_loss", "_down", n, keys, "ts")
    value = F.when(F.col("_down") == 0, F.when(F.col("_up") > 0, scale).otherwise(scale / 2)).otherwise(scale - scale / (1 + F.col("_up") / F.col("_down")))
    return df.withColumn(out, F.when(F.col("_up").isNotNull(), value)).drop("_gain", "_loss", "_up", "_down")


def indicators(bars: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """All 18 columns. Everything runs over one partitioning by ``keys``; gaps don't reset anything."""
    return rsi(macd(volume(volatility(bollinger(returns(bars, keys), keys=keys), keys=keys), keys=keys), keys=keys), keys=keys)


def snapshot(bars: DataFrame, keys: list[str] = ["symbol"]) -> DataFrame:
    """Bars with the struct ``indicators`` and ``indicator_version``."""
    return indicators(bars, keys).select(*bars.columns, F.struct(*FIELDS).alias("indicators"), F.lit(VERSION).alias("indicator_version"))
