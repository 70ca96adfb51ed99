"""Small series in closed form for tests."""

import datetime as dt

import numpy as np
import pandas as pd


def series(symbol="AAA", n=400, seed=1, start="2016-01-04", freq="D"):
    """A price that swings by two waves of periods that never meet; each bar opens midway and reaches a little beyond both ends."""
    i = np.arange(n)
    level = np.log(80) + 0.05 * np.sin(0.91 * i + seed) + 0.03 * np.cos(2.3 * i + 2 * seed) + 0.0004 * i
    last = np.exp(level)
    first = np.sqrt(last * np.exp(np.roll(level, 1)))
    first[0] = last[0] * 0.999
    reach = 0.2 + 0.1 * (i * 7 % 5)
    prices = {"open": first, "high": np.maximum(first, last) + reach, "low": np.minimum(first, last) - reach, "close": last}
    return pd.DataFrame({"symbol": symbol, "ts": pd.date_range(start, periods=n, freq=freq), **prices, "volume": 4000 + (i * 37 + 11 * seed) % 2500, "interval": "1d"})


def frame(spark, *parts):
    return spark.createDataFrame(pd.concat(parts, ignore_index=True))


def at(hour, minute=0, day=5):
    return dt.datetime(2026, 1, day, hour, minute)
