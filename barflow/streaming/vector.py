"""What a symbol's state makes of a run of new bars: numpy over the run, with the state's last bars in front.

Only the recursive averages and the policy walk row by row, over plain numbers. States are dictionaries of numbers and short lists,
bounded whatever the length of a stream, and are stored by their typed schemas.
"""

from __future__ import annotations

from collections import deque
from math import isnan

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from barflow.functions.timegrid import SECONDS
from barflow.operators.detectors import Limits, zscores
from barflow.operators.features import NAMES, WARM
from barflow.operators.indicators import FIELDS

#: Processed ids that a symbol remembers, and the last closes and volumes that it keeps.
MEMORY, CLOSES, VOLUMES = 256, 21, 120
_AVERAGES = "n long, ema_12 double, ema_26 double, signal double, up double, down double"
SYMBOL = f"interval string, last_ts double, {_AVERAGES}, ids array<string>, closes array<double>, volumes array<double>, kept array<double>"
FEATURE = f"last_ts double, seen long, {_AVERAGES}, reach double, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>"


def averaged(state: dict, closes: np.ndarray, before: float | None) -> dict[str, np.ndarray]:
    """Recursive averages of closes after each of them: MACD's and Wilder's, started as in batch; changes the state."""
    n, e12, e26, signal, up, down = (state[c] for c in ("n", "ema_12", "ema_26", "signal", "up", "down"))
    out = np.empty((len(closes), 5))
    for i, c in enumerate(closes.tolist()):
        n += 1
        if n == 1:
            e12 = e26 = c
        else:
            e12 += (c - e12) * 2 / 13
            e26 += (c - e26) * 2 / 27
        signal = e12 - e26 if n <= 26 else signal + (e12 - e26 - signal) / 5
        if before is not None:
            gain, loss = (c - before, 0.0) if c > before else (0.0, before - c)
            if n <= 15:
                up, down = up + gain / 14, down + loss / 14
            else:
                up, down = (up * 13 + gain) / 14, (down * 13 + loss) / 14
        before = c
        out[i] = e12, e26, signal, up, down
    state |= {"n": n, "ema_12": e12, "ema_26": e26, "signal": signal, "up": up, "down": down}
    return dict(zip(("ema_12", "ema_26", "signal", "up", "down"), out.T))


def strength(up: np.ndarray, down: np.ndarray, scale: float) -> np.ndarray:
    """Relative strength of Wilder's averages."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(down == 0, np.where(up > 0, scale, scale / 2), scale - scale / (1 + up / down))


def windows(values: np.ndarray, size: int, last: int) -> np.ndarray:
    """The windows of ``size`` values that end at each of the ``last`` ones; of NaN where there are too few."""
    if short := max(0, size - 1 + last - len(values)):
        values = np.concatenate([np.full(short, np.nan), values])
    return sliding_window_view(values[len(values) - size + 1 - last :], size)


def new_symbol(interval: str = "") -> dict:
    return {"interval": interval, "last_ts": None, "n": 0, "ema_12": 0.0, "ema_26": 0.0, "signal": 0.0, "up": 0.0, "down": 0.0, "ids": [], "closes": [], "volumes": [], "kept": []}


def judged(state: dict, intervals: list[str], times: list[float], ids: list[str]) -> tuple[list[str], list[int], list[list[int]], dict]:
    """(outcomes, skipped bars, runs of processed rows, what the state then holds of the policy). Every run but the first begins a new state.

    A change of interval forgets everything first; then a row is a duplicate by the last processed time or the last ``MEMORY`` processed
    ids, late, or processed.
    """
    outcomes, missing, runs = [], [], [[]]
    interval, last, recent = state["interval"], state["last_ts"], deque(state["ids"], MEMORY)
    seen = set(recent)
    for i, (kind, ts, key) in enumerate(zip(intervals, times, ids)):
        if kind != interval:
            interval, last, recent, seen = kind, None, deque([], MEMORY), set()
            runs.append([])
        skipped, outcome = 0, "processed"
        if ts == last or key in seen:
            outcome = "duplicate"
        elif last is not None and ts < last:
            outcome = "late"
        else:
            if last is not None:
                skipped = max(0, round((ts - last) / SECONDS[kind]) - 1)
            last = ts
            if len(recent) == MEMORY:
                seen.discard(recent[0])
            recent.append(key)
            seen.add(key)
            runs[-1].append(i)
        outcomes.append(outcome)
        missing.append(skipped)
    return outcomes, missing, runs, {"interval": interval, "last_ts": last, "ids": list(recent)}


def pushed(state: dict, close: np.ndarray, volume: np.ndarray, limits: Limits) -> tuple[dict[str, np.ndarray], dict[int, list[tuple]]]:
    """All indicators after each bar (NaN: none yet), and by bar what the detectors find: (detector, type, observed, expected, score,
    threshold)."""
    k, n0 = len(close), state["n"]
    n = n0 + 1 + np.arange(k)
    closes, volumes = np.concatenate([state["closes"], close]), np.concatenate([state["volumes"], volume])
    prev, before = windows(closes, 2, k)[:, 0], windows(volumes, 2, k)[:, 0]
    a = averaged(state, close, state["closes"][-1] if state["closes"] else None)
    shown = lambda x, least: np.where(n >= least, x, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        returns = np.log(close / prev)
        w, usual = windows(closes, 20, k), windows(volumes, 20, k).mean(axis=1)
        mean, dev = w.mean(axis=1), w.std(axis=1)
        logs = np.log(closes[1:] / closes[:-1])
        out = {
            "price_change": close - prev, "return_1": (close - prev) / prev, "log_return_1": returns, "volume_change_pct": np.where(before != 0, (volume - before) / before, np.nan),
            "sma_20": mean, "bb_middle": mean, "bb_upper": mean + 2 * dev, "bb_lower": mean - 2 * dev, "bb_width": np.where(mean != 0, 4 * dev / mean, np.nan),
            "volatility_20": windows(logs, 20, k).std(axis=1, ddof=1), "volume_sma_20": usual, "volume_ratio": np.where(usual != 0, volume / usual, np.nan),
            "ema_12": shown(a["ema_12"], 12), "ema_26": shown(a["ema_26"], 26), "macd": shown(a["ema_12"] - a["ema_26"], 26), "macd_signal": shown(a["signal"], 34),
            "macd_hist": shown(a["ema_12"] - a["ema_26"] - a["signal"], 34), "rsi_14": shown(strength(a["up"], a["down"], 100.0), 15),
        }
        change = close / prev - 1
    found: dict[int, list[tuple]] = {}
    for i in np.flatnonzero(np.abs(change) > limits.return_limit).tolist():
        found.setdefault(i, []).append(("return_threshold", "price_spike" if change[i] > 0 else "price_drop", float(change[i]), 0.0, float(abs(change[i])), limits.return_limit))
    skip = int(k > 0 and isnan(prev[0]))
    z, state["kept"] = zscores(state["kept"], returns[skip:], limits)
    z = np.concatenate([np.full((skip, 3), np.nan), z])
    out["zscore"] = z[:, 0]
    for i in np.flatnonzero(~np.isnan(z[:, 0])).tolist():
        found.setdefault(i, []).append(("return_zscore", "price_spike" if z[i, 0] > 0 else "price_drop", float(returns[i]), float(z[i, 1]), float(abs(z[i, 0])), limits.z_limit))
    size, m = limits.volume_window, len(state["volumes"])
    median = np.full(k, np.nan)
    if k and m + k > size:  # windows that are full
        views = sliding_window_view(volumes[max(0, m - size) : -1], size)
        median[k - len(views) :] = np.median(views, axis=1)
    for i in range(min(k, max(0, size - m))):
        if m + i >= limits.volume_least:
            median[i] = np.median(volumes[: m + i])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(median > 0, volume / median, np.nan)
    for i in np.flatnonzero(ratio > limits.volume_ratio).tolist():
        found.setdefault(i, []).append(("volume_median", "volume_spike", float(volume[i]), float(median[i]), float(ratio[i]), limits.volume_ratio))
    state |= {"closes": closes[-CLOSES:].tolist(), "volumes": volumes[-max(VOLUMES, size) :].tolist()}
    return {c: out[c] for c in (*FIELDS, "zscore")}, found


def new_feature() -> dict:
    return {"last_ts": None, "seen": 0, "n": 0, "ema_12": 0.0, "ema_26": 0.0, "signal": 0.0, "up": 0.0, "down": 0.0, "reach": 0.0} | {c: [] for c in ("open", "high", "low", "close", "volume")}


def featured(state: dict, bars: dict[str, np.ndarray], weekday: np.ndarray, month: np.ndarray) -> dict[str, np.ndarray]:
    """The 28 features after each bar of one segment, NaN before ``WARM`` bars; changes the state."""
    k, n0 = len(bars["close"]), state["n"]
    o, h, low, c, v = (np.concatenate([state[x], bars[x]]) for x in ("open", "high", "low", "close", "volume"))
    before = state["close"][-1] if state["close"] else None
    a = averaged(state, bars["close"], before)
    prev = windows(c, 2, k)[:, 0]
    reach, value, out_reach = np.maximum(bars["high"], prev) - np.minimum(bars["low"], prev), state["reach"], np.empty(k)
    for i, x in enumerate(reach.tolist()):
        if not isnan(x):
            value = value + x / 14 if n0 + i + 1 <= 15 else (value * 13 + x) / 14
        out_reach[i] = value
    state["reach"] = value
    last = {x: y[len(y) - k :] for x, y in (("o", o), ("h", h), ("l", low), ("c", c), ("v", v))}
    close = last["c"]
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(c[1:] / c[:-1])
        mean = {n: windows(c, n, k).mean(axis=1) for n in (10, 20, 50)}
        vol = {n: windows(logs, n, k).std(axis=1, ddof=1) for n in (10, 20, 60)}
        dev, ret, span = windows(c, 20, k).std(axis=1), windows(logs, 5, k), last["h"] - last["l"]
        out = {
            "ret_1": ret[:, 4], **{f"ret_{n}": np.log(close / windows(c, n + 1, k)[:, 0]) for n in (5, 10, 20)}, **{f"ret_lag_{n}": ret[:, 4 - n] for n in (1, 2, 3, 4)}, "gap": np.log(last["o"] / prev), "hl_range": span / close,
            "close_pos": np.where(span > 0, (close - last["l"]) / span, 0.5), **{f"close_sma{n}": close / m - 1 for n, m in mean.items()}, "sma10_sma50": mean[10] / mean[50] - 1, "macd_norm": (a["ema_12"] - a["ema_26"]) / close,
            "macd_hist_norm": (a["ema_12"] - a["ema_26"] - a["signal"]) / close, "vol_10": vol[10], "vol_20": vol[20], "vol_ratio_10_60": np.where(vol[60] != 0, vol[10] / vol[60], np.nan), "atr_14_norm": out_reach / close,
            "bb_width_20": 4 * dev / mean[20], "bb_pos_20": np.where(dev == 0, 0.5, (close - (mean[20] - 2 * dev)) / (4 * dev)), "rsi_14": strength(a["up"], a["down"], 1.0),
            "volume_ratio_20": np.log((last["v"] + 1) / (windows(v, 20, k).mean(axis=1) + 1)), "volume_change": np.log((last["v"] + 1) / (windows(v, 2, k)[:, 0] + 1)), "day_of_week": weekday.astype(float), "month": month.astype(float),
        }
    ready = (n0 + 1 + np.arange(k) >= WARM) & ~np.isnan(np.stack([out[n] for n in NAMES])).any(axis=0)
    state |= {x: y[-WARM:].tolist() for x, y in (("open", o), ("high", h), ("low", low), ("close", c), ("volume", v))}
    return {n: np.where(ready, out[n], np.nan) for n in NAMES} | {"ready": ready}
