"""One symbol's incremental state, as plain numbers: the duplicate/late/gap policy, indicators, detectors and features. Batch
queries use windows instead; tests hold the two against each other."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from math import log, sqrt

from barflow.functions.timegrid import SECONDS
from barflow.operators.detectors import Limits, ZScore
from barflow.operators.features import NAMES, WARM
from barflow.operators.indicators import FIELDS

MEMORY = 256


def _deviation(values: list[float], less: int) -> float:
    mean = sum(values) / len(values)
    return sqrt(sum((x - mean) ** 2 for x in values) / (len(values) - less))


@dataclass
class Averages:
    """Recursive averages of closes: MACD's and Wilder's, started as in batch."""

    n: int = 0
    ema_12: float = 0.0
    ema_26: float = 0.0
    signal: float = 0.0
    up: float = 0.0
    down: float = 0.0

    def push(self, close: float, before: float | None) -> None:
        self.n += 1
        first = self.n == 1
        self.ema_12 = close if first else self.ema_12 + (close - self.ema_12) * 2 / 13
        self.ema_26 = close if first else self.ema_26 + (close - self.ema_26) * 2 / 27
        self.signal = self.macd if self.n <= 26 else self.signal + (self.macd - self.signal) / 5
        if before is not None:
            gain, loss = max(close - before, 0.0), max(before - close, 0.0)
            self.up = self.up + gain / 14 if self.n <= 15 else (self.up * 13 + gain) / 14
            self.down = self.down + loss / 14 if self.n <= 15 else (self.down * 13 + loss) / 14

    @property
    def macd(self) -> float:
        return self.ema_12 - self.ema_26

    def strength(self, scale: float) -> float | None:
        if self.n < 15:
            return None
        return (scale if self.up > 0 else scale / 2) if self.down == 0 else scale - scale / (1 + self.up / self.down)


@dataclass
class SymbolState:
    """What a symbol remembers: bounded whatever the length of its stream."""

    interval: str = ""
    last_ts: float | None = None
    ids: deque = field(default_factory=lambda: deque(maxlen=MEMORY))
    closes: deque = field(default_factory=lambda: deque(maxlen=21))
    volumes: deque = field(default_factory=lambda: deque(maxlen=120))
    averages: Averages = field(default_factory=Averages)
    kept: list = field(default_factory=list)

    def outcome(self, interval: str, ts: float, event_id: str) -> str:
        """The policy's judgement; an interval change forgets everything first."""
        if interval != self.interval:
            self.__init__(interval=interval)
        if ts == self.last_ts or event_id in self.ids:
            return "duplicate"
        return "processed" if self.last_ts is None or ts > self.last_ts else "late"

    def missing(self, ts: float) -> int:
        """Bars that a processed one skips, half-even rounded."""
        return 0 if self.last_ts is None else max(0, round((ts - self.last_ts) / SECONDS[self.interval]) - 1)

    def push(self, ts: float, event_id: str, close: float, limits: Limits, volume: float = 0.0) -> tuple[dict[str, float | None], list[tuple]]:
        """Indicators after one more bar, and what the detectors find: (detector, type, observed, expected, score, threshold)."""
        prev = self.closes[-1] if self.closes else None
        seen, found, z = list(self.volumes)[-limits.volume_window :], [], None
        before = self.volumes[-1] if self.volumes else None
        self.last_ts = ts
        self.ids.append(event_id)
        self.closes.append(close)
        self.volumes.append(float(volume))
        a = self.averages
        a.push(close, prev)
        n, out = a.n, dict.fromkeys((*FIELDS, "zscore"))
        if prev is not None:
            change = close / prev - 1
            out |= {"price_change": close - prev, "return_1": (close - prev) / prev, "log_return_1": log(close / prev)}
            out["volume_change_pct"] = (volume - before) / before if before else None
            if abs(change) > limits.return_limit:
                found.append(("return_threshold", "price_spike" if change > 0 else "price_drop", change, 0.0, abs(change), limits.return_limit))
            score = ZScore(limits, self.kept)
            hit = score.push(log(close / prev))
            self.kept = score.kept
            if hit:
                z = hit[0]
                found.append(("return_zscore", "price_spike" if z > 0 else "price_drop", log(close / prev), hit[1], abs(z), limits.z_limit))
        if len(seen) >= limits.volume_least:
            s, half = sorted(seen), len(seen) // 2
            median = s[half] if len(s) % 2 else (s[half - 1] + s[half]) / 2
            if median > 0 and volume / median > limits.volume_ratio:
                found.append(("volume_median", "volume_spike", float(volume), median, volume / median, limits.volume_ratio))
        if n >= 20:
            last, volumes = list(self.closes)[-20:], list(self.volumes)[-20:]
            mean, dev, usual = sum(last) / 20, _deviation(last, 0), sum(volumes) / 20
            out |= {"sma_20": mean, "bb_middle": mean, "bb_upper": mean + 2 * dev, "bb_lower": mean - 2 * dev, "bb_width": 4 * dev / mean if mean else None}
            out |= {"volume_sma_20": usual, "volume_ratio": volume / usual if usual else None}
        if n >= 21:
            last = list(self.closes)
            out["volatility_20"] = _deviation([log(y / x) for x, y in zip(last, last[1:])], 1)
        out |= {"ema_12": a.ema_12 if n >= 12 else None, "ema_26": a.ema_26 if n >= 26 else None, "macd": a.macd if n >= 26 else None, "macd_signal": a.signal if n >= 34 else None}
        out |= {"macd_hist": a.macd - a.signal if n >= 34 else None, "rsi_14": a.strength(100.0), "zscore": z}
        return out, found


@dataclass
class FeatureState:
    """What live features need of a symbol: a segment's last bars and recursive averages. A gap begins a new segment."""

    last_ts: float | None = None
    seen: int = 0
    bars: deque = field(default_factory=lambda: deque(maxlen=WARM))
    no: int = 0
    averages: Averages = field(default_factory=Averages)
    range: float = 0.0

    def push(self, ts: float, gap: int, bar: tuple[float, float, float, float, float], weekday: int, month: int) -> dict[str, float | None] | None:
        """The 28 features after a bar (open, high, low, close, volume), or null while they aren't ready; stale bars change nothing."""
        if self.last_ts is not None and ts <= self.last_ts:
            return None
        if gap > 0:
            self.bars.clear()
            self.no, self.averages, self.range = 0, Averages(), 0.0
        self.last_ts, self.seen, self.no = ts, self.seen + 1, self.no + 1
        prev = self.bars[-1][3] if self.bars else None
        o, high, low, close, volume = bar
        self.bars.append(bar)
        self.averages.push(close, prev)
        if prev is not None:
            reach = max(high, prev) - min(low, prev)
            self.range = self.range + reach / 14 if self.no <= 15 else (self.range * 13 + reach) / 14
        if self.no < WARM:
            return None
        c, v = [b[3] for b in self.bars], [b[4] for b in self.bars]
        returns = [log(y / x) for x, y in zip(c, c[1:])]
        mean = {n: sum(c[-n:]) / n for n in (10, 20, 50)}
        vol = {n: _deviation(returns[-n:], 1) for n in (10, 20, 60)}
        dev, a = _deviation(c[-20:], 0), self.averages
        out = {
            "ret_1": returns[-1], **{f"ret_{k}": log(close / c[-1 - k]) for k in (5, 10, 20)}, **{f"ret_lag_{k}": returns[-1 - k] for k in (1, 2, 3, 4)}, "gap": log(o / prev), "hl_range": (high - low) / close,
            "close_pos": (close - low) / (high - low) if high > low else 0.5, **{f"close_sma{n}": close / m - 1 for n, m in mean.items()}, "sma10_sma50": mean[10] / mean[50] - 1, "macd_norm": a.macd / close,
            "macd_hist_norm": (a.macd - a.signal) / close, "vol_10": vol[10], "vol_20": vol[20], "vol_ratio_10_60": vol[10] / vol[60] if vol[60] else None, "atr_14_norm": self.range / close, "bb_width_20": 4 * dev / mean[20],
            "bb_pos_20": 0.5 if dev == 0 else (close - (mean[20] - 2 * dev)) / (4 * dev), "rsi_14": a.strength(1.0), "volume_ratio_20": log((volume + 1) / (sum(v[-20:]) / 20 + 1)), "volume_change": log((volume + 1) / (v[-2] + 1)),
            "day_of_week": float(weekday), "month": float(month),
        }
        return None if any(out[n] is None for n in NAMES) else {n: out[n] for n in NAMES}
