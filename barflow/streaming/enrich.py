"""Keyed stateful processing of streams of bars: enrichment with anomalies, and features for scoring.

Symbols are dealt to buckets, and a bucket holds its symbols' typed states in a map of the state store. So the least recently updated
symbol can be forgotten when there are too many, a batch costs one call a bucket, and only states of symbols that it holds are read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from barflow.operators import contract
from barflow.operators.detectors import VERSION, Limits, severity
from barflow.operators.features import NAMES
from barflow.operators.indicators import FIELDS
from barflow.streaming import vector as V

#: Buckets of symbols (of which each is at most one task), symbols remembered in all of them, and messages a partition read again to begin with.
BUCKETS, SYMBOLS, WARM_UP = 64, 10_000, 2_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_VALUES = [*FIELDS, "zscore"]
_FOUND = "array<struct<detector:string,anomaly_type:string,observed_value:double,expected_value:double,score:double,threshold:double>>"
OUTPUT = f"symbol string, interval string, ts timestamp, event_id string, outcome string, missing_bars int, close double, {', '.join(f'{n} double' for n in _VALUES)}, found {_FOUND}"
FEATURES = f"symbol string, interval string, ts timestamp, event_id string, status string, {', '.join(f'{n} double' for n in NAMES)}"
_HIT = ("detector", "anomaly_type", "observed_value", "expected_value", "score", "threshold")


@dataclass(frozen=True)
class Kernel:
    """How a symbol's rows change its state and what they give: ``step`` takes (state, rows) and returns a column each of the output."""

    state: str
    output: str
    new: Callable[[], dict]
    step: Callable[[dict, pd.DataFrame], dict]


def enrichment(limits: Limits) -> Kernel:
    def step(state: dict, rows: pd.DataFrame) -> dict:
        times = (rows["ts"].astype("datetime64[us]").astype("int64") / 1e6).tolist()
        outcomes, missing, runs, policy = V.judged(state, rows["interval"].tolist(), times, rows["event_id"].tolist())
        close, volume = rows["close"].to_numpy(float), rows["volume"].to_numpy(float)
        values, found = {c: np.full(len(rows), np.nan) for c in _VALUES}, np.empty(len(rows), object)
        found[:] = [[] for _ in range(len(rows))]
        for j, run in enumerate(runs):
            if j:
                state |= V.new_symbol()
            if run:
                indicators, hits = V.pushed(state, close[run], volume[run], limits)
                for c in _VALUES:
                    values[c][run] = indicators[c]
                for i, x in hits.items():
                    found[run[i]] = [dict(zip(_HIT, h)) for h in x]
        state |= policy
        return {"symbol": rows["symbol"], "interval": rows["interval"], "ts": rows["ts"], "event_id": rows["event_id"], "outcome": outcomes, "missing_bars": np.array(missing, np.int32), "close": close, **values, "found": found}

    return Kernel(V.SYMBOL, OUTPUT, V.new_symbol, step)


def featuring(every: int) -> Kernel:
    def step(state: dict, rows: pd.DataFrame) -> dict:
        times = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
        before = np.maximum.accumulate(np.concatenate([[-np.inf if state["last_ts"] is None else state["last_ts"]], times]))[:-1]
        fresh = np.flatnonzero(times > before)
        status, values = np.full(len(rows), "stale", object), {c: np.full(len(rows), np.nan) for c in NAMES}
        cuts = np.flatnonzero(rows["gap_before"].to_numpy()[fresh] > 0)
        for a, b in zip([0, *cuts], [*cuts, len(fresh)]):
            if a in cuts:
                state |= V.new_feature() | {"seen": state["seen"]}
            run = fresh[a:b]
            if len(run):
                bars = {c: rows[c].to_numpy(float)[run] for c in ("open", "high", "low", "close", "volume")}
                out = V.featured(state, bars, rows["ts"].dt.weekday.to_numpy()[run], rows["ts"].dt.month.to_numpy()[run])
                seen = state["seen"] + 1 + np.arange(len(run))
                status[run] = np.where(~out["ready"], "not_ready", np.where(seen % every != 0, "sampled_out", "ready"))
                for c in NAMES:
                    values[c][run] = np.where(status[run] == "ready", out[c], np.nan)
                state["seen"] = int(seen[-1])
        if len(fresh):
            state["last_ts"] = float(times[fresh[-1]])
        return {"symbol": rows["symbol"], "interval": rows["interval"], "ts": rows["ts"], "event_id": rows["event_id"], "status": status, **values}

    return Kernel(V.FEATURE, FEATURES, V.new_feature, step)


def evicted(order: OrderedDict, symbols: list[str], most: int) -> tuple[dict[str, list[int]], set[str]]:
    """(rows at which a symbol begins cold, symbols forgotten at the end) when at most so many are remembered; ``order`` holds the remembered
    ones, the least recently updated first, and is brought up to date."""
    cold: dict[str, list[int]] = {}
    gone = set()
    for i, symbol in enumerate(symbols):
        if symbol not in order:
            cold.setdefault(symbol, []).append(i)
            order[symbol] = None
            gone.discard(symbol)
            if len(order) > most:
                gone.add(order.popitem(last=False)[0])
        order.move_to_end(symbol)
    return cold, gone


class Bucket(StatefulProcessor):
    """One bucket's symbols: their states by symbol, when each was last updated, and how many there are."""

    def __init__(self, kernel: Kernel, most: int):
        self.kernel, self.most = kernel, most
        self.fields = StructType.fromDDL(kernel.state).names
        self.columns = StructType.fromDDL(kernel.output).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("states", "symbol string", self.kernel.state)
        self.recent = handle.getMapState("recent", "symbol string", "at long")
        self.clock = handle.getValueState("clock", "at long, held long")

    def handleInitialState(self, key, rows: pd.DataFrame, timers) -> None:
        at, held = self.clock.get() if self.clock.exists() else (0, 0)
        for r in rows.sort_values("at").to_dict("records"):
            at, held = at + 1, held + 1
            self.states.updateValue((r["symbol"],), tuple(_plain(r[c]) for c in self.fields))
            self.recent.updateValue((r["symbol"],), (at,))
        self.clock.update((at, held))

    def handleInputRows(self, key, frames: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames), ignore_index=True).sort_values("arrival", kind="stable", ignore_index=True)
        at, held = self.clock.get() if self.clock.exists() else (0, 0)
        parts = {str(k): v for k, v in rows.groupby("symbol", sort=False).indices.items()}
        known = {s for s in parts if self.recent.containsKey((s,))}
        cold, gone = {s: [int(parts[s][0])] for s in parts if s not in known}, set()
        if held + len(cold) > self.most:
            order = OrderedDict((k[0], None) for k, _ in sorted(self.recent.iterator(), key=lambda x: x[1][0]))
            cold, gone = evicted(order, rows["symbol"].tolist(), self.most)
            for symbol in gone - parts.keys():
                self.states.removeKey((symbol,))
                self.recent.removeKey((symbol,))
            held = len(order)
        else:
            held += len(cold)
        out = []
        for symbol, places in parts.items():
            begins = cold.get(symbol, [])
            state = self.kernel.new() if symbol not in known or places[0] in begins else dict(zip(self.fields, map(_listed, self.states.getValue((symbol,)))))
            for a, b in zip([0, *np.searchsorted(places, begins[places[0] in begins :])], [*np.searchsorted(places, begins[places[0] in begins :]), len(places)]):
                if a:
                    state = self.kernel.new()
                out.append(pd.DataFrame(self.kernel.step(state, rows.iloc[places[a:b]]))[self.columns])
            if symbol in gone:
                if symbol in known:
                    self.states.removeKey((symbol,))
                    self.recent.removeKey((symbol,))
            else:
                self.states.updateValue((symbol,), tuple(_plain(state[c]) for c in self.fields))
                self.recent.updateValue((symbol,), (at + 1 + int(places[-1]),))
        self.clock.update((at + len(rows), held))
        found = pd.concat(out).sort_index()
        yield found[~rows["warming"].to_numpy(bool)]

    def close(self) -> None:
        pass


def _plain(x: object) -> object:
    """A value for the state store."""
    if isinstance(x, np.generic):
        x = x.item()
    if isinstance(x, (list, tuple, np.ndarray)):
        return [_plain(v) for v in x]
    return None if isinstance(x, float) and x != x else x


def _listed(x: object) -> object:
    return list(x) if isinstance(x, (list, tuple, np.ndarray)) else x


def bucket(symbol: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(symbol), F.lit(buckets)).cast("int")


def _ready(bars: DataFrame) -> DataFrame:
    for name, value in (("warming", F.lit(False)), ("volume", F.lit(0.0))):
        if name not in bars.columns:
            bars = bars.withColumn(name, value)
    return bars


def _keyed(bars: DataFrame, kernel: Kernel, symbols: int, buckets: int, initial: DataFrame | None) -> DataFrame:
    """Rows of ``bars`` in order of arrival within a batch; rows marked ``warming`` change states and give none."""
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    start = initial.groupBy("bucket") if initial is not None else None
    keyed = _ready(bars).withColumn("bucket", bucket(F.col("symbol"), buckets)).groupBy("bucket")
    return keyed.transformWithStateInPandas(Bucket(kernel, -(-symbols // buckets)), kernel.output, "Append", "None", initialState=start)


def states_of(bars: DataFrame, kernel: Kernel, buckets: int = BUCKETS) -> DataFrame:
    """The state of each symbol after ``bars``, a batch, with its bucket and its last arrival: what a stream can begin with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrival", kind="stable", ignore_index=True)
        state = kernel.new()
        kernel.step(state, pdf)
        return pd.DataFrame([{"symbol": pdf["symbol"][0], "at": int(pdf["arrival"].max()), **{k: _plain(v) for k, v in state.items()}}])

    found = _ready(bars).groupBy("symbol").applyInPandas(run, f"symbol string, at long, {kernel.state}")
    return found.withColumn("bucket", bucket(F.col("symbol"), buckets))


def enriched(bars: DataFrame, limits: Limits = Limits(), symbols: int = SYMBOLS, buckets: int = BUCKETS, history: DataFrame | None = None) -> DataFrame:
    """``bars(symbol, ts, interval, event_id, arrival, close, volume)`` with outcome, skipped bars, all indicators and what the
    detectors find, in order of arrival within a batch.

    Each bucket remembers its share of ``symbols``, the most recently updated ones: a symbol that was forgotten begins again, and state has a
    bound however many symbols a stream brings. Rows with ``warming`` true only fill the state. ``history``, a batch of the same columns
    (``bootstrap.history``), fills it before the stream's first row.
    """
    kernel = enrichment(limits)
    return _keyed(bars, kernel, symbols, buckets, None if history is None else states_of(history, kernel, buckets))


def anomalies(rows: DataFrame) -> DataFrame:
    """The anomalies of enriched rows, one row each, with the id that follows from its bar."""
    df = rows.select("symbol", "ts", "interval", F.col("event_id").alias("source_event_id"), F.explode("found").alias("d")).select("symbol", "ts", "interval", "source_event_id", "d.*", F.lit(VERSION).alias("detector_version"))
    return df.withColumn("severity", severity(F.col("score"), F.col("threshold"))).withColumn("anomaly_id", contract.derived_id(F.col("source_event_id"), F.col("detector"), F.col("anomaly_type")))


def featured(bars: DataFrame, every: int = 1, symbols: int = SYMBOLS, buckets: int = BUCKETS, history: DataFrame | None = None) -> DataFrame:
    """``bars(symbol, ts, interval, event_id, arrival, gap_before, open, high, low, close, volume)`` with the 28 features and status: stale,
    not_ready, sampled_out (but for each ``every``-th bar) or ready. A gap begins again. Bounds and history as in ``enriched``."""
    kernel = featuring(every)
    return _keyed(bars, kernel, symbols, buckets, None if history is None else states_of(history, kernel, buckets))
