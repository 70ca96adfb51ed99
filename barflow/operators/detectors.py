"""Anomaly detectors on prior-only baselines, and their score against labelled truth."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barflow.functions import ids, rolling as R
from barflow.sources.session import checkpointed

VERSION = "1.0.0"


@dataclass(frozen=True)
class Limits:
    """Thresholds, look-backs and least baselines of the three detectors."""

    return_limit: float = 0.01
    z_limit: float = 5.0
    z_window: int = 120
    z_least: int = 30
    volume_ratio: float = 6.0
    volume_window: int = 60
    volume_least: int = 20

    def __post_init__(self) -> None:
        if self.return_limit <= 0 or self.z_limit <= 0:
            raise ValueError("thresholds must be above 0")
        if self.volume_ratio <= 1:
            raise ValueError("the volume ratio must be above 1")
        if not 2 <= self.z_least <= self.z_window or not 1 <= self.volume_least <= self.volume_window:
            raise ValueError("a least baseline must fit its window")


def severity(score: Column, threshold: Column | float) -> Column:
    """low below 1.5 times the threshold, medium below 2.5, high below 4, else critical."""
    ratio = score / threshold
    return F.when(ratio < 1.5, "low").when(ratio < 2.5, "medium").when(ratio < 4, "high").otherwise("critical")


def _found(name: str, kind: Column, observed: Column, expected: Column, score: Column, threshold: float, **details: Column) -> Column:
    pairs = F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("double"))])
    return F.struct(F.lit(name).alias("detector"), kind.alias("anomaly_type"), severity(score, threshold).alias("severity"), observed.cast("double").alias("observed_value"), expected.cast("double").alias("expected_value"), score.cast("double").alias("score"), F.lit(float(threshold)).alias("threshold"), pairs.alias("details"))


def return_threshold(bars: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``det_return``: a move of more than the limit against the close before; null if there is none."""
    prev = F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))
    df = bars.withColumn("_prev", prev).withColumn("_r", F.col("close") / F.col("_prev") - 1)
    kind = F.when(F.col("_r") > 0, "price_spike").otherwise("price_drop")
    found = _found("return_threshold", kind, F.col("_r"), F.lit(0.0), F.abs("_r"), limits.return_limit, prev_close=F.col("_prev"))
    return df.withColumn("det_return", F.when(F.abs("_r") > limits.return_limit, found)).drop("_prev", "_r")


def volume_median(bars: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``det_volume``: a volume of more than the ratio times the median of those before, which stay as they were."""
    base = R.trailing(R.median, F.col("volume").cast("double"), Window.partitionBy("symbol").orderBy("ts"), limits.volume_window, limits.volume_least)
    df = bars.withColumn("_m", base).withColumn("_x", F.when(F.col("_m") > 0, F.col("volume") / F.col("_m")))
    found = _found("volume_median", F.lit("volume_spike"), F.col("volume"), F.col("_m"), F.col("_x"), limits.volume_ratio, median=F.col("_m"))
    return df.withColumn("det_volume", F.when(F.col("_x") > limits.volume_ratio, found)).drop("_m", "_x")


class ZScore:
    """One symbol's winsorised baseline: the last returns, flagged ones cut to the limit before they are kept."""

    def __init__(self, limits: Limits, kept: list[float] | None = None):
        self.limits, self.kept = limits, list(kept or [])

    def push(self, r: float) -> tuple[float, float, float] | None:
        """(z, mean, deviation) if ``r`` is an outlier against what is kept."""
        out, stored, x = None, r, self.limits
        if len(self.kept) >= x.z_least:
            mean, dev = float(np.mean(self.kept)), float(np.std(self.kept, ddof=1))
            if dev > 0:
                z = (r - mean) / dev
                if abs(z) > x.z_limit:
                    out, stored = (z, mean, dev), mean + np.copysign(x.z_limit * dev, z)
        self.kept.append(stored)
        if len(self.kept) > x.z_window:
            del self.kept[0]
        return out


def zscores(kept: list[float], returns: np.ndarray, limits: Limits, block: int = 64) -> tuple[np.ndarray, list[float]]:
    """(z, mean, deviation) of each return that is an outlier against those kept before it, else NaN; and what is then kept.

    All returns of a block are judged as if none before them in it were an outlier; the first that is one is cut to the limit and the
    rest of its block judged again, until nothing changes: each judgement up to there was right.
    """
    out, size, least = np.full((len(returns), 3), np.nan), limits.z_window, limits.z_least
    series = np.concatenate([np.asarray(kept, float), returns])
    m, at = len(kept), 0
    while at < len(returns):
        stop = min(len(returns), at + block)
        first = m + at  # of the series
        if first < size:  # the kept ones are still growing
            stop = at + 1
            views = series[:first][None, :]
        else:
            views = sliding_window_view(series[first - size : m + stop - 1], size)
        if views.shape[1] >= max(least, 2):
            mean, dev = views.mean(axis=1), views.std(axis=1, ddof=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                z = (returns[at:stop] - mean) / dev
            hits = np.flatnonzero((dev > 0) & (np.abs(z) > limits.z_limit))
            if len(hits):
                i = hits[0]
                out[at + i] = z[i], mean[i], dev[i]
                series[m + at + i] = mean[i] + np.copysign(limits.z_limit * dev[i], z[i])
                stop = at + i + 1
        at = stop
    return out, series[-size:].tolist() if len(series) else []


class _Walk:
    """Rows of a sorted range, symbol by symbol: what the range's first symbol enters with, and what its last one leaves with."""

    def __init__(self, limits: Limits, entry: tuple[float | None, list[float]] = (None, [])):
        self.limits, (self.close, self.kept) = limits, entry
        self.first = self.symbol = None
        self.any, self.single = False, True

    def push(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, returns, (z, mean, deviation)) of the outliers of each of the batch's symbols."""
        names, close = batch.column("symbol").to_pylist(), batch.column("close").to_numpy(zero_copy_only=False)
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if not self.any:
                self.any, self.first, self.symbol = True, names[a], names[a]
            elif names[a] != self.symbol:
                self.symbol, self.close, self.kept, self.single = names[a], None, [], False
            x = close[a:b]
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.log(x / np.concatenate([[np.nan if self.close is None else self.close], x[:-1]]))
            known = np.flatnonzero(~np.isnan(r))
            z, self.kept = zscores(self.kept, r[known], self.limits)
            self.close = float(x[-1])
            hits = np.flatnonzero(~np.isnan(z[:, 0]))
            yield a + known[hits], r[known[hits]], z[hits]


def return_zscore(bars: DataFrame, limits: Limits = Limits(), partitions: int | None = None) -> DataFrame:
    """``det_zscore``: log returns of more than z_limit deviations from the kept ones.

    A kept return depends on the flags before it. Bars are sorted into ranges, and a symbol's ranges are walked at once, each as if nothing
    were kept before it: once a window's length passes without an outlier, what is kept is the same whatever it began with. Ranges
    whose beginning was wrong are walked again from what the one before left, until all stand: a round for each range at worst, one as a
    rule. What passes between ranges is one window a range of a symbol that has several.
    """
    rows = bars.select("symbol", "ts", "close")
    order = ("symbol", "ts")
    rows = checkpointed((rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order))
    edge = "part int, first string, last string, single boolean, close double, kept array<double>"
    kinds = to_arrow_schema(StructType.fromDDL(edge))

    def left(entries: dict, only: set | None) -> list:
        """What each range, or those in ``only``, leaves with."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            if only is not None and part not in only:
                return
            walk = _Walk(limits, entries.get(part, (None, [])))
            for batch in batches:
                for _ in walk.push(batch):
                    pass
            if walk.any:
                yield pa.RecordBatch.from_pylist([{"part": part, "first": walk.first, "last": walk.symbol, "single": walk.single, "close": walk.close, "kept": walk.kept}], kinds)

        return rows.mapInArrow(run, edge).collect()

    exits = {r.part: r for r in left({}, None)}
    entries: dict[int, tuple] = {}
    while True:
        parts = sorted(exits)
        now = {p: (exits[q].close, list(exits[q].kept)) for q, p in zip(parts, parts[1:]) if exits[q].last == exits[p].first}
        wrong = {p for p in now if now[p] != entries.get(p)}
        entries = now
        again = {p for p in wrong if exits[p].single}  # others leave with another symbol
        if not again:
            break
        exits |= {r.part: r for r in left(entries, again)}

    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(limits, entries.get(TaskContext.get().partitionId(), (None, [])))
        for batch in batches:
            for places, r, z in walk.push(batch):
                hit = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([hit.column("symbol"), hit.column("ts"), *map(pa.array, (r, z[:, 0].copy(), z[:, 1].copy(), z[:, 2].copy()))], ["symbol", "ts", "_r", "_z", "_mean", "_dev"])

    flags = rows.mapInArrow(flagged, "symbol string, ts timestamp, _r double, _z double, _mean double, _dev double")
    df = bars.join(flags, ["symbol", "ts"], "left")
    kind = F.when(F.col("_z") > 0, "price_spike").otherwise("price_drop")
    found = _found("return_zscore", kind, F.col("_r"), F.col("_mean"), F.abs("_z"), limits.z_limit, mean=F.col("_mean"), std=F.col("_dev"))
    return df.withColumn("det_zscore", F.when(F.col("_z").isNotNull(), found)).drop("_r", "_z", "_mean", "_dev")


def anomalies(df: DataFrame, columns: list[str], source_id: str = "event_id") -> DataFrame:
    """One row per detection, with an id derived from its source event, detector and type."""
    hits = F.filter(F.array(*columns), lambda x: x.isNotNull())
    rows = df.withColumn("_d", F.explode(hits)).select("symbol", "ts", "interval", F.col(source_id).cast("string").alias("source_event_id"), "_d.*", F.lit(VERSION).alias("detector_version"))
    return rows.withColumn("anomaly_id", ids.uuid5(ids.NAMESPACE_DNS, F.col("source_event_id"), F.col("detector"), F.col("anomaly_type")))


#: The injected kinds that each detector is held against.
TRUTH = {"return_threshold": ["price_spike", "price_drop"], "return_zscore": ["price_spike", "price_drop"], "volume_median": ["volume_spike"]}


def scored(df: DataFrame, flagged: dict[str, Column], injected: str = "injected") -> DataFrame:
    """(detector, tp, fp, fn, precision, recall); ``injected`` is a comma list of kinds.

    Bars with an injected price jump don't count for volume, as their volume is part of the jump. Precision and recall
    are NaN without any case.
    """
    labels = F.split(F.coalesce(injected, F.lit("")), ",")
    jump = F.arrays_overlap(labels, F.array(*map(F.lit, TRUTH["return_threshold"])))
    each = []
    for name, kinds in TRUTH.items():
        true = F.arrays_overlap(labels, F.array(*map(F.lit, kinds)))
        counted = ~jump if name == "volume_median" else F.lit(True)
        each.append(F.struct(F.lit(name).alias("detector"), true.alias("t"), flagged[name].alias("f"), counted.alias("c")))
    rows = df.select(F.explode(F.array(*each)).alias("x")).select("x.*").where("c")
    out = rows.groupBy("detector").agg(F.count_if(F.expr("t and f")).alias("tp"), F.count_if(F.expr("f and not t")).alias("fp"), F.count_if(F.expr("t and not f")).alias("fn"))
    nan = F.lit(float("nan"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(nan)
    return out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
