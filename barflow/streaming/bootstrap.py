"""Going on from a log's committed offsets with states as if the stream had never stopped.

A stream that lost its state, or begins with another layout of it, reads the last messages before the committed offset of each
partition as a batch. What they make of the states is the stream's initial state, and its first message is the committed one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from barflow.streaming.enrich import WARM_UP

_PLACE = ["topic", "partition"]


def committed(done: DataFrame) -> DataFrame:
    """(topic, partition, committed): the offset after the last one of ``done(topic, partition, offset)``, rows whose results are written."""
    return done.groupBy(*_PLACE).agg((F.max("offset") + 1).alias("committed"))


def points(log: DataFrame, offsets: DataFrame, messages: int = WARM_UP) -> DataFrame:
    """(topic, partition, start, committed) of each partition of ``log``: ``messages`` before the committed offset, or as many as there are. A
    partition without a committed offset starts at its lowest, with nothing to read again."""
    low = log.groupBy(*_PLACE).agg(F.min("offset").alias("low"))
    both = low.join(offsets, _PLACE, "left")
    start = F.coalesce(F.greatest("low", F.col("committed") - messages), F.col("low"))
    return both.select(*_PLACE, start.alias("start"), F.coalesce("committed", "low").alias("committed"))


def history(log: DataFrame, offsets: DataFrame, messages: int = WARM_UP) -> DataFrame:
    """The rows of ``log``, a batch, with start <= offset < committed: one row a partition is broadcast."""
    at = F.broadcast(points(log, offsets, messages))
    return log.join(at, _PLACE).where("offset >= start and offset < committed").drop("start", "committed")


def remaining(stream: DataFrame, log: DataFrame, offsets: DataFrame) -> DataFrame:
    """The stream's messages from the committed offsets on. Partitions that only the stream knows are new and read whole."""
    at = F.broadcast(points(log, offsets).select(*_PLACE, "committed"))
    return stream.join(at, _PLACE, "left").where("committed is null or offset >= committed").drop("committed")


def starting_offsets(offsets: DataFrame, known: DataFrame | None = None) -> str:
    """A broker's ``startingOffsets``: the committed offset of each partition, and the earliest of ``known`` ones without any. One short
    entry a partition."""
    out: dict[str, dict[str, int]] = {}
    for r in known.select(*_PLACE).distinct().collect() if known is not None else []:
        out.setdefault(r.topic, {})[str(r.partition)] = -2
    for r in offsets.collect():
        out.setdefault(r.topic, {})[str(r.partition)] = r.committed
    return json.dumps(out, sort_keys=True)
