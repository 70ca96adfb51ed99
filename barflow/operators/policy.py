"""Event-time policy per symbol, over arrivals in order: segments, duplicates, late rows, gaps."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from barflow.functions import timegrid as G
from barflow.sources.session import checkpointed

#: Processed identifiers that a symbol remembers.
MEMORY = 256


def _judged(df: DataFrame, order: str, memory: int) -> DataFrame:
    """The policy's judgement of each row, if the rows before it were processed as ``_ok`` says."""
    own = Window.partitionBy("symbol", "segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("symbol", "segment", "event_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_newest", F.max(F.when(F.col("_ok"), F.col("ts"))).over(own)).withColumn("_no", F.coalesce(F.count_if("_ok").over(own), F.lit(0)))
    df = df.withColumn("_seen", F.last(F.when(F.col("_ok"), F.col("_no") + 1), ignorenulls=True).over(same))
    again = F.coalesce((F.col("ts") == F.col("_newest")) | (F.col("_no") - F.col("_seen") < memory), F.lit(False))
    late = F.coalesce(F.col("ts") < F.col("_newest"), F.lit(False))
    df = df.withColumn("outcome", F.when(again, "duplicate").when(late, "late").otherwise("processed"))
    missing = G.missing_bars(F.col("_newest"), F.col("ts"), G.duration(F.col("interval")))
    return df.withColumn("missing_bars", F.when(F.col("outcome") == "processed", F.coalesce(missing, F.lit(0))).otherwise(F.lit(0))).drop("_newest", "_no", "_seen")


def outcomes(arrivals: DataFrame, order: str = "arrival", memory: int = MEMORY) -> DataFrame:
    """Add segment, outcome (processed, duplicate, late) and missing_bars to ``arrivals(symbol, interval, ts, event_id)``.

    A change of interval starts a new segment with no memory. A row is a duplicate if it has the time of the newest processed
    one or an id among the last ``memory`` processed ones, however new it is; else late if it is older than the newest; else
    processed. missing_bars counts the bars that a processed row skips.

    What is processed depends on what was. Rows are judged in windows as if every row newer than all before it had been processed, which
    stands unless an id came again with a newer time. Segments in which it doesn't are walked once in order, each with the last
    ``memory`` ids: two passes, whatever the data.
    """
    w = Window.partitionBy("symbol").orderBy(order)
    change = (F.col("interval") != F.lag("interval").over(w)).cast("int")
    df = arrivals.withColumn("segment", F.sum(F.coalesce(change, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    newest = F.max("ts").over(Window.partitionBy("symbol", "segment").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_ok", newest.isNull() | (F.col("ts") > newest))
    df = checkpointed(_judged(df, order, memory))
    wrong = df.where(F.col("_ok") != (F.col("outcome") == "processed")).select("symbol", "segment").distinct()
    wrong, df = checkpointed(wrong), df.drop("_ok")
    if wrong.isEmpty():
        return df
    again = df.join(wrong, ["symbol", "segment"], "left_semi").select(df.columns)
    return df.join(wrong, ["symbol", "segment"], "left_anti").select(df.columns).unionByName(_walked(again, order, memory))


def _walked(df: DataFrame, order: str, memory: int) -> DataFrame:
    """The policy row by row, over sorted segments: a task holds the newest time and the last ids of one."""
    rows = df.withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_bar", G.duration(F.col("interval")))
    rows, columns = rows.repartition("symbol", "segment").sortWithinPartitions("symbol", "segment", order), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, newest, ids, held = None, None, deque(), set()
        for batch in batches:
            out, skipped = [], []
            for symbol, segment, key, at, bar in zip(*(batch.column(c).to_pylist() for c in ("symbol", "segment", "event_id", "_at", "_bar"))):
                if now != (symbol, segment):
                    now, newest, ids, held = (symbol, segment), None, deque(), set()
                missing, outcome = 0, "processed"
                if at == newest or key in held:
                    outcome = "duplicate"
                elif newest is not None and at < newest:
                    outcome = "late"
                else:
                    missing = 0 if newest is None else max(0, round((at - newest) / (bar * 1_000_000)) - 1)
                    newest = at
                    ids.append(key)
                    held.add(key)
                    if len(ids) > memory:
                        held.discard(ids.popleft())
                out.append(outcome)
                skipped.append(missing)
            found = {"outcome": pa.array(out), "missing_bars": pa.array(skipped, batch.schema.field("missing_bars").type)}
            yield pa.RecordBatch.from_arrays([found[c] if c in found else batch.column(c) for c in columns], columns)

    return rows.mapInArrow(run, df.schema)


def outcome_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("n"))


def message_outcomes(messages: DataFrame, judged: DataFrame, key: list[str]) -> DataFrame:
    """``messages`` with outcome: invalid (``reason`` says why it can't be read), warmup (``warming``: it only fills states), what ``judged(key, outcome)``
    says of it, or error where that has no row: its processing failed."""
    df = messages.join(judged.select(*key, F.col("outcome").alias("_judged")), key, "left")
    outcome = F.when(F.col("reason").isNotNull(), "invalid").when(F.col("_judged").isNull(), "error").when(F.col("warming"), "warmup").otherwise(F.col("_judged"))
    return df.withColumn("outcome", outcome).drop("_judged")
