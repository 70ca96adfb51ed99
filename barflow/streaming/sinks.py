"""Streams into tables: every batch may run again without changing the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barflow.operators import contract as C, features as X, models as M
from barflow.sources import sinks as S


def append_once(stream: DataFrame, path: str, keys: list[list[str]], checkpoint: str, within: str | None = None):
    """Append what the table lacks. Offsets are committed after the batch is written, so a repeated batch finds its rows there. With
    ``within``, a batch reads only the table's folders of its own values (``sources.sinks.append_absent``)."""
    return stream.writeStream.foreachBatch(lambda batch, _: S.append_absent(batch, path, keys, within)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(stream: DataFrame, path: str, checkpoint: str, key: str = "symbol", ts: str = "ts"):
    """The newest row of each key, in one folder a batch; the highest number is the state, and a repeated batch rewrites its own. Only the
    last two folders stay, since a repeated batch begins from the one before it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/batch={number - 1}"
        state = S.latest(spark.read.parquet(before), batch, key, ts) if S._exists(spark, before) else S.latest(batch.limit(0), batch, key, ts)
        state.write.mode("overwrite").parquet(f"{path}/batch={number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark, path: str) -> DataFrame:
    """What ``keep_latest`` holds."""
    df = spark.read.parquet(path)
    last = df.agg(F.max("batch").alias("batch"))
    return df.join(F.broadcast(last), "batch").drop("batch")


def keep_updated(stream: DataFrame, path: str, checkpoint: str):
    """The rows of an aggregation that each batch changes, in one folder a batch; a repeated batch rewrites its own. Rows that the watermark has
    not passed are there too, and their state goes when it has."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def updated(spark, path: str, keys: list[str]) -> DataFrame:
    """What ``keep_updated`` holds: the last row of each key."""
    df = spark.read.parquet(path)
    rest = [c for c in df.columns if c not in (*keys, "batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def coalesced(batch: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the newest row of each type and symbol, the ``most`` newest anomalies, one row with the number of older ones dropped): what a
    screen gets of a batch."""
    latest = batch.where("event_type <> 'anomaly'").groupBy("event_type", "symbol").agg(F.max_by(F.struct(*batch.columns), "ts").alias("_r")).select("_r.*")
    found = batch.where("event_type = 'anomaly'")
    return latest, found.orderBy(F.desc("ts"), "symbol").limit(most), found.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("dropped"))


def routed(stream: DataFrame, events: str, dead: str, checkpoint: str, group: str):
    """A log's sound events appended to ``events`` and its poison messages, as dead letters, to ``dead``: none holds up the stream. A
    repeated batch finds its rows there."""

    def write(batch: DataFrame, number: int) -> None:
        good, bad = C.split(C.decoded(batch), ["key", "value", "topic", "partition", "offset"])
        S.append_absent(good, events, [["event_id"]])
        S.append_absent(C.dead_letters(bad, group, F.current_timestamp()), dead, [["original_topic", "original_partition", "original_offset"]])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scored(stream: DataFrame, path: str, checkpoint: str, predict, name: str, version: str):
    """Predictions of a stream of ready feature rows (``enrich.featured``), appended once. ``predict`` adds ``score``; rows it gives none are
    left out and hold up nothing."""

    def write(batch: DataFrame, number: int) -> None:
        S.append_absent(M.predictions(predict(batch.where("status = 'ready'")), name, version, X.VERSION), path, [["prediction_id"]])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolled_up(stream: DataFrame, ts: str, every: str, late: str, keys: list[str], price: str, order: list[str] = []) -> DataFrame:
    """Bars of a watermarked stream by tumbling windows; rows of one time count in ``order``."""
    # a watermark needs an instant, not a local time
    df = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    at = F.struct("_ts", *order)
    out = df.groupBy(F.window("_ts", every).alias("_w"), *keys).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select(*keys, F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions of activity, split by pauses of ``gap`` or longer."""
    df = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return df.groupBy(F.session_window("_ts", gap).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def deduplicated(stream: DataFrame, ts: str, late: str, key: str) -> DataFrame:
    """Each id once within the watermark: bounded state, where the batch policy remembers a number of ids instead."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
