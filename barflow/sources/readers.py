"""Scans: event logs, raw and typed CSV, verified snapshots, replays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barflow.functions import timegrid as G
from barflow.sources.schemas import LOG

REQUIRED = ["timestamp", "open", "high", "low", "close", "volume"]


def event_log(spark: SparkSession, path: str | None = None, options: dict[str, str] | None = None, per_trigger: int = 500) -> DataFrame:
    """A streaming log: a broker's topics by ``options``, from the earliest offset, or files of the same columns in ``path``."""
    if path is not None:
        return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    reader = spark.readStream.format("kafka").option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).option("includeHeaders", "true").option("kafka.isolation.level", "read_committed")
    return reader.options(**(options or {})).load()


def lenient_csv(spark: SparkSession, paths: list[str], symbol_pattern: str = r"([^/]+)\.csv$") -> DataFrame:
    """Raw rows with every value as a string and the line of its file, so that a rule and not the reader judges them.

    Columns are found by the file's header; the symbol is the file's name. Lines are numbered within a file in the order of
    the bytes, header = 1: a file is split over tasks, so the number is a window over its lines.
    """
    out = None
    for path in paths:
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        if missing := sorted(set(REQUIRED) - set(df.columns)):
            raise ValueError(f"{path} lacks {missing}")
        file = F.col("_metadata.file_path")
        df = df.select(F.regexp_extract(file, symbol_pattern, 1).alias("symbol"), F.monotonically_increasing_id().alias("_at"), *[F.col(c).alias(f"raw_{c}") for c in REQUIRED])
        df = df.withColumn("row", F.row_number().over(Window.partitionBy("symbol").orderBy("_at")) + 1).drop("_at")
        out = df if out is None else out.unionByName(df)
    return out


def typed_csv(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Bars by header name, with columns of the folders' names in ``keys``, epoch seconds as instants, in time order."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*keys, F.timestamp_seconds(F.col("timestamp").cast("long")).alias("ts"), *[F.col(c).cast("double").alias(c) for c in REQUIRED[1:]]).orderBy("ts")


def verified_files(spark: SparkSession, path: str, lock: DataFrame) -> DataFrame:
    """(path, expected, found) of files that ``lock(path, sha256)`` contradicts; hashes are taken on the executors."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("found"))
    return lock.select("path", F.col("sha256").alias("expected")).join(files, "path", "full").where(~F.col("expected").eqNullSafe(F.col("found")))


def snapshot(spark: SparkSession, path: str, lock: DataFrame) -> list[str]:
    """The files of a snapshot, or an error that names some that changed, are missing or were not locked."""
    if wrong := verified_files(spark, path, lock).limit(5).collect():
        raise ValueError(f"files differ from the lock: {[r.path for r in wrong]}")
    return [r.path for r in lock.select("path").distinct().toLocalIterator()]


def replay(bars: DataFrame, start: Column, period_seconds: float, limit: int | None = None) -> DataFrame:
    """Valid bars, newer than all before them of their symbol, in batches of one timestamp each: batch and due_at.

    ``bars`` has row, the order within a symbol. ``limit`` is a number of timestamps.
    """
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    valid = (o > 0) & (low > 0) & (c > 0) & (F.col("volume") >= 0) & (h >= F.greatest(o, c, low)) & (low <= F.least(o, c))
    before = F.max("ts").over(Window.partitionBy("symbol").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    df = bars.where(valid).withColumn("_b", before).where("_b is null or ts > _b").drop("_b")
    times = df.select("ts").distinct().withColumn("batch", F.row_number().over(Window.orderBy("ts")) - 1)
    times = times.where(F.col("batch") < limit) if limit is not None else times
    due = F.timestamp_micros(F.unix_micros(start) + (F.col("batch") * period_seconds * 1e6).cast("long"))
    return df.join(times, "ts").withColumn("due_at", due).orderBy("ts", "symbol")


def skipped_by_replay(bars: DataFrame) -> DataFrame:
    """(symbol, invalid, non_increasing): what a replay leaves out."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    valid = F.coalesce((o > 0) & (low > 0) & (c > 0) & (F.col("volume") >= 0) & (h >= F.greatest(o, c, low)) & (low <= F.least(o, c)), F.lit(False))
    w = Window.partitionBy("symbol").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    df = bars.withColumn("_v", valid).withColumn("_b", F.max(F.when(F.col("_v"), F.col("ts"))).over(w))
    return df.groupBy("symbol").agg(F.count_if(~F.col("_v")).alias("invalid"), F.count_if(F.col("_v") & (F.col("ts") <= F.col("_b"))).alias("non_increasing"))


def simulated_grid(spark: SparkSession, now: Column, interval: str, bars: int) -> DataFrame:
    """The opening times of the last ``bars`` whole bars before ``now``."""
    first = G.grid_start(now, F.lit(interval), bars)
    return spark.range(bars).select(G.plus_seconds(first, F.col("id") * G.SECONDS[interval]).alias("ts"))
