"""Idempotent writes of batches, and the tables' states after them, as pure functions of target and batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Newest anomalies kept in all and by symbol.
RECENT, RECENT_BY_SYMBOL = 500, 100


def first_of(batch: DataFrame, key: list[str]) -> DataFrame:
    """One row of each key, the least of its rows by their values; rows with a null in the key are never equal and all stay."""
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    order = F.struct(*[c for c, kind in batch.dtypes if "map<" not in kind and kind != "variant"])
    one = batch.where(whole).groupBy(*key).agg(F.min_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")
    return one.unionByName(batch.where(~whole))


def absent(batch: DataFrame, target: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows of the batch that none of the unique ``keys`` finds in the target or earlier in the batch, by the order of values."""
    for key in keys:
        batch = first_of(batch, key).join(target.select(*key), key, "left_anti")
    return batch


def append_counts(batch: DataFrame, target: DataFrame, keys: list[list[str]], table: str) -> DataFrame:
    """(table, written, skipped) of an append of what is absent."""
    new = absent(batch, target, keys).agg(F.count(F.lit(1)).alias("written"))
    return batch.agg(F.count(F.lit(1)).alias("_all")).crossJoin(F.broadcast(new)).select(F.lit(table).alias("table"), "written", (F.col("_all") - F.col("written")).alias("skipped"))


def append_absent(batch: DataFrame, path: str, keys: list[list[str]], within: str | None = None) -> None:
    """Append to a Parquet table what it lacks; the same batch again adds nothing.

    ``within`` names a column that equal rows share, such as their day: the table is kept in a folder for each of its values, and only the
    folders of the batch's values are read. Without it every batch reads the keys of the whole table.
    """
    spark = batch.sparkSession
    target = spark.read.schema(batch.schema).option("pathGlobFilter", "*.parquet").parquet(path) if _exists(spark, path) else None
    if target is not None and within is not None:
        target = within_folders(target, batch, within)
    new = absent(batch, target, keys) if target is not None else reduce(first_of, keys, batch)
    writer = new.write.mode("append")
    (writer.partitionBy(within) if within is not None else writer).parquet(path)


#: Folders that a filter names one by one; of a batch of more the whole table is read.
FOLDERS = 1000


def within_folders(target: DataFrame, batch: DataFrame, within: str) -> DataFrame:
    """The rows of ``target`` in folders of the batch's values of ``within``: a filter of partitions, known before the scan."""
    values = [r[0] for r in batch.select(within).distinct().limit(FOLDERS + 1).collect()]
    if len(values) > FOLDERS:
        return target
    known = F.col(within).isin([v for v in values if v is not None])
    return target.where(known | F.col(within).isNull() if None in values else known)


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def routed(events: DataFrame, routes: dict[str, tuple[str, list[Column]]]) -> dict[str, DataFrame]:
    """Table -> rows, by event_type; other types are skipped."""
    return {table: events.where(F.col("event_type") == kind).select(*columns) for kind, (table, columns) in routes.items()}


def constrained(rows: DataFrame, constraints: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that meet all constraints, rejected rows with the names of the broken ones); null is no breach."""
    broken = F.filter(F.array(*[F.when(~c, F.lit(name)) for name, c in constraints.items()]), lambda x: x.isNotNull())
    df = rows.withColumn("broken", broken)
    return df.where(F.size("broken") == 0).drop("broken"), df.where(F.size("broken") > 0)


#: The unique keys of the tables, the primary one first.
KEYS = {
    "symbols": [["symbol"]], "market_bars": [["symbol", "bar_interval", "ts"], ["event_id"]], "bar_indicators": [["symbol", "bar_interval", "ts"]], "anomalies": [["anomaly_id"], ["source_event_id", "detector", "anomaly_type"]],
    "predictions": [["prediction_id"]], "prediction_outcomes": [["prediction_id"]], "model_deployments": [["id"]], "monitoring_reports": [["id"]], "watchlist_items": [["user_id", "symbol"]],
}
#: The checks of the tables, by name.
CHECKS = {
    "symbols": {}, "bar_indicators": {}, "watchlist_items": {},
    "market_bars": {"prices": "open > 0 and high > 0 and low > 0 and close > 0", "volume": "volume >= 0", "high": "high >= greatest(open, close, low)", "low": "low <= least(open, close)"},
    "anomalies": {"anomaly_type": "anomaly_type in ('price_spike', 'price_drop', 'volume_spike')", "severity": "severity in ('low', 'medium', 'high', 'critical')"},
    "predictions": {"target": "target_ts > ts", "horizon": "horizon_bars >= 1", "task": "task in ('direction', 'return')", "direction": "predicted_direction in ('up', 'down', 'neutral')", "confidence": "confidence between 0 and 1"},
    "prediction_outcomes": {"direction": "actual_direction in ('up', 'down', 'neutral')"},
    "model_deployments": {"to_stage": "to_stage in ('candidate', 'challenger', 'champion', 'archived')", "from_stage": "from_stage in ('candidate', 'challenger', 'champion', 'archived')"},
    "monitoring_reports": {"window": "window_end > window_start", "report_type": "report_type in ('data_drift', 'prediction_drift', 'performance', 'operational')", "status": "status in ('ok', 'warning', 'alert')"},
}


def checks(table: str) -> dict[str, Column]:
    return {name: F.expr(text) for name, text in CHECKS[table].items()}


def new_symbols(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Symbols that the dimension lacks."""
    return rows.select("symbol").distinct().join(dimension.select("symbol"), "symbol", "left_anti")


def latest(target: DataFrame, batch: DataFrame, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """One row per key: the newest of the stored one and the batch; at the same time the stored one stays."""
    rows = target.withColumn("_stored", F.lit(1)).unionByName(batch.withColumn("_stored", F.lit(0)))
    columns = [c for c in target.columns]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(ts, "_stored")).alias("_r")).select("_r.*")


def latest_with_expiry(target: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """``latest`` of predictions, each for as long as its target lies ahead of its time, a millisecond at least, and not expired."""
    life = F.greatest(F.lit(1000).cast("long"), F.unix_micros("target_ts") - F.unix_micros("ts"))
    df = latest(target, batch.withColumn("expires_at", F.timestamp_micros(F.unix_micros(now) + life)))
    return df.where(F.col("expires_at") > now)


def recent(target: DataFrame, batch: DataFrame, payload: str = "payload", ts: str = "ts", cap: int = RECENT, by_symbol: bool = False) -> DataFrame:
    """The newest rows of both, each payload once: ``cap`` in all, or by symbol. Ties go by payload."""
    rows = target.unionByName(batch).dropDuplicates(["symbol", payload])
    if by_symbol:
        w = Window.partitionBy("symbol").orderBy(F.desc(ts), payload)
        return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    return rows.orderBy(F.desc(ts), payload).limit(cap)


def announced(target: DataFrame, batch: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of the batch whose payload is new; only these are told to subscribers."""
    return batch.dropDuplicates(["symbol", payload]).join(target.select("symbol", payload), ["symbol", payload], "left_anti")


def log_records(events: DataFrame, topic: str, key: str = "symbol") -> DataFrame:
    """Rows for a log: key, JSON value and headers."""
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").cast("binary").alias("value"))
    headers = F.array(header("event_type", F.col("event_type")), header("schema_version", F.col("schema_version")), header("content-type", F.lit("application/json")), header("trace_id", F.coalesce("trace_id", F.lit(""))))
    return events.select(F.lit(topic).alias("topic"), F.col(key).cast("binary").alias("key"), F.to_json(F.struct("*")).cast("binary").alias("value"), headers.alias("headers"))


def manifest(df: DataFrame, name: str, config: str) -> DataFrame:
    """One row that changes with any value of a table but not with the order of its rows: count and sum of row hashes."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("content_hash")).select(F.lit(name).alias("name"), "rows", "content_hash", F.sha2(F.lit(config), 256).alias("config_hash"))
