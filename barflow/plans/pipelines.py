"""Queries of the event contract, sinks, operations and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from barflow.functions import ids
from barflow.operators import contract as C, detectors as D, features as X, ops as O
from barflow.plans.common import rd, sql_stamp, sq, sqs, stamp, table
from barflow.plans.stream_rules import _NUMBERED, numbered
from barflow.sources import readers as R, sinks as S, stages as G
from barflow.sources.bars import EVENT_SQL, LINE_SQL, event_bars, line_bars
from barflow.sources.session import shared_folder
from barflow.streaming import enrich, sinks as T



def _at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")

_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


# -- contract ----------------------------------------------------------------------------------------------------------------
def log(spark, d):
    """Bars as log rows, some of them broken: empty, cut, an array, without type, of another type, or against an invariant."""
    n = F.col("n")
    df = numbered(spark, d)
    event = F.to_json(F.struct(
        F.col("event_id"), F.when(n % 29 != 0, F.when(n % 31 == 0, "trade").otherwise("market.bar")).alias("event_type"), F.lit(1).alias("schema_version"), F.upper("symbol").alias("symbol"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(n % 37 == 0, "").otherwise("Z")).alias("timestamp"), F.when(n % 41 == 0, "7h").otherwise(F.lit("1h")).alias("interval"),
        F.when(n % 43 == 0, F.lit(-1.0)).otherwise(F.col("open") + 1).alias("open"), (F.col("high") + 1).alias("high"), (F.col("low") + 1).alias("low"), (F.col("close") + 1).alias("close"), "volume", F.lit(1).alias("extra"),
    ))
    value = F.when(n % 19 == 0, "").when(n % 23 == 0, F.substring(event, 1, 40)).when(n % 47 == 0, F.concat(F.lit("["), event, F.lit("]"))).otherwise(event)
    return df.select(F.when(n % 11 != 0, F.col("symbol")).cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit("bars").alias("topic"), (n % 3).alias("partition"), n.cast("long").alias("offset"), "ts", "event_id", "n")


_LOG = f"""{_NUMBERED},
lg AS (SELECT *, n % 19 = 0 AS empty, n % 23 = 0 OR n % 47 = 0 AS bad FROM nb),
cl AS (SELECT *, CASE WHEN empty OR bad THEN 'deserialization' WHEN n % 29 = 0 THEN 'validation' WHEN n % 31 = 0 THEN 'unknown_event_type'
                      WHEN n % 37 = 0 OR n % 41 = 0 OR n % 43 = 0 OR NOT (open + 1 > 0 AND low + 1 > 0 AND close + 1 > 0 AND high + 1 > 0) THEN 'validation' END AS reason FROM lg)"""


def contract_reasons(spark, d):
    return C.decoded(log(spark, d)).select("event_id", "reason")


def contract_invariants(spark, d):
    """The invariants that each decoded bar breaks."""
    df = C.decoded(log(spark, d))
    return df.where("reason = 'validation' and error like 'broken%'").select("event_id", "error")


def contract_events(spark, d):
    events, _ = C.split(C.decoded(log(spark, d)), ["key", "value", "topic", "partition", "offset"])
    return events.select("event_id", "symbol", stamp("timestamp", "at"), rd("close", 2), "volume")


def dlq_records(spark, d):
    _, bad = C.split(C.decoded(log(spark, d)), ["key", "value", "topic", "partition", "offset"])
    df = C.dead_letters(bad, "enricher", _at())
    return df.select("original_topic", "original_partition", "original_offset", "original_key", "original_value_b64", "reason", "error_message", "consumer_group", "routing_key", "attempts")


def contract_predictions(spark, d):
    """Predictions by the invariants they break: target, task, probabilities; and feature vectors by theirs."""
    n = F.col("n")
    df = numbered(spark, d).select(
        "event_id", "ts", F.when(n % 13 == 0, F.col("ts")).otherwise(F.col("ts") + F.expr("interval 1 hour")).alias("target_ts"), F.when(n % 17 == 0, "return").otherwise("direction").alias("task"), F.lit("up").alias("predicted_direction"),
        F.lit(None).cast("double").alias("predicted_return"), F.create_map(F.lit("up"), F.when(n % 7 == 0, 0.7).otherwise(0.6), F.lit("down"), F.lit(0.4)).alias("class_probabilities"),
        F.when(n % 5 == 0, "fs-0").otherwise("fs-1").alias("feature_set_version"), F.create_map(F.lit("a"), F.when(n % 11 == 0, float("nan")).otherwise(1.0), F.when(n % 3 == 0, "c").otherwise("b"), F.lit(2.0)).alias("features"),
    )
    return df.select("event_id", F.array_join(C.prediction_violations(), ",").alias("broken"), F.array_join(C.feature_violations(["a", "b"], "fs-1"), ",").alias("features_broken"))


def derived_ids(spark, d):
    return C.derived_ids(numbered(spark, d), "1", F.lit("volume"), F.lit("spike")).select("event_id", "enriched_id", "anomaly_event_id", "anomaly_id")


def contract_enriched(spark, d):
    df = numbered(spark, d).withColumn("produced_at", F.col("ts") + F.expr("interval 1 hour")).withColumn("event_type", F.lit("market.bar"))
    df = C.enriched(df, F.lit("2024-01-15 00:30:00").cast("timestamp"))
    return df.select("event_id", "source_event_id", "event_type", rd("processing_latency_ms", 1))


# -- sinks ---------------------------------------------------------------------------------------------------------------------
def _batches(spark, d):
    """A target of three fifths of each symbol's bars, and a batch of its later half."""
    df = numbered(spark, d).select("symbol", "ts", "event_id", rd("close", 2), "n")
    of = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    df = df.withColumn("m", of)
    return df.where("5 * n <= 3 * m"), df.where("2 * n > m")


def sink_append_absent(spark, d):
    """Target and batch after an append of what was absent, with the counts of it."""
    target, batch = _batches(spark, d)
    new = S.absent(batch, target, [["symbol", "ts"], ["event_id"]])
    return target.unionByName(new).select("event_id", stamp("ts", "at"), "close")


def sink_counts(spark, d):
    target, batch = _batches(spark, d)
    return S.append_counts(batch, target, [["symbol", "ts"]], "market_bars")


def sink_latest(spark, d):
    """Latest state after a batch that is older for one symbol and ends at the stored row for another."""
    target, batch = _batches(spark, d)
    stored = S.latest(target.limit(0), target)
    batch = batch.where("symbol not in ('view', 'click') or (symbol = 'view' and 20 * n < 11 * m) or (symbol = 'click' and 5 * n <= 3 * m)").withColumn("close", F.col("close") + 1)
    return S.latest(stored, batch).select("symbol", "event_id", "close")


def sink_latest_expiring(spark, d):
    target, batch = _batches(spark, d)
    p = lambda x: x.withColumn("target_ts", F.col("ts") + F.expr("interval 5 hours"))
    stored = p(target.limit(0)).withColumn("expires_at", _at())
    df = S.latest_with_expiry(stored, p(batch), _at())
    return df.select("symbol", "event_id", stamp("expires_at", "expires_at"))


def sink_recent_capped(spark, d):
    """The 20 newest payloads of each symbol, repeats of one payload once."""
    target, batch = _batches(spark, d)
    p = lambda x: x.withColumn("payload", ids.canonical_json("symbol", "event_id", "close"))
    return S.recent(p(target), p(batch), cap=20, by_symbol=True).select("symbol", "event_id")


def sink_announced(spark, d):
    target, batch = _batches(spark, d)
    return S.announced(target.withColumn("payload", F.col("event_id")), batch.withColumn("payload", F.col("event_id"))).select("event_id")


def sink_routed(spark, d):
    """Events by type into tables: events of other types are skipped."""
    e = table(spark, d, "events").select("event_type", "event_id", "user_id")
    routes = {"click": ("clicks", [F.col("event_id")]), "error": ("errors", [F.col("event_id")])}
    out = None
    for name, df in S.routed(e, routes).items():
        part = df.select(F.lit(name).alias("table"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


def sink_constrained(spark, d):
    """Rows rejected by the checks of a table, with the broken ones' names."""
    df = numbered(spark, d).withColumn("volume", F.when(F.col("n") % 10 == 0, -1).otherwise(F.col("volume"))).withColumn("high", F.when(F.col("n") % 15 == 0, F.col("low") - 1).otherwise(F.col("high")))
    _, bad = S.constrained(df.select("event_id", "open", "high", "low", "close", "volume"), S.checks("market_bars"))
    return bad.select("event_id", F.array_join("broken", ",").alias("broken"))


def sink_new_symbols(spark, d):
    known = spark.createDataFrame([("click",), ("view",)], "symbol string")
    return S.new_symbols(event_bars(spark, d), known)


def sink_log_records(spark, d):
    df = numbered(spark, d).select("event_id", F.lit("market.bar").alias("event_type"), F.lit(1).alias("schema_version"), "symbol", F.lit(None).cast("string").alias("trace_id"))
    out = S.log_records(df, "bars")
    return out.select(F.col("key").cast("string").alias("key"), F.get_json_object(F.col("value").cast("string"), "$.event_id").alias("event_id"), F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ";").alias("headers"))


def sink_manifest(spark, d):
    """A manifest is the same however the rows are dealt out."""
    b = event_bars(spark, d)
    m = S.manifest(b, "bars", "v1").select("rows", "content_hash")
    other = S.manifest(b.repartition(7, "ts"), "bars", "v1").select(F.col("content_hash").alias("other"))
    return m.crossJoin(F.broadcast(other)).select("rows", (F.col("content_hash") == F.col("other")).alias("same"))


def scan_replay(spark, d):
    """Line bars replayed: batches of one time each, due every half second."""
    df = line_bars(spark, d).withColumn("row", F.row_number().over(Window.partitionBy("symbol").orderBy("ts"))).withColumn("low", F.when(F.col("row") % 50 == 0, -1.0).otherwise(F.col("low")))
    out = R.replay(df, F.lit("2024-01-01 00:00:00").cast("timestamp"), 0.5, 1000)
    return out.select("batch", "symbol", F.to_date("ts").alias("day"), stamp("due_at", "due_at"))


def scan_replay_skipped(spark, d):
    df = line_bars(spark, d).withColumn("row", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")))
    df = df.withColumn("low", F.when(F.col("row") % 50 == 0, -1.0).otherwise(F.col("low"))).withColumn("ts", F.when(F.col("row") % 70 == 0, F.col("ts") - F.expr("interval 9 days")).otherwise(F.col("ts")))
    return R.skipped_by_replay(df)


def scan_csv(spark, d):
    """Bars written as CSV, a file a symbol, and read back, as strings with their lines and typed."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    bars = event_bars(spark, d).select("symbol", "volume", F.unix_timestamp("ts").alias("timestamp"), "open", "high", "low", "close")
    bars.repartition("symbol").sortWithinPartitions("symbol", "timestamp").write.option("header", True).partitionBy("symbol").csv(path)
    raw = R.lenient_csv(spark, [path], r"symbol=([^/]+)/").select("symbol", "row", F.col("raw_timestamp").cast("long").alias("epoch"), F.col("raw_close").cast("double").alias("close"))
    typed = R.typed_csv(spark, path, "symbol").select("symbol", F.unix_timestamp("ts").alias("epoch"), F.col("volume").cast("long").alias("volume"))
    return raw.join(typed, ["symbol", "epoch"]).select("symbol", "row", "epoch", rd("close", 2), "volume")


# -- operations ----------------------------------------------------------------------------------------------------------------
def _received(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "ts")
    first = e.where("id % 37 <> 0").withColumn("arrival", F.col("id") * 10 + F.when(F.col("id") % 19 == 0, 55).otherwise(0))
    return first.unionByName(e.where("id % 41 = 0 and id % 37 <> 0").withColumn("arrival", F.col("id") * 10 + 1007))


_REC = """rc AS (SELECT event_id AS id, event_type AS symbol, ts, event_id * 10 + CASE WHEN event_id % 19 = 0 THEN 55 ELSE 0 END AS arrival FROM events WHERE event_id % 37 <> 0
  UNION ALL SELECT event_id, event_type, ts, event_id * 10 + 1007 FROM events WHERE event_id % 41 = 0 AND event_id % 37 <> 0)"""


def ops_reconcile(spark, d):
    return O.reconciled(table(spark, d, "events").select(F.col("event_id").alias("id")), _received(spark, d))


def ops_latency(spark, d):
    df = O.latency(table(spark, d, "events"), "value", ["event_type"])
    return df.select("event_type", "n", rd("mean", 4), *[rd(c, 2) for c in ("p50", "p90", "p95", "p99", "max")])


def ops_rounded_percentile(spark, d):
    return O.rounded_percentile(table(spark, d, "events"), "value", 0.95, ["event_type"]).select("event_type", rd("value", 2))


def ops_gaps(spark, d):
    return O.largest_gap(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"]).select("event_type", rd("largest_gap_s", 3))


def ops_arrivals(spark, d):
    df = O.arrivals(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "hour", ["event_type"])
    return df.select("event_type", stamp("at", "at"), "n")


def ops_first_after(spark, d):
    df = O.first_after(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp"), ["event_type"])
    return df.select("event_type", rd("after_s", 3))


def ops_lag(spark, d):
    """Lag of customer groups over the partitions of topics, by nation and segment."""
    c = table(spark, d, "customer")
    bounds = c.groupBy(F.col("c_mktsegment").alias("topic"), (F.col("c_custkey") % 4).cast("int").alias("partition")).agg(F.min("c_custkey").alias("low"), F.max("c_custkey").alias("end"))
    committed = c.where("c_custkey % 4 < 3").groupBy(F.concat(F.lit("g"), F.col("c_nationkey") % 3).alias("group"), F.col("c_mktsegment").alias("topic"), (F.col("c_custkey") % 4).cast("int").alias("partition")).agg(F.max("c_custkey").alias("offset")).where("topic <> 'MACHINERY' or group <> 'g1'")
    return O.lag(committed, bounds)


def _samples(spark, d):
    return numbered(spark, d).select("symbol", "ts", "n", (F.col("n") * 7 % 400).cast("double").alias("value"))


def ops_counter_increase(spark, d):
    df = O.increase(_samples(spark, d), 6 * 3600, ["symbol"])
    return df.select("symbol", stamp("ts", "at"), rd("increase", 4), rd("rate", 8))


def ops_hist_quantile(spark, d):
    e = table(spark, d, "events")
    marks = F.explode(F.array(*[F.lit(x) for x in (1.0, 5.0, 10.0, 50.0, 100.0, float("inf"))])).alias("le")
    b = e.select("event_type", "value", marks).groupBy("event_type", "le").agg(F.count_if(F.col("value") <= F.col("le")).alias("count"))
    return O.histogram_quantile(b, 0.9, ["event_type"]).select("event_type", rd("quantile", 5))


def ops_alert_hold(spark, d):
    df = O.held(_samples(spark, d), F.col("value") > 100, 6 * 3600, ["symbol"])
    return df.select("symbol", stamp("since", "since"), stamp("until", "until"), stamp("fired_at", "fired_at"))


def ops_ratio_alert(spark, d):
    df = O.ratio_alert(table(spark, d, "events"), F.col("event_type") == "error", 0.18, ["user_id"])
    return df.select("user_id", "part", "total", rd("ratio", 6), "alert")


def ops_count_alert(spark, d):
    return O.count_alert(table(spark, d, "events"), F.col("value") > 50, 10, ["event_type"])


def ops_calibration(spark, d):
    df = O.calibration(line_bars(spark, d))
    return df.select("symbol", rd("annual_drift", 4), rd("annual_volatility", 4), "median_volume", rd("log_volume_sd", 4), rd("last_close", 2), F.to_date("first_ts").alias("first_day"), F.to_date("last_ts").alias("last_day"), "n")


# -- streams -------------------------------------------------------------------------------------------------------------------
def _stream(spark, d):
    """The events table as a stream of files, in a folder of their own."""
    folder = f"{shared_folder(spark)}/stream-in-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    events.write.parquet(folder)
    return spark.readStream.schema(events.schema).parquet(folder)


def stream_latest(spark, d):
    """The newest event of each type."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    df = _stream(spark, d).select(F.col("event_type").alias("symbol"), F.struct("ts", "event_id").alias("ts"), "value")
    T.keep_latest(df, f"{folder}/out", f"{folder}/check").awaitTermination()
    return T.latest_state(spark, f"{folder}/out").select("symbol", F.col("ts.event_id").alias("event_id"), rd("value", 2))


def stream_append(spark, d):
    """Rows appended once, though the stream is read twice from its start."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for turn in (1, 2):
        T.append_once(_stream(spark, d).select("event_id", "event_type"), f"{folder}/out", [["event_id"]], f"{folder}/check{turn}").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def _streamed(spark, bars, through):
    """The rows of ``bars`` as a stream of files, through an operator into files."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    bars.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(bars.schema).parquet(f"{folder}/in")
    through(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def _enriched(spark, d, warm=0):
    bars = numbered(spark, d).withColumn("interval", F.lit("1h")).select("symbol", "ts", "interval", "event_id", F.col("n").cast("long").alias("arrival"), "close", F.col("volume").cast("double").alias("volume"), (F.col("n") <= warm).alias("warming"))
    return _streamed(spark, bars, lambda x: enrich.enriched(x, D.Limits(return_limit=0.5, z_limit=2.0, volume_ratio=1.5)))


def stream_indicators(spark, d):
    """All indicators of bars as a stream, begun from the first hundred bars of each symbol that only fill the state."""
    return _enriched(spark, d, 100).select("event_id", *[rd(c, 4) for c in _STREAMED])


_STREAMED = ["price_change", "log_return_1", "volume_change_pct", "volatility_20", "volume_sma_20", "volume_ratio", "bb_upper", "bb_lower", "bb_width"]


def stream_dead_letters(spark, d):
    """A log as a stream: sound events into one table, poison messages into another."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = log(spark, d).select("key", "value", "topic", F.col("partition").cast("int").alias("partition"), "offset", F.col("ts").alias("timestamp"), F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"), "event_id")
    rows.withColumn("offset", F.xxhash64("event_id")).drop("event_id").write.parquet(f"{folder}/log")
    T.routed(R.event_log(spark, f"{folder}/log"), f"{folder}/events", f"{folder}/dead", f"{folder}/check", "enricher").awaitTermination()
    good = spark.read.parquet(f"{folder}/events").select(F.lit("event").alias("kind"))
    bad = spark.read.parquet(f"{folder}/dead").select(F.col("reason").alias("kind"))
    return good.unionByName(bad).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def stream_fan_out(spark, d):
    """What a screen gets of a batch of events: the newest of each type and symbol, the 100 newest anomalies, and how many more there were."""
    e = table(spark, d, "events").select(F.when(F.col("value") > 95, "anomaly").otherwise("bar").alias("event_type"), F.col("event_type").alias("symbol"), F.struct("ts", "event_id").alias("ts"))
    latest, found, dropped = T.coalesced(e, 100)
    rows = latest.unionByName(found).select("event_type", "symbol", F.col("ts.event_id").alias("event_id"))
    return rows.unionByName(dropped.select(F.lit("dropped").alias("event_type"), F.lit("").alias("symbol"), F.col("dropped").alias("event_id")))


def scan_grid(spark, d):
    """The opening times of the last 500 whole half-hour bars before a time between two."""
    return R.simulated_grid(spark, F.lit("2024-01-20 10:17:30").cast("timestamp"), "30m", 500).select(stamp("ts", "at"))


def stage_files(spark, d):
    """Bars through the files of a stage and back, a folder a symbol."""
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    G.write_stage(event_bars(spark, d), path, "validated")
    return G.read_stage(spark, path, "validated").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"), F.max("ts").cast("date").alias("last"))


def stream_enrich(spark, d):
    """Bars as a stream through the keyed state: outcome and indicators of each."""
    return _enriched(spark, d).select("event_id", "outcome", rd("return_1", 6), rd("sma_20", 4), rd("ema_12", 4), rd("ema_26", 4), rd("rsi_14", 4))


_NAMES = (
    contract_reasons, contract_invariants, contract_events, dlq_records, contract_predictions, derived_ids, contract_enriched, sink_append_absent, sink_counts, sink_latest, sink_latest_expiring, sink_recent_capped, sink_announced,
    sink_routed, sink_constrained, sink_new_symbols, sink_log_records, sink_manifest, scan_replay, scan_replay_skipped, scan_csv, ops_reconcile, ops_latency, ops_rounded_percentile, ops_gaps, ops_arrivals, ops_first_after, ops_lag,
    ops_counter_increase, ops_hist_quantile, ops_alert_hold, ops_ratio_alert, ops_count_alert, ops_calibration, stream_latest, stream_append, stream_enrich, stream_indicators,
    stream_dead_letters, stream_fan_out, scan_grid, stage_files,
)
QUERIES = {q.__name__: q for q in _NAMES}
_BROKEN = "array_to_string(list_filter([CASE WHEN n % 41 = 0 THEN 'interval' END, CASE WHEN n % 37 = 0 THEN 'time' END, CASE WHEN n % 43 = 0 OR NOT (open + 1 > 0 AND low + 1 > 0 AND close + 1 > 0) THEN 'prices' END, CASE WHEN low > least(CASE WHEN n % 43 = 0 THEN -2 ELSE open END, close) THEN 'low' END], lambda x: x IS NOT NULL), ',')"
_B2 = "nm AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS m FROM nb), tg AS (SELECT * FROM nm WHERE 5 * n <= 3 * m), bt AS (SELECT * FROM nm WHERE 2 * n > m)"
ORACLES = {
    "contract_reasons": f"WITH {_LOG} SELECT event_id, reason FROM cl",
    "contract_invariants": f"WITH {_LOG} SELECT event_id, 'broken: ' || {_BROKEN} AS error FROM cl WHERE reason = 'validation' AND n % 29 <> 0",
    "contract_events": f"WITH {_LOG} SELECT event_id, upper(symbol) AS symbol, {sql_stamp('ts', 'at')}, {sq('close + 1', 2, 'close')}, volume FROM cl WHERE reason IS NULL",
    "dlq_records": f"""WITH {_LOG}, js AS (SELECT *, '{{"event_id":"' || event_id || '",' || CASE WHEN n % 29 = 0 THEN '' WHEN n % 31 = 0 THEN '"event_type":"trade",' ELSE '"event_type":"market.bar",' END || '"schema_version":1,"symbol":"' || upper(symbol)
  || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN n % 37 = 0 THEN '' ELSE 'Z' END || '","interval":"' || CASE WHEN n % 41 = 0 THEN '7h' ELSE '1h' END || '","open":' || CASE WHEN n % 43 = 0 THEN -1.0::DOUBLE ELSE open + 1 END
  || ',"high":' || (high + 1) || ',"low":' || (low + 1) || ',"close":' || (close + 1) || ',"volume":' || volume || ',"extra":1}}' AS j FROM cl WHERE reason IS NOT NULL),
v AS (SELECT *, CASE WHEN n % 19 = 0 THEN '' WHEN n % 23 = 0 THEN j[1:40] WHEN n % 47 = 0 THEN '[' || j || ']' ELSE j END AS v FROM js)
SELECT 'bars' AS original_topic, (n % 3)::INT AS original_partition, n::BIGINT AS original_offset, CASE WHEN n % 11 <> 0 THEN symbol END AS original_key, base64(encode(v)) AS original_value_b64, reason,
CASE WHEN n % 19 = 0 THEN 'empty value' WHEN reason = 'deserialization' THEN 'not a JSON object' WHEN n % 29 = 0 THEN 'event_type or schema_version missing' WHEN n % 31 = 0 THEN 'unexpected event trade v1' ELSE 'broken: ' || {_BROKEN} END AS error_message,
'enricher' AS consumer_group, CASE WHEN n % 11 <> 0 THEN symbol ELSE 'bars' END AS routing_key, 1 AS attempts FROM v""",
    "contract_predictions": f"""WITH {_NUMBERED} SELECT event_id, array_to_string(list_filter([CASE WHEN n % 13 = 0 THEN 'target' END, CASE WHEN n % 17 = 0 THEN 'task' END, CASE WHEN n % 7 = 0 THEN 'probabilities' END], lambda x: x IS NOT NULL), ',') AS broken,
array_to_string(list_filter([CASE WHEN n % 5 = 0 THEN 'version' END, CASE WHEN n % 3 = 0 THEN 'missing' END, CASE WHEN n % 11 = 0 THEN 'finite' END], lambda x: x IS NOT NULL), ',') AS features_broken FROM nb""",
    "derived_ids": f"WITH {_NUMBERED}, k AS (SELECT event_id, unnest([':enriched:1', ':anomaly:volume:spike', ':volume:spike']) AS part FROM nb), a AS (SELECT event_id, part, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(event_id || part)) AS h FROM k), u AS (SELECT event_id, part, {_UUID} AS id FROM a) SELECT event_id, max(id) FILTER (part = ':enriched:1') AS enriched_id, max(id) FILTER (part = ':anomaly:volume:spike') AS anomaly_event_id, max(id) FILTER (part = ':volume:spike') AS anomaly_id FROM u GROUP BY 1",
    "contract_enriched": f"WITH {_NUMBERED}, a AS (SELECT event_id AS source_event_id, ts, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(event_id || ':enriched:1')) AS h FROM nb) SELECT {_UUID} AS event_id, source_event_id, 'market.bar.enriched' AS event_type, {sq(chr(10) + "greatest(0, date_diff('millisecond', ts + INTERVAL 1 HOUR, TIMESTAMP '2024-01-15 00:30:00'))", 1, 'processing_latency_ms')} FROM a",
    "sink_append_absent": f"WITH {_NUMBERED} SELECT event_id, {sql_stamp('ts', 'at')}, {sq('close', 2)} FROM nb",
    "sink_counts": f"WITH {_NUMBERED}, {_B2} SELECT 'market_bars' AS \"table\", count(*) FILTER (5 * n > 3 * m) AS written, count(*) FILTER (5 * n <= 3 * m) AS skipped FROM bt",
    "sink_latest": f"WITH {_NUMBERED}, {_B2}, u AS (SELECT *, 1 AS s FROM tg UNION ALL SELECT * REPLACE (close + 1 AS close), 0 AS s FROM bt WHERE symbol NOT IN ('view', 'click') OR (symbol = 'view' AND 20 * n < 11 * m) OR (symbol = 'click' AND 5 * n <= 3 * m)) SELECT symbol, event_id, {sq('close', 2)} FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, s DESC) = 1",
    "sink_latest_expiring": f"WITH {_NUMBERED}, {_B2} SELECT symbol, arg_max(event_id, ts) AS event_id, '2024-02-01 05:00:00' AS expires_at FROM bt GROUP BY 1",
    "sink_recent_capped": f"WITH {_NUMBERED} SELECT symbol, event_id FROM nb QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 20",
    "sink_announced": f"WITH {_NUMBERED}, {_B2} SELECT event_id FROM bt WHERE 5 * n > 3 * m",
    "sink_routed": "SELECT event_type || 's' AS \"table\", event_id FROM events WHERE event_type IN ('click', 'error')",
    "sink_constrained": f"WITH {_NUMBERED}, r AS (SELECT event_id, array_to_string(list_filter([CASE WHEN NOT (open > 0 AND CASE WHEN n % 15 = 0 THEN low - 1 ELSE high END > 0 AND low > 0 AND close > 0) THEN 'prices' END, CASE WHEN n % 10 = 0 THEN 'volume' END, CASE WHEN n % 15 = 0 THEN 'high' END], lambda x: x IS NOT NULL), ',') AS broken FROM nb) SELECT * FROM r WHERE broken <> ''",
    "sink_new_symbols": "SELECT DISTINCT event_type AS symbol FROM events WHERE event_type NOT IN ('click', 'view')",
    "sink_log_records": f"WITH {_NUMBERED} SELECT symbol AS key, event_id, 'event_type=market.bar;schema_version=1;content-type=application/json;trace_id=' AS headers FROM nb",
    "sink_manifest": f"WITH {EVENT_SQL} SELECT count(*) AS rows, true AS same FROM ev",
    "scan_replay": f"WITH {LINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM li), v AS (SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS batch FROM r WHERE i % 50 <> 0) SELECT batch::INT AS batch, symbol, CAST(ts AS DATE) AS day, {sql_stamp('TIMESTAMP $$2024-01-01$$ + to_milliseconds(batch * 500)', 'due_at')} FROM v WHERE batch < 1000",
    "scan_replay_skipped": f"WITH {LINE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM li), t AS (SELECT symbol, i, CASE WHEN i % 70 = 0 THEN ts - INTERVAL 9 DAY ELSE ts END AS ts, i % 50 <> 0 AS v FROM r), m AS (SELECT *, max(CASE WHEN v THEN ts END) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM t) SELECT symbol, count(*) FILTER (NOT v) AS invalid, count(*) FILTER (v AND ts <= b) AS non_increasing FROM m GROUP BY 1",
    "scan_csv": f"WITH {EVENT_SQL} SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY ts) + 1)::INT AS \"row\", epoch(ts)::BIGINT AS epoch, {sq('close', 2)}, volume FROM ev",
    "ops_reconcile": f"WITH {_REC}, f AS (SELECT id, arg_min(symbol, arrival) AS symbol, arg_min(ts, arrival) AS ts, min(arrival) AS a, count(*) AS times FROM rc GROUP BY 1), w AS (SELECT *, ts < lag(ts) OVER (PARTITION BY symbol ORDER BY a) AS back FROM f) SELECT (SELECT count(DISTINCT event_id) FROM events) AS sent, (SELECT count(*) FROM events WHERE event_id % 37 = 0) AS missing, count(*) AS received, sum(times - 1)::BIGINT AS duplicates, count(*) FILTER (back) AS out_of_order FROM w",
    "ops_latency": f"SELECT event_type, count(value) AS n, {sq('avg(value)', 4, 'mean')}, {', '.join(sq(f'quantile_disc(value, {q})', 2, f'p{int(q * 100)}') for q in (0.5, 0.9, 0.95, 0.99))}, {sq('max(value)', 2, 'max')} FROM events GROUP BY 1",
    "ops_rounded_percentile": f"WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, {sq('value', 2)} FROM r WHERE i = round_even((n - 1) * 0.95::DOUBLE, 0)",
    "ops_gaps": f"WITH g AS (SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY event_type ORDER BY ts), ts) / 1e6 AS g FROM events) SELECT event_type, {sq('max(g)', 3, 'largest_gap_s')} FROM g GROUP BY 1",
    "ops_arrivals": f"WITH c AS (SELECT event_type, date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT event_type, unnest(range(min(t), max(t) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS t FROM c GROUP BY 1) SELECT event_type, {sql_stamp('t', 'at')}, coalesce(n, 0) AS n FROM r LEFT JOIN c USING (event_type, t)",
    "ops_first_after": f"SELECT event_type, {sq(chr(10) + "date_diff('microsecond', TIMESTAMP '2024-01-10', min(ts)) / 1e6", 3, 'after_s')} FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1",
    "ops_lag": """WITH b AS (SELECT c_mktsegment AS topic, (c_custkey % 4)::INT AS partition, min(c_custkey) AS low, max(c_custkey) AS e FROM customer GROUP BY 1, 2),
c AS (SELECT 'g' || (c_nationkey % 3) AS grp, c_mktsegment AS topic, (c_custkey % 4)::INT AS partition, max(c_custkey) AS o FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1, 2, 3),
d AS (SELECT * FROM c WHERE topic <> 'MACHINERY' OR grp <> 'g1')
SELECT grp AS "group", b.topic, b.partition, greatest(0, e - coalesce(o, low)) AS lag FROM b JOIN (SELECT DISTINCT grp, topic FROM d) t USING (topic) LEFT JOIN d USING (grp, topic, partition)""",
    "ops_counter_increase": f"WITH {_NUMBERED}, s AS (SELECT symbol, ts, (n * 7 % 400)::DOUBLE AS v FROM nb), e AS (SELECT *, CASE WHEN lag(v) OVER w IS NULL THEN 0 WHEN v < lag(v) OVER w THEN v ELSE v - lag(v) OVER w END AS dv FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts)), g AS (SELECT *, sum(dv) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 21599 SECOND PRECEDING AND CURRENT ROW) AS inc FROM e) SELECT symbol, {sql_stamp('ts', 'at')}, {sq('inc', 4, 'increase')}, {sq('inc / 21600', 8, 'rate')} FROM g",
    "ops_hist_quantile": f"WITH b AS (SELECT event_type, le, count(*) FILTER (value <= le) AS c FROM events, (VALUES (1.0::DOUBLE), (5.0), (10.0), (50.0), (100.0), ('inf'::DOUBLE)) AS m(le) GROUP BY 1, 2), x AS (SELECT *, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS c0, 0.9::DOUBLE * max(c) OVER (PARTITION BY event_type) AS rk FROM b WINDOW w AS (PARTITION BY event_type ORDER BY le)) SELECT event_type, {sq('min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rk - c0) / (c - c0) END)', 5, 'quantile')} FROM x WHERE c >= rk AND c0 < rk GROUP BY 1",
    "ops_alert_hold": f"WITH {_NUMBERED}, s AS (SELECT symbol, ts, n * 7 % 400 > 100 AS c FROM nb), r AS (SELECT *, sum((NOT c)::INT) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM s), g AS (SELECT symbol, run, min(ts) AS a, max(ts) AS b FROM r WHERE c GROUP BY 1, 2) SELECT symbol, {sql_stamp('a', 'since')}, {sql_stamp('b', 'until')}, {sql_stamp('a + INTERVAL 6 HOUR', 'fired_at')} FROM g WHERE b - a >= INTERVAL 6 HOUR",
    "ops_ratio_alert": f"WITH g AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS part, count(*) AS total FROM events GROUP BY 1) SELECT user_id, part, total, {sq('part / total', 6, 'ratio')}, part / total > 0.18 AS alert FROM g",
    "ops_count_alert": "SELECT event_type, count(*) FILTER (value > 50) AS n, count(*) FILTER (value > 50) >= 10 AS alert FROM events GROUP BY 1",
    "ops_calibration": f"WITH {LINE_SQL}, u AS (SELECT * FROM li WHERE close > 0 AND volume > 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 757), r AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM u) SELECT symbol, {sq('avg(r) * 252', 4, 'annual_drift')}, {sq('stddev_samp(r) * sqrt(252)', 4, 'annual_volatility')}, floor(median(volume))::BIGINT AS median_volume, {sq('stddev_samp(ln(volume))', 4, 'log_volume_sd')}, {sq('arg_max(close, ts)', 2, 'last_close')}, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 60",
    "stream_indicators": f"""WITH {EVENT_SQL}, k AS (SELECT symbol, ts, close, volume, row_number() OVER w AS n, lag(close) OVER w AS pc, lag(volume) OVER w AS pv FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
f AS (SELECT *, stddev_pop(close) OVER w AS dev, avg(close) OVER w AS m, avg(volume) OVER w AS vm, stddev_samp(ln(close / pc)) OVER w AS vol FROM k WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol || '-' || n AS event_id, {sq('close - pc', 4, 'price_change')}, {sq('ln(close / pc)', 4, 'log_return_1')}, {sq('(volume - pv) / pv', 4, 'volume_change_pct')}, {sq('vol', 4, 'volatility_20')}, {sq('vm', 4, 'volume_sma_20')}, {sq('volume / vm', 4, 'volume_ratio')},
{sq('m + 2 * dev', 4, 'bb_upper')}, {sq('m - 2 * dev', 4, 'bb_lower')}, {sq('4 * dev / m', 4, 'bb_width')} FROM f WHERE n > 100""",
    "stream_dead_letters": f"WITH {_LOG} SELECT coalesce(reason, 'event') AS kind, count(*) AS n FROM cl GROUP BY 1",
    "stream_fan_out": """WITH e AS (SELECT CASE WHEN value > 95 THEN 'anomaly' ELSE 'bar' END AS kind, event_type AS symbol, ts, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY kind, symbol ORDER BY ts DESC, event_id DESC) AS i, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS j FROM e)
SELECT kind AS event_type, symbol, event_id FROM r WHERE CASE WHEN kind = 'bar' THEN i = 1 ELSE j <= 100 END UNION ALL SELECT 'dropped', '', greatest(count(*) - 100, 0) FROM e WHERE kind = 'anomaly'""",
    "scan_grid": f"WITH g AS (SELECT unnest(range(TIMESTAMP '2024-01-20 10:00:00' - INTERVAL 15000 MINUTE, TIMESTAMP '2024-01-20 10:00:00', INTERVAL 30 MINUTE)) AS ts) SELECT {sql_stamp('ts', 'at')} FROM g",
    "stage_files": f'WITH {EVENT_SQL} SELECT symbol, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume, CAST(max(ts) AS DATE) AS "last" FROM ev GROUP BY 1',
    "stream_latest": f"SELECT event_type AS symbol, arg_max(event_id, ts) AS event_id, {sq('arg_max(value, ts)', 2, 'value')} FROM events GROUP BY 1",
    "stream_append": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_enrich": f"""WITH RECURSIVE {EVENT_SQL}, k AS (SELECT symbol, ts, close, row_number() OVER w AS n, close - lag(close) OVER w AS ch FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
r AS (SELECT symbol, n, close AS e12, close AS e26, 0::DOUBLE AS up, 0::DOUBLE AS dn FROM k WHERE n = 1 UNION ALL
  SELECT k.symbol, k.n, e12 + (close - e12) * 2 / 13, e26 + (close - e26) * 2 / 27, CASE WHEN k.n <= 15 THEN up + greatest(ch, 0) / 14 ELSE (up * 13 + greatest(ch, 0)) / 14 END, CASE WHEN k.n <= 15 THEN dn + greatest(-ch, 0) / 14 ELSE (dn * 13 + greatest(-ch, 0)) / 14 END
  FROM r JOIN k ON k.symbol = r.symbol AND k.n = r.n + 1),
f AS (SELECT k.*, e12, e26, up, dn, CASE WHEN k.n >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) END AS sma FROM k JOIN r USING (symbol, n))
SELECT symbol || '-' || n AS event_id, 'processed' AS outcome, {sq('ch / (close - ch)', 6, 'return_1')}, {sq('sma', 4, 'sma_20')}, {sq('CASE WHEN n >= 12 THEN e12 END', 4, 'ema_12')}, {sq('CASE WHEN n >= 26 THEN e26 END', 4, 'ema_26')},
{sq('CASE WHEN n >= 15 THEN CASE WHEN dn = 0 THEN CASE WHEN up > 0 THEN 100 ELSE 50 END ELSE 100 - 100 / (1 + up / dn) END END', 4, 'rsi_14')} FROM f""",
}
