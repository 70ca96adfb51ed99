"""Queries of streams with state: enrichment, features and scoring, restarts, bounds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from barflow.operators import features as X
from barflow.plans.common import rd, sq, sql_stamp, sqs, stamp, table
from barflow.plans.indicators import FEATURES_SQL, _READY
from barflow.plans.pipelines import ORACLES as _OTHERS, _enriched, _stream, _streamed
from barflow.plans.stream_rules import _DETECTED, numbered
from barflow.sources import sinks as S
from barflow.sources.bars import EVENT_SQL, line_bars, roll_up
from barflow.sources.session import shared_folder
from barflow.streaming import bootstrap, enrich, sinks as T


def _folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_rollup(spark, d):
    """Hourly bars of the event stream, kept up to date by what each batch changes; the last ones, which the watermark has not passed, too."""
    folder = _folder(spark)
    df = T.rolled_up(_stream(spark, d), "ts", "1 hour", "2 hours", ["event_type"], "value", ["event_id"])
    T.keep_updated(df, f"{folder}/out", f"{folder}/check").awaitTermination()
    return T.updated(spark, f"{folder}/out", ["event_type", "ts"]).select("event_type", stamp("ts", "at"), *[rd(c, 2) for c in ("open", "high", "low", "close")], "volume")


def stream_anomalies(spark, d):
    """What the three detectors find in the stream."""
    return enrich.anomalies(_enriched(spark, d)).select("source_event_id", "detector", "anomaly_type", "severity", rd("score", 5))


def _daily(spark, d):
    bars = X.with_gaps(line_bars(spark, d), daily=True)
    key = F.concat_ws("-", "symbol", F.to_date("ts").cast("string")).alias("event_id")
    return bars.select("symbol", "ts", "interval", key, F.unix_timestamp("ts").alias("arrival"), F.col("gap_before").cast("int").alias("gap_before"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"))


def stream_features(spark, d):
    """Live features of daily bars: those of batch, for every third bar of a symbol once they are ready."""
    out = _streamed(spark, _daily(spark, d), lambda x: enrich.featured(x, 3))
    return out.where("status = 'ready'").select("event_id", *[rd(c, 5) for c in X.NAMES])


def stream_scored(spark, d):
    """Predictions of live features, each once though the stream is read twice."""
    folder, bars = _folder(spark), _daily(spark, d)
    bars.write.parquet(f"{folder}/in")
    predict = lambda df: df.withColumn("score", 1 / (1 + F.exp(-F.col("ret_5"))))
    for turn in (1, 2):
        stream = enrich.featured(spark.readStream.schema(bars.schema).parquet(f"{folder}/in"))
        T.scored(stream, f"{folder}/out", f"{folder}/check{turn}", predict, "momentum", "1").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("symbol", stamp("ts", "at"), stamp("target_ts", "target"), "predicted_direction", rd("confidence", 5), F.size("features").alias("inputs"))


def _log(spark, d):
    """Hourly bars as a log of three partitions: a symbol's bars are in one, each partition in order of time."""
    bars = numbered(spark, d).withColumn("interval", F.lit("1h")).withColumn("partition", F.pmod(F.crc32("symbol"), F.lit(3)).cast("int"))
    offset = F.row_number().over(Window.partitionBy("partition").orderBy("ts", "symbol")).cast("long") - 1
    return bars.select(F.lit("bars").alias("topic"), "partition", offset.alias("offset"), "symbol", "ts", "interval", "event_id", offset.alias("arrival"), "close", F.col("volume").cast("double").alias("volume"))


def _run(stream, folder, turn):
    stream.writeStream.format("parquet").option("path", f"{folder}/out{turn}").option("checkpointLocation", f"{folder}/check{turn}").trigger(availableNow=True).start().awaitTermination()


def stream_resumed(spark, d):
    """Bars enriched up to a place in each partition by a stream that then loses its state, and by one that goes on from the committed
    offsets with what the last 2,000 messages before them make of the states: the indicators of a stream that never stopped."""
    folder, log = _folder(spark), _log(spark, d)
    log.write.parquet(f"{folder}/log")
    log = spark.read.parquet(f"{folder}/log")
    read = lambda: spark.readStream.schema(log.schema).parquet(f"{folder}/log")
    _run(enrich.enriched(read().where("offset < 400 + 150 * partition")), folder, 1)
    first = spark.read.parquet(f"{folder}/out1")
    offsets = bootstrap.committed(log.join(first.select("event_id"), "event_id", "left_semi"))
    history = bootstrap.history(log, offsets)
    _run(enrich.enriched(bootstrap.remaining(read(), log, offsets), history=history), folder, 2)
    out = first.unionByName(spark.read.parquet(f"{folder}/out2"))
    return out.select("event_id", "outcome", rd("return_1", 6), rd("sma_20", 4), rd("ema_12", 4), rd("ema_26", 4), rd("rsi_14", 4))


def stream_bounded(spark, d):
    """Enrichment that remembers 30 symbols, each event type of eight groups of users: a symbol that 30 others followed since its last bar
    begins again."""
    e = table(spark, d, "events")
    symbol = F.concat_ws("-", "event_type", (F.col("user_id") % 8).cast("string"))
    bars = roll_up(e, symbol, F.date_trunc("hour", F.col("ts")), F.col("value"), F.lit(1), ["ts", "event_id"], "1h")
    rank = F.unix_timestamp("ts") * 1000 + F.ascii("symbol") * 8 + F.right("symbol", F.lit(1)).cast("int")
    bars = bars.select("symbol", "ts", "interval", F.concat_ws("@", "symbol", F.date_format("ts", "yyyy-MM-dd HH")).alias("event_id"), rank.alias("arrival"), "close", F.col("volume").cast("double").alias("volume"))
    out = _streamed(spark, bars, lambda x: enrich.enriched(x, symbols=30, buckets=1))
    return out.select("event_id", "outcome", "missing_bars", rd("return_1", 6), rd("volume_change_pct", 4), rd("sma_20", 4))


def stream_recovered(spark, d):
    """Events appended once by day, though the writer dies between writing its second batch and committing it."""
    folder, events = _folder(spark), table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.to_date("ts").alias("day"))
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    died: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        S.append_absent(batch, f"{folder}/out", [["event_id"]], "day")
        if number == 1 and not died:
            died.append(number)
            raise RuntimeError("dies before the commit")

    for _ in range(2):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except Exception:
            if not died:
                raise
    return spark.read.parquet(f"{folder}/out").groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


def _arriving(spark, d, twice=False):
    """Events as a stream of six files of five days. Of the first fifteen days every 50th comes fifteen days late, long behind any watermark;
    of the last six hours of a file some come with the next, in time. ``twice``: every tenth comes again with the next file."""
    folder = _folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 20).alias("user"), F.col("ts").cast("timestamp").alias("ts"))
    hour = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 3600)
    own = F.least(F.floor(hour / 120), F.lit(5))
    file = F.when((F.col("event_id") % 50 == 7) & (own <= 2), own + 3).when((F.col("event_id") % 50 == 8) & (hour % 120 >= 114) & (own < 5), own + 1).otherwise(own)
    rows = e.withColumn("file", file)
    rows = rows.unionByName(rows.where("event_id % 10 = 0 and file < 5").withColumn("file", F.col("file") + 1)) if twice else rows
    for k in range(6):
        rows.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _appended(spark, stream):
    folder = _folder(spark)
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def stream_sessions(spark, d):
    """Sessions of users that the watermark has closed, each written once and then forgotten; events long behind it are left out."""
    out = _appended(spark, T.sessions(_arriving(spark, d), "ts", "30 minutes", "1 day", ["event_type", "user"]))
    return out.select("event_type", "user", stamp("start", "start"), stamp("end", "end"), "n")


def stream_deduplicated(spark, d):
    """Events that come again a file later, each once within the watermark, and those long behind it left out."""
    out = _appended(spark, T.deduplicated(_arriving(spark, d, twice=True), "ts", "1 day", "event_id"))
    return out.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


QUERIES = {q.__name__: q for q in (stream_rollup, stream_anomalies, stream_features, stream_scored, stream_resumed, stream_bounded, stream_recovered, stream_sessions, stream_deduplicated)}
_WEEKDAYS = "coalesce(greatest(0, len(list_filter(range(lag(ts) OVER w, ts, INTERVAL 1 DAY), lambda x: isodow(x) < 6)) - 1), 0)::INT AS gap_before"
_DAILY_SQL = FEATURES_SQL.replace(FEATURES_SQL[FEATURES_SQL.index("greatest(0, coalesce(round_even") : FEATURES_SQL.index(" FROM li WINDOW w")], _WEEKDAYS)
_AHEAD = "ts + to_days((CASE WHEN isodow(ts) > 5 THEN 8 - isodow(ts) ELSE 0 END + 5 + 2 * ((CASE WHEN isodow(ts) > 5 THEN 0 ELSE isodow(ts) - 1 END + 5) // 5))::INT)"
ORACLES = {
    "stream_rollup": f"WITH {EVENT_SQL} SELECT symbol AS event_type, {sql_stamp('ts', 'at')}, {sqs({c: 2 for c in ('open', 'high', 'low', 'close')})}, volume FROM ev",
    "stream_anomalies": f"{_DETECTED} SELECT event_id AS source_event_id, detector, anomaly_type, severity, {sq('score', 5)} FROM a",
    "stream_features": f"{_DAILY_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS seen FROM x) SELECT symbol || '-' || day AS event_id, {sqs({c: 5 for c in X.NAMES})} FROM e WHERE seen % 3 = 0 AND {_READY}",
    "stream_scored": f"{_DAILY_SQL}, e AS (SELECT *, 1 / (1 + exp(-ret_5)) AS p FROM x WHERE {_READY}) SELECT symbol, {sql_stamp('ts', 'at')}, {sql_stamp(_AHEAD, 'target')}, CASE WHEN p >= 0.5 THEN 'up' ELSE 'down' END AS predicted_direction, {sq('greatest(p, 1 - p)', 5, 'confidence')}, 28::INT AS inputs FROM e",
    "stream_resumed": _OTHERS["stream_enrich"],
    "stream_bounded": f"""WITH b AS (
  SELECT concat(event_type, '-', user_id % 8) AS symbol, date_trunc('hour', ts) AS ts, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (ORDER BY ts, ascii(symbol), right(symbol, 1)) AS i FROM b),
p AS (SELECT *, lag(i) OVER s AS before, lead(i) OVER s AS after FROM o WINDOW s AS (PARTITION BY symbol ORDER BY i)),
c AS (SELECT p.symbol, p.i, count(q.i) AS others FROM p LEFT JOIN p AS q ON q.i > p.before AND q.i < p.i AND (q.after IS NULL OR q.after > p.i) GROUP BY ALL),
g AS (SELECT p.*, sum(CASE WHEN others >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY i) AS part FROM p JOIN c USING (symbol, i)),
f AS (SELECT *, lag(close) OVER v AS pc, lag(volume) OVER v AS pv, lag(ts) OVER v AS pt, row_number() OVER v AS k, avg(close) OVER (PARTITION BY symbol, part ORDER BY i ROWS 19 PRECEDING) AS m FROM g WINDOW v AS (PARTITION BY symbol, part ORDER BY i))
SELECT symbol || '@' || strftime(ts, '%Y-%m-%d %H') AS event_id, 'processed' AS outcome, coalesce(greatest(0, date_diff('hour', pt, ts) - 1), 0)::INT AS missing_bars, {sq('(close - pc) / pc', 6, 'return_1')}, {sq('(volume - pv) / pv', 4, 'volume_change_pct')}, {sq('CASE WHEN k >= 20 THEN m END', 4, 'sma_20')} FROM f""",
    "stream_sessions": f"""WITH k AS (SELECT event_type, user_id % 20 AS user, ts FROM events WHERE NOT (event_id % 50 = 7 AND ts < TIMESTAMP '2024-01-16')),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY event_type, user ORDER BY ts)),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type, user ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g)
SELECT event_type, user, {sql_stamp('min(ts)', 'start')}, {sql_stamp('max(ts) + INTERVAL 30 MINUTE', '"end"')}, count(*) AS n FROM h GROUP BY event_type, user, no HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""",
    "stream_deduplicated": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(*) AS ids FROM events WHERE NOT (event_id % 50 = 7 AND ts < TIMESTAMP '2024-01-16') GROUP BY 1, 2",
    "stream_recovered": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, count(*) AS ids FROM events GROUP BY 1, 2",
}
