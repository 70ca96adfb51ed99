"""Queries of tables' checks and keys, recent sets, outcomes of messages and versions' states."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.functions import ids
from barflow.operators import models as M, policy as P
from barflow.plans.common import rd, sq, table
from barflow.plans.modelling import _DEPLOY, deployments
from barflow.plans.stream_rules import _ARRIVALS, _NUMBERED, arrivals, numbered
from barflow.sources import sinks as S


def sink_recent(spark, d):
    """The 500 newest payloads of all symbols, with the payloads: a bar and its redelivery at another time are one."""
    bars = numbered(spark, d).withColumn("produced_at", F.col("ts"))
    payload = lambda x: x.withColumn("payload", ids.canonical_json("symbol", "event_id", "volume", "interval"))
    again = bars.where("n % 3 = 0").withColumn("produced_at", F.current_timestamp())
    return S.recent(payload(bars), payload(again)).select("symbol", "event_id", "payload")


def _rows(spark, d):
    """Rows of five tables from orders, each with faults of its own."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    pick = lambda by, names: F.element_at(F.array(*map(F.lit, names)), (k % by % len(names) + 1).cast("int"))
    return {
        "anomalies": o.select(k.alias("id"), pick(11, ["price_spike", "price_drop", "volume_spike", "gap"]).alias("anomaly_type"), pick(7, ["low", "medium", "high", "critical", "none"]).alias("severity")),
        "predictions": o.select(
            k.alias("id"), "ts", (F.col("ts") + F.make_interval(days=(k % 5).cast("int"))).alias("target_ts"), (k % 4).alias("horizon_bars"), pick(13, ["direction", "return", "rank"]).alias("task"), pick(9, ["up", "down", "neutral", "flat"]).alias("predicted_direction"),
            (k % 120 / 100).alias("confidence"),
        ),
        "prediction_outcomes": o.select(k.alias("id"), pick(9, ["up", "down", "neutral", "flat"]).alias("actual_direction")),
        "model_deployments": o.select(k.alias("id"), pick(10, ["candidate", "challenger", "champion", "archived", "live"]).alias("to_stage"), F.when(k % 3 > 0, pick(12, ["candidate", "challenger", "retired"])).alias("from_stage")),
        "monitoring_reports": o.select(k.alias("id"), "ts", F.col("ts").alias("window_start"), (F.col("ts") + F.make_interval(days=(k % 4 - 1).cast("int"))).alias("window_end"), pick(10, ["data_drift", "prediction_drift", "performance", "operational", "retrain"]).alias("report_type"), pick(8, ["ok", "warning", "alert", "bad"]).alias("status")),
    }


def table_checks(spark, d):
    """Every rejected row of five tables, with the checks that it breaks."""
    out = None
    for name, rows in _rows(spark, d).items():
        _, bad = S.constrained(rows, S.checks(name))
        part = bad.select(F.lit(name).alias("table"), "id", F.array_join("broken", ",").alias("broken"))
        out = part if out is None else out.unionByName(part)
    return out


def table_keys(spark, d):
    """What an append to six tables writes and skips: rows that repeat any of a table's unique keys are skipped."""
    e = table(spark, d, "events")
    k, text = F.col("event_id"), lambda by: (F.col("event_id") % by).cast("string")
    made = {
        "symbols": e.select(text(700).alias("symbol"), k.alias("v")), "bar_indicators": e.select("event_type", text(900).alias("symbol"), F.lit("1h").alias("bar_interval"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts")).drop("event_type"),
        "anomalies": e.select(text(3000).alias("anomaly_id"), text(2000).alias("source_event_id"), (k % 2).cast("string").alias("detector"), F.lit("price_spike").alias("anomaly_type")),
        "predictions": e.select(text(1234).alias("prediction_id")), "prediction_outcomes": e.select(text(777).alias("prediction_id")), "watchlist_items": e.select((k % 41).cast("string").alias("user_id"), F.col("event_type").alias("symbol")),
    }
    out = None
    for name, rows in made.items():
        stored = rows.where(F.lit(False))
        part = S.append_counts(rows, stored, S.KEYS[name], name)
        out = part if out is None else out.unionByName(part)
    return out


def policy_messages(spark, d):
    """All six outcomes of a log's messages: some can't be read, some only fill states, one symbol's processing failed late."""
    df = arrivals(spark, d)
    key = ["symbol", "event_id", "arrival"]
    messages = df.select(*key, F.when(F.col("arrival") % 23 == 0, "deserialization").alias("reason"), (F.col("arrival") < 1500).alias("warming"))
    sound = df.join(messages.where("reason is null").select(*key), key, "left_semi")
    judged = P.outcomes(sound).where("symbol <> 'view' or arrival < 5000")
    return P.outcome_counts(P.message_outcomes(messages, judged, key), "symbol")


def model_status(spark, d):
    """Every version with its stage and the tags of its evaluation, also where it has only one of both."""
    dep = deployments(spark, d)
    names = table(spark, d, "customer").select(F.concat(F.lit("m"), (F.col("c_custkey") % 6).cast("string")).alias("model_name"), F.concat(F.lit("v"), (F.col("c_custkey") % 9).cast("string")).alias("model_version"), "c_acctbal")
    tags = names.groupBy("model_name", "model_version").agg((F.avg("c_acctbal") / 10_000).alias("test_log_loss"), (F.max("c_acctbal") / 10_000).alias("test_null_log_loss"))
    return M.version_status(dep, tags).select("model_name", "model_version", "stage", F.to_date("since").alias("since"), rd("test_log_loss", 6), rd("test_null_log_loss", 6))


QUERIES = {q.__name__: q for q in (sink_recent, table_checks, table_keys, policy_messages, model_status)}
_PICK = lambda by, names: f"[{', '.join(repr(n) for n in names)}][o_orderkey % {by} % {len(names)} + 1]"
ORACLES = {
    "sink_recent": f"""WITH {_NUMBERED}, p AS (SELECT symbol, event_id, ts, '{{"event_id":"' || event_id || '","interval":"' || interval || '","symbol":"' || symbol || '","volume":' || volume || '}}' AS payload FROM nb)
SELECT symbol, event_id, payload FROM p ORDER BY ts DESC, payload LIMIT 500""",
    "table_checks": f"""WITH a AS (SELECT o_orderkey AS id, {_PICK(11, ['price_spike', 'price_drop', 'volume_spike', 'gap'])} AS x, {_PICK(7, ['low', 'medium', 'high', 'critical', 'none'])} AS y FROM orders),
p AS (SELECT o_orderkey AS id, {_PICK(13, ['direction', 'return', 'rank'])} AS t, {_PICK(9, ['up', 'down', 'neutral', 'flat'])} AS x FROM orders),
m AS (SELECT o_orderkey AS id, {_PICK(10, ['candidate', 'challenger', 'champion', 'archived', 'live'])} AS x, CASE WHEN o_orderkey % 3 > 0 THEN {_PICK(12, ['candidate', 'challenger', 'retired'])} END AS y FROM orders),
r AS (SELECT o_orderkey AS id, {_PICK(10, ['data_drift', 'prediction_drift', 'performance', 'operational', 'retrain'])} AS x, {_PICK(8, ['ok', 'warning', 'alert', 'bad'])} AS y FROM orders),
b AS (
  SELECT 'anomalies' AS "table", id, concat_ws(',', CASE WHEN x = 'gap' THEN 'anomaly_type' END, CASE WHEN y = 'none' THEN 'severity' END) AS broken FROM a
  UNION ALL SELECT 'predictions', id, concat_ws(',', CASE WHEN id % 5 = 0 THEN 'target' END, CASE WHEN id % 4 = 0 THEN 'horizon' END, CASE WHEN t = 'rank' THEN 'task' END, CASE WHEN x = 'flat' THEN 'direction' END, CASE WHEN id % 120 > 100 THEN 'confidence' END) FROM p
  UNION ALL SELECT 'prediction_outcomes', id, CASE WHEN x = 'flat' THEN 'direction' ELSE '' END FROM p
  UNION ALL SELECT 'model_deployments', id, concat_ws(',', CASE WHEN x = 'live' THEN 'to_stage' END, CASE WHEN y = 'retired' THEN 'from_stage' END) FROM m
  UNION ALL SELECT 'monitoring_reports', id, concat_ws(',', CASE WHEN id % 4 < 2 THEN 'window' END, CASE WHEN x = 'retrain' THEN 'report_type' END, CASE WHEN y = 'bad' THEN 'status' END) FROM r)
SELECT "table", id, broken FROM b WHERE broken <> ''""",
    "table_keys": """WITH g AS (
  SELECT 'symbols' AS "table", count(DISTINCT event_id % 700) AS written FROM events
  UNION ALL SELECT 'bar_indicators', count(DISTINCT (event_id % 900, CAST(ts AS DATE))) FROM events
  UNION ALL SELECT 'anomalies', count(DISTINCT source) FROM (SELECT anomaly, min(source) AS source FROM (SELECT event_id % 3000 AS anomaly, CAST(event_id % 2000 AS VARCHAR) || '/' || event_id % 2 AS source FROM events) GROUP BY anomaly)
  UNION ALL SELECT 'predictions', count(DISTINCT event_id % 1234) FROM events
  UNION ALL SELECT 'prediction_outcomes', count(DISTINCT event_id % 777) FROM events
  UNION ALL SELECT 'watchlist_items', count(DISTINCT (event_id % 41, event_type)) FROM events)
SELECT "table", written, (SELECT count(*) FROM events) - written AS skipped FROM g""",
    "policy_messages": f"WITH {_ARRIVALS.replace('c AS (SELECT *, coalesce(', 'ar2 AS (SELECT * FROM ar WHERE arrival % 23 <> 0),' + chr(10) + 'c AS (SELECT *, coalesce(').replace('PARTITION BY symbol ORDER BY arrival))::INT, 0) AS ch FROM ar)', 'PARTITION BY symbol ORDER BY arrival))::INT, 0) AS ch FROM ar2)')}, q AS (SELECT ar.symbol, CASE WHEN ar.arrival % 23 = 0 THEN 'invalid' WHEN ar.symbol = 'view' AND ar.arrival >= 5000 THEN 'error' WHEN ar.arrival < 1500 THEN 'warmup' ELSE o.outcome END AS outcome FROM ar LEFT JOIN o ON o.symbol = ar.symbol AND o.event_id = ar.event_id AND o.arrival = ar.arrival) SELECT symbol, outcome, count(*) AS n FROM q GROUP BY ALL",
    "model_status": f"""WITH {_DEPLOY}, l AS (SELECT model_name, model_version, arg_max(to_stage, id) AS stage, CAST(max(created_at) AS DATE) AS since FROM dp GROUP BY 1, 2),
t AS (SELECT 'm' || (c_custkey % 6) AS model_name, 'v' || (c_custkey % 9) AS model_version, avg(c_acctbal) / 10000 AS a, max(c_acctbal) / 10000 AS b FROM customer GROUP BY 1, 2)
SELECT model_name, model_version, stage, since, {sq('a', 6, 'test_log_loss')}, {sq('b', 6, 'test_null_log_loss')} FROM l FULL JOIN t USING (model_name, model_version)""",
}
