"""Schemas of the events and tables, by type and version."""

from __future__ import annotations

from pyspark.sql import types as T

ENVELOPE = "event_id string, event_type string, schema_version int, produced_at timestamp, source string, trace_id string"
_BAR = "symbol string, timestamp timestamp, interval string, open double, high double, low double, close double, volume bigint"
_ANOMALY = "anomaly_id string, symbol string, timestamp timestamp, interval string, anomaly_type string, severity string, observed_value double, expected_value double, score double, threshold double, detector string, detector_version string, source_event_id string, details map<string,double>"
_PREDICTION = "prediction_id string, symbol string, bar_interval string, ts timestamp, target_ts timestamp, horizon_bars int, task string, predicted_direction string, predicted_return double, class_probabilities map<string,double>, confidence double, model_name string, model_version string, feature_set_version string, features map<string,double>, inference_latency_ms double, source_event_id string"
_INDICATORS = "indicators struct<return_1:double,log_return_1:double,price_change:double,volume_change_pct:double,sma_20:double,ema_12:double,ema_26:double,volatility_20:double,volume_sma_20:double,volume_ratio:double,rsi_14:double,macd:double,macd_signal:double,macd_hist:double,bb_upper:double,bb_middle:double,bb_lower:double,bb_width:double>"
_DEAD = "original_topic string, original_partition int, original_offset bigint, original_key string, original_value_b64 string, reason string, error_message string, consumer_group string, attempts int, failed_at timestamp"

#: Known events: (type, version) -> DDL.
EVENTS = {
    ("market.bar", 1): f"{ENVELOPE}, {_BAR}",
    ("market.bar.enriched", 1): f"{ENVELOPE}, {_BAR}, source_event_id string, {_INDICATORS}, indicator_version string, processing_latency_ms double",
    ("anomaly.detected", 1): f"{ENVELOPE}, {_ANOMALY}",
    ("prediction.made", 1): f"{ENVELOPE}, {_PREDICTION}",
    ("dead.letter", 1): f"{ENVELOPE}, {_DEAD}",
}
#: A log's columns, as the streaming source of a broker gives them.
LOG = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, headers array<struct<key:string,value:binary>>"
RAW_BARS = "symbol string, row int, raw_timestamp string, raw_open string, raw_high string, raw_low string, raw_close string, raw_volume string"


def schema(event_type: str, version: int = 1) -> T.StructType:
    return T.StructType.fromDDL(EVENTS[event_type, version])
