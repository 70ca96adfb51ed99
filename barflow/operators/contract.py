"""The event contract: decoding, classification of failures, dead letters, invariants, derived events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barflow.functions import ids, timegrid as G
from barflow.sources.schemas import EVENTS

SYMBOL = r"^[A-Z][A-Z0-9.\-]{0,14}$"
LONGEST_ERROR = 2000
_ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"


def violations(**rules: Column) -> Column:
    """Names of the rules that a row breaks; a rule that is null counts as broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())


def bar_violations(prefix: str = "", time_text: Column | None = None) -> Column:
    """Invariants of a bar: prices above 0 and finite, volume not negative, high and low around the others, a known interval, a
    well-formed symbol, and a time with its zone."""
    col = lambda c: F.col(f"{prefix}{c}")
    o, h, low, c = (col(x) for x in ("open", "high", "low", "close"))
    sound = lambda x: (x > 0) & ~F.isnan(x) & (x < float("inf"))
    return violations(
        symbol=col("symbol").rlike(SYMBOL), interval=col("interval").isin(*G.SECONDS), time=time_text.rlike(_ZONE) if time_text is not None else col("timestamp").isNotNull(),
        prices=sound(o) & sound(h) & sound(low) & sound(c), volume=col("volume") >= 0, high=h >= F.greatest(o, c, low), low=low <= F.least(o, c),
    )


def prediction_violations() -> Column:
    """Target after its time, the field that the task asks for, probabilities that sum to 1 within 0.001."""
    total = F.aggregate(F.map_values("class_probabilities"), F.lit(0.0), lambda a, x: a + x)
    task = F.when(F.col("task") == "direction", F.col("predicted_direction").isNotNull()).when(F.col("task") == "return", F.col("predicted_return").isNotNull())
    return violations(target=F.col("target_ts") > F.col("ts"), task=task, probabilities=F.col("class_probabilities").isNull() | (F.size("class_probabilities") == 0) | (F.abs(total - 1) <= 1e-3))


def feature_violations(names: list[str], version: str, most: int = 256) -> Column:
    """The feature set's version, no missing feature, only finite values, and no more of them than a request holds."""
    f = F.col("features")
    finite = F.forall(F.map_values(f), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return violations(version=F.col("feature_set_version") == version, missing=F.size(F.array_except(F.array(*map(F.lit, names)), F.map_keys(f))) == 0, finite=finite, size=F.size(f) <= most)


def decoded(log: DataFrame, event_type: str = "market.bar", version: int = 1) -> DataFrame:
    """Log rows with ``event``, and ``reason`` and ``error`` where a value isn't a sound event of the type.

    deserialization: empty, not JSON or not an object; validation: no type or version, or an invariant; unknown_event_type:
    any other pair of them. Unknown fields are ignored. One pass gives both outputs.
    """
    text = F.trim(F.decode("value", "utf-8"))
    df = log.withColumn("_text", text)
    df = df.withColumn("_valid", F.coalesce(F.col("_text").startswith("{") & F.expr("try_parse_json(_text) is not null"), F.lit(False)))
    df = df.withColumn("_type", F.get_json_object("_text", "$.event_type")).withColumn("_version", F.get_json_object("_text", "$.schema_version"))
    df = df.withColumn("event", F.when(F.col("_valid"), F.from_json("_text", EVENTS[event_type, version])))
    broken = bar_violations("event.", F.get_json_object("_text", "$.timestamp")) if event_type == "market.bar" else F.array().cast("array<string>")
    df = df.withColumn("_broken", broken)
    known = (F.col("_type") == event_type) & (F.col("_version") == str(version))
    reason = (
        F.when(F.col("_text").isNull() | (F.col("_text") == "") | ~F.col("_valid"), "deserialization")
        .when(F.col("_type").isNull() | F.col("_version").isNull(), "validation").when(~known, "unknown_event_type").when(F.size("_broken") > 0, "validation")
    )
    error = (
        F.when(F.col("_text").isNull() | (F.col("_text") == ""), "empty value").when(~F.col("_valid"), "not a JSON object")
        .when(F.col("_type").isNull() | F.col("_version").isNull(), "event_type or schema_version missing")
        .when(~known, F.concat(F.lit("unexpected event "), "_type", F.lit(" v"), "_version")).when(F.size("_broken") > 0, F.concat(F.lit("broken: "), F.array_join("_broken", ",")))
    )
    df = df.withColumn("reason", reason).withColumn("error", error)
    return df.withColumn("event", F.when(F.col("reason").isNull(), F.col("event"))).drop("_text", "_valid", "_type", "_version", "_broken")


def split(df: DataFrame, log_columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events, failures) of ``decoded`` rows."""
    return df.where("reason is null").select("event.*"), df.where("reason is not null").select(*log_columns, "reason", "error")


def dead_letters(failures: DataFrame, group: str, failed_at: Column, attempts: int = 1) -> DataFrame:
    """Failures with the original value in base 64, its coordinates, and the error cut to 2,000 characters."""
    key = F.expr("try_validate_utf8(decode(key, 'utf-8'))")
    error = F.when(F.length("error") > LONGEST_ERROR, F.concat(F.substring("error", 1, LONGEST_ERROR - 3), F.lit("..."))).otherwise(F.col("error"))
    return failures.select(
        F.col("topic").alias("original_topic"), F.col("partition").alias("original_partition"), F.col("offset").alias("original_offset"), key.alias("original_key"),
        F.translate(F.base64(F.coalesce("value", F.lit("").cast("binary"))), "\r\n", "").alias("original_value_b64"), "reason", error.alias("error_message"), F.lit(group).alias("consumer_group"),
        F.lit(attempts).alias("attempts"), failed_at.alias("failed_at"), F.coalesce(key, F.col("topic")).alias("routing_key"),
    )


def derived_id(source: Column, *parts: Column, namespace: str = ids.NAMESPACE_DNS) -> Column:
    """Id of an event that follows from another: the source's id first, then what it is; the same source gives the same id again."""
    return ids.uuid5(namespace, source, *parts)


def derived_ids(df: DataFrame, indicators: str, detector: Column, anomaly: Column, namespace: str = ids.NAMESPACE_DNS) -> DataFrame:
    """Ids of the enriched bar, and of an anomaly and its event, that follow from the bar ``event_id``."""
    make = lambda *parts: derived_id(F.col("event_id"), *parts, namespace=namespace)
    return df.withColumns({"enriched_id": make(F.lit("enriched"), F.lit(indicators)), "anomaly_event_id": make(F.lit("anomaly"), detector, anomaly), "anomaly_id": make(detector, anomaly)})


def prediction_id(source: Column, model: Column, version: Column, horizon: Column, namespace: str = ids.NAMESPACE_DNS) -> Column:
    return ids.uuid5(namespace, source, model, version, horizon)


def enriched(df: DataFrame, now: Column, indicators: str = "1", namespace: str = ids.NAMESPACE_DNS) -> DataFrame:
    """What an enriched event carries over from its bar: identity, trace and the latency since it was made, 0 at least."""
    latency = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("produced_at")) / 1000)
    return df.withColumn("source_event_id", F.col("event_id")).withColumn("event_id", derived_id(F.col("source_event_id"), F.lit("enriched"), F.lit(indicators), namespace=namespace)).withColumn("event_type", F.lit("market.bar.enriched")).withColumn("processing_latency_ms", latency)
