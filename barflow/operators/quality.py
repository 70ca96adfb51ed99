"""Data quality of raw daily bars: seven error rules, five warnings, a consensus calendar, cleaning and reports.

Rows come as strings (symbol, row, raw_timestamp, raw_open, raw_high, raw_low, raw_close, raw_volume) so that bad values
reach the rules. Errors drop a row; warnings flag it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barflow.functions import rolling as R, timegrid as G
from barflow.functions.sliding import Sorted
from barflow.sources.session import checkpointed

#: Fixed codes and names, errors first.
RULES = {
    "E001": "missing_value", "E002": "malformed_timestamp", "E003": "non_positive_price", "E004": "negative_volume", "E005": "ohlc_inconsistent",
    "E006": "conflicting_duplicate", "E007": "exact_duplicate", "W101": "extreme_move", "W103": "missing_sessions", "W102": "zero_volume",
    "W104": "irregular_time", "W105": "stale_price",
}
ERRORS = [c for c in RULES if c[0] == "E"]
PRICES = ["open", "high", "low", "close"]
FIRST_SECOND = 631_152_000  # 1990-01-01
Z_WINDOW, Z_LEAST, EXTREME, MARKET_Z, MARKET_SHARE = 252, 60, 6.0, 3.0, 0.5
VOLUME_WINDOW, VOLUME_LEAST, VOLUME_TIMES, REVERSAL, STALE = 50, 20, 2.0, 0.8, 5


def _codes(**tests: Column) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(code)) for code, t in tests.items()]), lambda x: x.isNotNull())


def typed(raw: DataFrame) -> DataFrame:
    """The values as numbers and the time as an instant, null where they can't be read or aren't finite."""
    number = lambda c: F.nullif(F.nanvl(F.expr(f"try_cast(trim({c}) AS double)"), F.lit(float("inf"))), F.lit(float("inf")))
    finite = lambda c: F.when(F.abs(number(c)) < float("inf"), number(c))
    df = raw.withColumns({c: finite(f"raw_{c}") for c in (*PRICES, "volume")})
    return df.withColumn("_s", F.expr("try_cast(trim(raw_timestamp) AS double)"))


def errors(raw: DataFrame, now: Column) -> DataFrame:
    """Typed rows with ts, session_date and the error codes that hold of them.

    Values and times are judged alone first. Among rows without a finding, copies of one symbol and time that differ in
    any value are all conflicting; of equal copies all but the first by row are exact duplicates.
    """
    df = typed(raw)
    o, h, low, c, v = (F.col(x) for x in (*PRICES, "volume"))
    bad_time = F.col("_s").isNull() | F.isnan("_s") | (F.col("_s") < FIRST_SECOND) | (F.col("_s") > F.unix_timestamp(now) + 86_400)
    own = _codes(
        E001=o.isNull() | h.isNull() | low.isNull() | c.isNull() | v.isNull(), E002=bad_time,
        E003=(o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), E004=v < 0, E005=(h < F.greatest(o, c, low)) | (low > F.least(o, c)),
    )
    df = df.withColumn("_own", own).withColumn("ts", F.when(~bad_time, F.timestamp_micros((F.col("_s") * 1_000_000).cast("long"))))
    good = F.size("_own") == 0
    same = Window.partitionBy("symbol", F.when(good, F.col("ts")), good)
    differs = F.lit(False)
    for x in (*PRICES, "volume"):
        differs = differs | (F.min(x).over(same) != F.max(x).over(same))
    nth = F.row_number().over(same.orderBy("row"))
    df = df.withColumn("_conflict", good & differs).withColumn("_copy", good & ~differs & (nth > 1))
    df = df.withColumn("errors", F.concat("_own", _codes(E006=F.col("_conflict"), E007=F.col("_copy"))))
    return df.withColumn("session_date", G.session_date(F.col("ts"))).drop("_own", "_conflict", "_copy", "_s")


def calendar(rows: DataFrame) -> DataFrame:
    """(session_date, present, listed): dates on which half of the symbols listed at the time, or more, have a row.

    A symbol is listed from its first to its last date. The count of listed symbols is a running sum of starts and ends
    over the dates: no range join.
    """
    have = rows.groupBy("session_date", "symbol").agg(F.count(F.lit(1)))
    spans = have.groupBy("symbol").agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    steps = spans.select(F.col("a").alias("d"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(spans.select(F.col("b").alias("d"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    steps = steps.groupBy("d").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    days = have.groupBy("session_date").agg(F.count(F.lit(1)).alias("present")).join(steps, F.col("session_date") == F.col("d"), "left").na.fill(0, ["up", "down"])
    w = Window.orderBy("session_date")
    listed = F.sum("up").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.sum("down").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return days.withColumn("listed", listed).where("present >= 0.5 * listed").select("session_date", "present", "listed")


def robust_z(rows: DataFrame, window: int = Z_WINDOW, least: int = Z_LEAST) -> DataFrame:
    """log_return, and z against the median and the deviation from it of the returns before; null without spread.

    A task walks its symbols in order with one sorted window, so it holds ``window`` numbers whatever a symbol's length. Of a symbol that one
    task should not walk alone, ``functions.blocks.in_blocks`` makes many, with ``window`` + 1 rows before each block.
    """
    ordered = rows.repartition("symbol").sortWithinPartitions("symbol", "ts", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, prev, past = object(), None, Sorted(window)
        for batch in batches:
            logs, zs = [], []
            for symbol, close in zip(batch.column("symbol").to_pylist(), batch.column("close").to_pylist()):
                if symbol != now:
                    now, prev, past = symbol, None, Sorted(window)
                r = log(close / prev) if close and prev and close / prev > 0 else None
                z = None
                if r is not None and len(past.values) >= least:
                    m = past.median()
                    spread = past.deviation(m)
                    z = (r - m) / (1.4826 * spread) if spread > 0 else None
                past.push(r)
                prev = close
                logs.append(r)
                zs.append(z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64()), pa.array(zs, pa.float64())], [*batch.schema.names, "log_return", "z"])

    schema = StructType([*rows.schema.fields, StructField("log_return", DoubleType()), StructField("z", DoubleType())])
    return ordered.mapInArrow(run, schema)


def warnings(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Usable rows with their warnings, the class of extreme moves, and the sessions missing before each."""
    w = Window.partitionBy("symbol").orderBy("ts", "row")
    df = robust_z(rows)
    base = R.trailing(R.median, F.col("volume"), w, VOLUME_WINDOW, VOLUME_LEAST)
    nxt = F.lead("log_return").over(w)
    df = df.withColumns({
        "extreme": F.coalesce(F.abs("z") >= EXTREME, F.lit(False)), "volume_confirmed": F.coalesce(F.col("volume") >= VOLUME_TIMES * base, F.lit(False)),
        "reverses": F.coalesce((F.signum(nxt) == -F.signum("log_return")) & (F.abs(nxt) >= REVERSAL * F.abs("log_return")), F.lit(False)),
        "_local": F.from_utc_timestamp("ts", G.EXCHANGE_ZONE), "_new": F.coalesce((F.col("close") != F.lag("close").over(w)).cast("int"), F.lit(1)),
    })
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("stale", F.count(F.lit(1)).over(Window.partitionBy("symbol", "_run")) >= STALE)
    days = sessions.select("session_date", F.row_number().over(Window.orderBy("session_date")).alias("_ord"))
    # the number of sessions up to a date, also for dates that are none themselves
    every = df.select("session_date").distinct().join(days, "session_date", "full")
    upto = every.withColumn("_upto", F.max("_ord").over(Window.orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0))).select("session_date", F.coalesce("_upto", F.lit(0)).alias("_upto"), F.col("_ord").isNotNull().cast("int").alias("_is"))
    df = df.join(upto, "session_date")
    missing = F.col("_upto") - F.col("_is") - F.lag("_upto").over(w)
    df = df.withColumn("missing_sessions_before", F.greatest(F.coalesce(missing, F.lit(0)), F.lit(0)))
    share = F.avg(F.when(F.abs("z") >= MARKET_Z, 1.0).otherwise(0.0)).over(Window.partitionBy("session_date"))
    df = df.withColumn("market_wide", share >= MARKET_SHARE)
    kind = F.when(F.col("market_wide"), "market_wide").when(F.col("volume_confirmed"), "volume_confirmed").when(F.col("reverses"), "suspect_reversal").otherwise("idiosyncratic")
    df = df.withColumn("extreme_class", F.when(F.col("extreme"), kind))
    irregular = (F.hour("_local") != 9) | (F.minute("_local") != 30)
    df = df.withColumn("irregular", irregular)
    codes = _codes(W101=F.col("extreme"), W103=F.col("missing_sessions_before") > 0, W102=F.col("volume") == 0, W104=F.col("irregular"), W105=F.col("stale"))
    return df.withColumn("warnings", codes).drop("_local", "_new", "_run", "_upto", "_is")


def validated(raw: DataFrame, now: Column) -> DataFrame:
    """Every raw row with ``issues``: its errors, or for a usable row its warnings, in the fixed order of the codes."""
    df = checkpointed(errors(raw, now))  # read by the calendar, the warnings and the bad rows
    usable = df.where(F.size("errors") == 0)
    found = warnings(usable, calendar(usable))
    extra = ["log_return", "z", "extreme", "volume_confirmed", "reverses", "stale", "missing_sessions_before", "market_wide", "extreme_class", "irregular"]
    bad = df.where(F.size("errors") > 0).select("*", *[F.lit(None).cast(dict(found.dtypes)[c]).alias(c) for c in extra], F.array().cast("array<string>").alias("warnings"))
    return found.select(bad.columns).unionByName(bad).withColumn("issues", F.concat("errors", "warnings"))


def rule_counts(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", F.explode("issues").alias("code")).groupBy("symbol", "code").agg(F.count(F.lit(1)).alias("n"))


def gaps(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """(symbol, session_date): calendar sessions within a symbol's span on which it has no row.

    The ends of spans are numbered along the calendar's running count, so that a span is a range of numbers: no range join.
    """
    have = rows.select("symbol", "session_date").distinct()
    spans = have.groupBy("symbol").agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    days = sessions.select("session_date", F.row_number().over(Window.orderBy("session_date")).alias("_no"))
    ends = spans.select(F.col("a").alias("session_date")).unionByName(spans.select(F.col("b").alias("session_date"))).distinct()
    upto = F.coalesce(F.max("_no").over(Window.orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    ends = ends.join(days, "session_date", "full").select("session_date", upto.alias("_upto"), F.col("_no").isNotNull().cast("int").alias("_is"))
    first = ends.select(F.col("session_date").alias("a"), (F.col("_upto") - F.col("_is") + 1).alias("_low"))
    spans = spans.join(first, "a").join(ends.select(F.col("session_date").alias("b"), F.col("_upto").alias("_high")), "b")
    due = spans.where("_low <= _high").select("symbol", F.explode(F.sequence("_low", "_high")).alias("_no")).join(days, "_no").select("symbol", "session_date")
    return due.join(have, ["symbol", "session_date"], "left_anti")


def clean(rows: DataFrame, drop_suspects: bool = False) -> DataFrame:
    """Rows without errors, typed, warnings as columns; optionally without suspected bad prints."""
    df = rows.where(F.size("errors") == 0)
    if drop_suspects:
        df = df.where("extreme_class is distinct from 'suspect_reversal'")
    flag = lambda code: F.array_contains("warnings", code)
    return df.select("symbol", "session_date", F.col("ts").alias("timestamp"), *PRICES, F.col("volume").cast("long").alias("volume"), "extreme_class", flag("W102").alias("flag_zero_volume"), flag("W105").alias("flag_stale_price"), flag("W104").alias("flag_irregular_time"), F.col("missing_sessions_before").cast("int").alias("missing_sessions_before"))


def removed(rows: DataFrame) -> DataFrame:
    """The audit log of what ``clean`` drops: codes, their names, and the raw time and close."""
    names = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    why = F.array_join(F.transform("errors", lambda c: names[c]), "; ")
    return rows.where(F.size("errors") > 0).select("symbol", "row", F.array_join("errors", ",").alias("codes"), why.alias("reasons"), "raw_timestamp", "raw_close")


def report(rows: DataFrame) -> DataFrame:
    """Per symbol, and with a null symbol in total: rows, kept, removed, span, and the number of each warning and class."""
    has = lambda code: F.count_if(F.array_contains("issues", code))
    kept = F.size("errors") == 0
    return rows.rollup("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("removed"), F.min(F.when(kept, F.col("session_date"))).alias("first_session"), F.max(F.when(kept, F.col("session_date"))).alias("last_session"),
        has("W101").alias("extreme_moves"), has("W102").alias("zero_volume"), has("W104").alias("irregular_time"), has("W105").alias("stale_price"), F.coalesce(F.sum("missing_sessions_before"), F.lit(0)).alias("missing_sessions"),
        F.count_if(F.col("extreme_class") == "market_wide").alias("market_wide"), F.count_if(F.col("extreme_class") == "volume_confirmed").alias("volume_confirmed"), F.count_if(F.col("extreme_class") == "suspect_reversal").alias("suspect_reversal"), F.count_if(F.col("extreme_class") == "idiosyncratic").alias("idiosyncratic"),
    )
