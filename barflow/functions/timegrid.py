"""Bar intervals, grids and calendar arithmetic. The session zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Seconds of a bar of each interval.
SECONDS = {"1s": 1, "1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "1d": 86400}
EXCHANGE_ZONE = "America/New_York"


def duration(interval: Column | str) -> Column:
    """Seconds of an interval; null for an unknown one."""
    name = F.lit(interval) if isinstance(interval, str) else interval
    table = F.create_map(*[F.lit(x) for pair in SECONDS.items() for x in pair])
    return F.try_element_at(table, name).cast("long")


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * 1_000_000)


def bar_end(ts: Column, interval: Column) -> Column:
    """A bar covers [ts, ts + interval)."""
    return plus_seconds(ts, duration(interval))


def grid_start(now: Column, interval: Column, back: int = 0) -> Column:
    """``now`` floored to the interval's grid, ``back`` bars earlier."""
    d = duration(interval)
    return F.timestamp_seconds(F.floor(F.unix_timestamp(now) / d) * d - d * back)


def session_date(ts: Column, zone: str = EXCHANGE_ZONE) -> Column:
    """The exchange's local date of an instant."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def missing_bars(before: Column, ts: Column, seconds: Column) -> Column:
    """Bars missing between two: the half-even rounded distance in bars, less one, at least 0."""
    return F.greatest(F.lit(0), (F.bround((F.unix_micros(ts) - F.unix_micros(before)) / (seconds * 1e6), 0) - 1).cast("int"))


def weekdays_between(a: Column, b: Column) -> Column:
    """Mondays to Fridays in [a, b), in closed form."""
    upto = lambda d: F.floor(F.datediff(d, F.lit("1969-12-29").cast("date")) / 7) * 5 + F.least(F.weekday(d), F.lit(5))
    return (upto(b) - upto(a)).cast("int")


def add_business_days(ts: Column, n: int) -> Column:
    """``ts`` moved by n business days; a start on a weekend first rolls to the next Monday."""
    day = F.weekday(ts)
    rolled = F.when(day >= 5, 7 - day).otherwise(F.lit(0))
    start = F.when(day >= 5, F.lit(0)).otherwise(day)
    days = rolled + n + 2 * F.floor((start + n) / 5)
    return plus_seconds(ts, days.cast("long") * 86400)
