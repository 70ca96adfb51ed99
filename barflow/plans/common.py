"""Helpers that queries and their SQL share: both sides round alike, so that equal results are equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rd(x: Column | str, n: int, name: str | None = None) -> Column:
    """Rounded, without a negative zero."""
    c = F.col(x) if isinstance(x, str) else x
    return (F.round(c.cast("double"), n) + 0.0).alias(name or (x if isinstance(x, str) else "value"))


def sq(x: str, n: int, name: str | None = None) -> str:
    """The same in SQL."""
    return f"round(CAST({x} AS DOUBLE), {n}) + CAST(0 AS DOUBLE) AS {name or x}"


def sqs(columns: dict[str, int]) -> str:
    return ", ".join(sq(c, n) for c, n in columns.items())


def day(c: str = "ts", name: str = "day") -> Column:
    return F.to_date(c).alias(name)


def stamp(c: Column | str, name: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


def sql_stamp(c: str, name: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name}"
