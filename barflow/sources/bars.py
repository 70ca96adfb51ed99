"""Bars derived from the given tables: one aggregation by symbol and time, which Spark takes in part before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def roll_up(df: DataFrame, symbol: Column, ts: Column, price: Column, volume: Column, order: list[str], interval: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, interval): first, highest, lowest and last price in ``order``."""
    key = F.struct(*order)
    rows = df.select(symbol.alias("symbol"), ts.cast("timestamp").alias("ts"), price.alias("_p"), volume.alias("_v"), key.alias("_k"))
    return rows.groupBy("symbol", "ts").agg(
        F.min_by("_p", "_k").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_k").alias("close"), F.sum("_v").cast("long").alias("volume")
    ).withColumn("interval", F.lit(interval))


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items by return flag."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return roll_up(df, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), order, "1d")


def part_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items by part: a panel whose symbols grow in number with the data."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    return roll_up(df, F.col("l_partkey").cast("string"), F.col("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), order, "1d")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders by priority."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return roll_up(df, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1), ["o_orderkey", "o_totalprice"], "1d")


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events by type."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return roll_up(df, F.col("event_type"), F.date_trunc("hour", F.col("ts")), F.col("value"), F.lit(1), ["ts", "event_id"], "1h")


_SQL = """{name} AS (
  SELECT {symbol} AS symbol, CAST({ts} AS TIMESTAMP) AS ts, first({price} ORDER BY {order}) AS open, max({price}) AS high,
         min({price}) AS low, last({price} ORDER BY {order}) AS close, CAST(sum({volume}) AS BIGINT) AS volume
  FROM {table} GROUP BY 1, 2)"""
LINE_SQL = _SQL.format(name="li", symbol="l_returnflag", ts="l_shipdate", price="l_extendedprice", volume="l_quantity", table="lineitem", order="l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice")
PART_SQL = _SQL.format(name="pa", symbol="CAST(l_partkey AS VARCHAR)", ts="l_shipdate", price="l_extendedprice", volume="l_quantity", table="lineitem", order="l_orderkey, l_linenumber, l_suppkey, l_extendedprice")
ORDER_SQL = _SQL.format(name="od", symbol="o_orderpriority", ts="o_orderdate", price="o_totalprice", volume="1", table="orders", order="o_orderkey, o_totalprice")
EVENT_SQL = _SQL.format(name="ev", symbol="event_type", ts="date_trunc('hour', ts)", price="value", volume="1", table="events", order="ts, event_id")
