"""Exact ranks of values within keys, by a prefix count over ranges: no task holds all values of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.sources.session import checkpointed, few


def ranked(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells(keys, value, c)``, each value of a key once, with ``upto``, the number of the key's values up to it, and ``n``, of all. Other
    columns stay. Of equal values each counts those before it.

    Values are dealt out in ranges and sorted there. A task counts within its range; what the ranges before it hold of a key is added
    from a table of one row a key and range. So a key of any size is as many tasks as it has ranges.
    """
    rows = cells.withColumn("_key", F.xxhash64(*keys))
    rows = checkpointed(rows.repartitionByRange(*keys, "value").sortWithinPartitions(*keys, "value").withColumn("_part", F.spark_partition_id()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, c = (batch.column(x).to_numpy() for x in ("_key", "c"))
            total = np.cumsum(c)
            first = np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]]))
            before = np.zeros(len(key), np.int64)
            before[first] = np.diff(np.concatenate([[0], (total - c)[first]]))
            upto = total - np.cumsum(before) + np.where(np.cumsum(np.isin(np.arange(len(key)), first)) == 0, carried, 0)
            last, carried = key[-1], upto[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto)], [*batch.schema.names, "upto"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", upto bigint"
    totals = rows.groupBy(*keys, "_key", "_part").agg(F.sum("c").alias("_here"))
    by_key = Window.partitionBy(*keys)
    ahead = F.sum("_here").over(by_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    totals = checkpointed(totals.select("_key", "_part", F.coalesce(ahead, F.lit(0)).alias("_ahead"), F.sum("_here").over(by_key).alias("n")))
    # a row for each key of a range: as many as ranges and keys
    return rows.mapInArrow(run, schema).join(few(totals), ["_key", "_part"]).select(*cells.columns, (F.col("upto") + F.col("_ahead")).alias("upto"), "n")


def quantiles(ranks: DataFrame, keys: list[str], parts: int = 100) -> DataFrame:
    """(keys, quantiles, n): the ``parts`` + 1 quantiles of each key of ``ranked`` values, interpolated between neighbours.

    The k-th quantile lies at place k * (n - 1) / parts, counted from 0. A value stands for the places [upto - c, upto), so that which
    quantiles touch it follows by arithmetic; few values are touched and only these are gathered.
    """
    last, n = F.greatest(F.col("n") - 1, F.lit(1)), F.col("n")
    up = lambda x: F.ceil(x * parts / last)

    def bounds(shift: int) -> tuple[Column, Column]:
        """The first and last k whose lower place, plus ``shift``, is one of the value's."""
        low, high = up(F.col("upto") - F.col("c") - shift), F.least(up(F.col("upto") - shift) - 1, F.lit(parts))
        return F.greatest(low, F.lit(0)).cast("int"), F.when(n == 1, parts).otherwise(high).cast("int")

    def touched(shift: int) -> Column:
        low, high = bounds(shift)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    some = [low <= high for low, high in map(bounds, (0, 1))]  # arithmetic alone, for all values; lists only for the few that are touched
    found = ranks.where(some[0] | some[1]).withColumn("_low", touched(0)).withColumn("_high", touched(1))
    ends = found.select(*keys, "n", "value", F.explode(F.concat(F.transform("_low", lambda k: F.struct(k.alias("k"), F.lit(0).alias("side"))), F.transform("_high", lambda k: F.struct(k.alias("k"), F.lit(1).alias("side"))))).alias("e"))
    each = ends.groupBy(*keys, "n", F.col("e.k").alias("k")).agg(F.max(F.when(F.col("e.side") == 0, F.col("value"))).alias("lo"), F.max(F.when(F.col("e.side") == 1, F.col("value"))).alias("hi"))
    place = F.col("k") * (n - 1)
    share = (place % parts) / parts
    value = F.when((share == 0) | F.col("hi").isNull(), F.col("lo")).otherwise(F.col("lo") + share * (F.col("hi") - F.col("lo")))
    each = each.where("lo is not null").select(*keys, "n", "k", value.alias("q"))
    return each.groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("k", "q"))).alias("_q")).select(*keys, F.col("_q.q").alias("quantiles"), "n")


def bisected(df: DataFrame, name: str, ascending: str, value: str, most: int = 127, equal: bool = False) -> DataFrame:
    """``df`` with ``name``: how many of up to ``most`` numbers of an array in ascending order lie below ``value``, or at it if ``equal``. The steps
    of a bisection as columns, since a filter of the array looks at every number."""
    df, step = df.withColumn(name, F.lit(0)), 1 << (most.bit_length() - 1)
    while step:
        x = F.get(ascending, F.col(name) + (step - 1))
        df = df.withColumn(name, F.col(name) + F.when(x <= F.col(value) if equal else x < F.col(value), step).otherwise(0))
        step //= 2
    return df
