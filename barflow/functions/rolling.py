"""Rolling statistics over full frames, and recursive averages as prefix scans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: Rows of a block of the prefix scan.
BLOCK = 256


def full(aggregate: Callable[[Column], Column], x: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate of the last ``n`` rows, null until they hold n values."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, aggregate(x).over(frame))


def trailing(aggregate: Callable[[Column], Column], x: Column, w: WindowSpec, n: int, least: int) -> Column:
    """An aggregate of up to ``n`` rows before the current one, null with fewer than ``least`` values."""
    frame = w.rowsBetween(-n, -1)
    return F.when(F.count(x).over(frame) >= least, aggregate(x).over(frame))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def array_median(x: Column) -> Column:
    """Median of an array of numbers, null if it is empty."""
    s, n = F.sort_array(x), F.size(x)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def recursive(df: DataFrame, x: str, out: str, keys: list[str], order: str, decay: float, seed: int = 1, shown: int = 1) -> DataFrame:
    """Add y with y_t = decay * y_(t-1) + (1 - decay) * x_t, as window sums and no user-defined function.

    The first value is the mean of the first ``seed`` non-null x (nulls must come before all values); y shows from the
    ``shown``-th one. Values are numbered, cut into blocks, and summed within a block with powers of the decay; what earlier
    blocks leave over is carried in by two more windows: beyond two blocks it is below the precision of a double for decays
    up to 0.93. All windows share one partitioning by ``keys``.
    """
    if decay ** (2 * BLOCK) > 1e-16:
        raise ValueError("the decay is too slow for two blocks")
    w = Window.partitionBy(*keys).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    block = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    j = F.when(F.col(x).isNotNull(), F.count(x).over(run) - seed)
    df = df.withColumn("_j", F.when(j >= 0, j)).withColumn("_mean", F.avg(x).over(run) if seed > 1 else F.col(x))
    df = df.withColumn("_block", F.floor(F.col("_j") / BLOCK)).withColumn("_i", F.col("_j") % BLOCK)
    weighted = F.when(F.col("_j") == 0, F.col("_mean")).otherwise((1 - decay) * F.col(x))
    power = lambda e: F.pow(F.lit(decay), e)
    df = df.withColumn("_loc", F.when(F.col("_j").isNotNull(), power(F.col("_i")) * F.sum(F.when(F.col("_j").isNotNull(), weighted * power(-F.col("_i")))).over(block)))
    end = F.col("_i") == BLOCK - 1
    df = df.withColumn("_one", F.coalesce(F.last(F.when(end, F.col("_loc")), ignorenulls=True).over(past), F.lit(0.0)))
    df = df.withColumn("_two", F.coalesce(F.last(F.when(end, F.col("_loc") + power(F.lit(BLOCK)) * F.col("_one")), ignorenulls=True).over(past), F.lit(0.0)))
    y = F.col("_loc") + power(F.col("_i") + 1) * F.col("_two")
    return df.withColumn(out, F.when(F.col("_j") + seed >= shown, y)).drop("_j", "_mean", "_block", "_i", "_loc", "_one", "_two")


def ema(df: DataFrame, x: str, out: str, span: int, keys: list[str], order: str, shown: int | None = None) -> DataFrame:
    """Exponential average of the span, started from the first value and shown after ``span`` of them."""
    return recursive(df, x, out, keys, order, 1 - 2 / (span + 1), 1, span if shown is None else shown)


def wilder(df: DataFrame, x: str, out: str, period: int, keys: list[str], order: str) -> DataFrame:
    """Wilder's average: the mean of the first ``period`` values, then a decay of (period - 1) / period."""
    return recursive(df, x, out, keys, order, (period - 1) / period, period, period)
