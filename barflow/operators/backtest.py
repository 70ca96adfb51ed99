"""Cost-aware backtests over (symbol, session_date, score, y_return), long throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


def rebalances(df: DataFrame, horizon: int, keys: list[str] = []) -> DataFrame:
    """Rows of every offset's rebalance dates: each horizon-th distinct date, for offsets 0 to horizon - 1.

    The offset is a column, so that all of them run as one job: a date belongs to exactly one.
    """
    dates = df.select(*keys, "session_date").distinct().withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy("session_date")) - 1)
    dates = dates.withColumn("offset", F.col("_no") % horizon).withColumn("period", F.floor(F.col("_no") / horizon)).drop("_no")
    return df.join(dates, [*keys, "session_date"])


def weights(df: DataFrame, strategy: str, k: int = 3, keys: list[str] = []) -> DataFrame:
    """Rows with weight. buy_hold: equal; top_k: 1 / k for the k best; long_short: half the sum on either side, k at most half
    the names. Ties go by symbol; rows without a score have none, and dates without any hold cash."""
    date = Window.partitionBy(*keys, "session_date")
    n = F.count("score").over(date)
    rank = F.row_number().over(date.orderBy(F.col("score").isNull(), F.desc("score"), "symbol"))
    df = df.withColumn("_n", n).withColumn("_rank", rank)
    scored = F.col("score").isNotNull()
    if strategy == "buy_hold":
        w = F.when(scored, 1 / F.col("_n"))
    elif strategy == "top_k":
        used = F.least(F.lit(k), F.col("_n"))
        w = F.when(scored & (F.col("_rank") <= used), 1 / used)
    elif strategy == "long_short":
        used = F.least(F.lit(k), F.floor(F.col("_n") / 2))
        w = F.when(scored & (F.col("_rank") <= used), 0.5 / used).when(scored & (F.col("_rank") > F.col("_n") - used), -0.5 / used)
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return df.withColumn("weight", F.coalesce(w, F.lit(0.0))).drop("_n", "_rank")


def periods(df: DataFrame, cost_bps: float = 10.0, keys: list[str] = []) -> DataFrame:
    """(offset, session_date, gross, turnover, exposure, cost, net) of weighted rebalance rows.

    Turnover takes in symbols that leave: a position that is not renewed on the next date is closed there. Each position
    gives its own change and, if the symbol is absent on the next date, one closing row there: no grid of dates and symbols.
    """
    by_symbol = Window.partitionBy(*keys, "offset", "symbol").orderBy("period")
    ends = df.groupBy(*keys, "offset").agg(F.max("period").alias("_end"))
    df = df.join(F.broadcast(ends), [*keys, "offset"])
    prev_period, prev_weight, next_period = F.lag("period").over(by_symbol), F.lag("weight").over(by_symbol), F.lead("period").over(by_symbol)
    df = df.withColumn("_held", F.when(prev_period == F.col("period") - 1, prev_weight).otherwise(0.0)).withColumn("_leaves", (F.coalesce(next_period, F.lit(-1)) != F.col("period") + 1) & (F.col("period") < F.col("_end")))
    here = df.groupBy(*keys, "offset", "period").agg(
        F.min("session_date").alias("session_date"), F.coalesce(F.sum(F.when(F.col("y_return").isNotNull(), F.col("weight") * F.expm1("y_return"))), F.lit(0.0)).alias("gross"),
        F.sum(F.abs(F.col("weight") - F.col("_held"))).alias("_moved"), F.sum(F.abs("weight")).alias("exposure"),
    )
    left = df.where("_leaves").groupBy(*keys, "offset", (F.col("period") + 1).alias("period")).agg(F.sum(F.abs("weight")).alias("_closed"))
    out = here.join(left, [*keys, "offset", "period"], "left").withColumn("turnover", F.col("_moved") + F.coalesce("_closed", F.lit(0.0)))
    out = out.withColumn("cost", F.col("turnover") * cost_bps / 1e4).withColumn("net", F.col("gross") - F.col("cost"))
    return out.select(*keys, "offset", "period", "session_date", "gross", "turnover", "exposure", "cost", "net")


def _product(x: Column, over: Callable[[Column], Column]) -> Column:
    """The product of ``x``, of any sign, in sums: of logarithms, of signs and of zeros."""
    size = F.exp(F.coalesce(over(F.sum(F.when(x != 0, F.log(F.abs(x))))), F.lit(0.0)))
    sign = F.when(over(F.count_if(x < 0)) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(over(F.count_if(x == 0)) > 0, 0.0).otherwise(sign * size)


def summary(df: DataFrame, horizon: int, keys: list[str] = ["offset"], days: float = 252.0) -> DataFrame:
    """Growth, annualised return, volatility and cost, Sharpe ratio and t value, drawdown, hit rate and means per backtest; with
    fewer than two periods only their number. What is lost stays lost: growth is 0 after a period that loses all, and the
    annual return -1 without growth above 0."""
    w = Window.partitionBy(*keys).orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    kept = 1 + F.col("net")
    df = df.withColumn("_equity", _product(kept, lambda x: x.over(w)))
    df = df.withColumn("_down", F.col("_equity") / F.greatest(F.lit(1.0), F.max("_equity").over(w)) - 1)
    year = days / horizon
    a = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), _product(kept, lambda x: x).alias("growth"), F.avg("net").alias("_mean"), F.stddev_samp("net").alias("_sd"), F.min("_down").alias("max_drawdown"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.avg("turnover").alias("avg_turnover"), F.avg("exposure").alias("avg_exposure"), (F.avg("cost") * year).alias("annual_cost"), F.sum("cost").alias("total_cost"), F.avg("gross").alias("avg_gross"),
    )
    some, spread = F.col("n") >= 2, F.col("_sd") > 0
    out = {
        "years": F.col("n") / year, "growth": F.col("growth"), "annual_return": F.when(F.col("growth") > 0, F.pow(F.col("growth"), year / F.col("n")) - 1).otherwise(-1.0), "annual_volatility": F.col("_sd") * year**0.5,
        "sharpe": F.when(spread, F.col("_mean") / F.col("_sd") * year**0.5), "t_stat": F.when(spread, F.col("_mean") / F.col("_sd") * F.sqrt("n")),
        **{c: F.col(c) for c in ("max_drawdown", "hit_rate", "avg_turnover", "avg_exposure", "annual_cost", "total_cost", "avg_gross")},
    }
    return a.select(*keys, F.col("n").alias("periods"), *[F.when(some, v).alias(c) for c, v in out.items()])


def over_offsets(summaries: DataFrame, keys: list[str] = []) -> DataFrame:
    """Least, median and greatest Sharpe ratio and the median annual return over the offsets."""
    return summaries.groupBy(*keys).agg(F.min("sharpe").alias("sharpe_min"), F.percentile("sharpe", F.lit(0.5)).alias("sharpe_median"), F.max("sharpe").alias("sharpe_max"), F.percentile("annual_return", F.lit(0.5)).alias("annual_return_median"))


def grid(df: DataFrame, strategies: list[str], costs: list[float], horizon: int, k: int = 3, keys: list[str] = []) -> DataFrame:
    """Summaries for every strategy, cost and offset; costs share the periods of their strategy."""
    out = None
    base = rebalances(df, horizon, keys)
    for name in strategies:
        rows = periods(weights(base, name, k, keys), 0.0, keys).withColumn("strategy", F.lit(name)).withColumn("cost_bps", F.explode(F.array(*[F.lit(float(c)) for c in costs])))
        rows = rows.withColumn("cost", F.col("turnover") * F.col("cost_bps") / 1e4).withColumn("net", F.col("gross") - F.col("cost"))
        part = summary(rows, horizon, [*keys, "strategy", "cost_bps", "offset"])
        out = part if out is None else out.unionByName(part)
    return out
