"""Metrics of up/down and return predictions, exact and in single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def classification(df: DataFrame, y: str, predicted: str, keys: list[str] = [], horizon: int = 1) -> DataFrame:
    """Confusion counts, accuracy with its interval, balanced accuracy, precision, recall and F1; a ratio of nothing is 0.

    The interval counts n / horizon observations, at least 1, since labels that far apart don't overlap.
    """
    case = lambda a, b: F.count_if((F.col(y) == a) & (F.col(predicted) == b))
    df = df.groupBy(*keys).agg(case(1, 1).alias("tp"), case(0, 1).alias("fp"), case(1, 0).alias("fn"), case(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    f1 = lambda hit, extra, lost: _ratio(2 * hit, 2 * hit + extra + lost)
    df = df.withColumns({
        "n": n, "accuracy": (tp + tn) / n, "balanced_accuracy": (_ratio(tp, tp + fn) + _ratio(tn, tn + fp)) / 2, "precision_up": _ratio(tp, tp + fp),
        "recall_up": _ratio(tp, tp + fn), "f1_up": f1(tp, fp, fn), "f1_macro": (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2, "base_rate": F.greatest(tp + fn, tn + fp) / n,
    })
    half = 1.96 * F.sqrt(F.col("accuracy") * (1 - F.col("accuracy")) / F.greatest(F.lit(1.0), F.col("n") / horizon))
    return df.withColumns({"edge": F.col("accuracy") - F.col("base_rate"), "ci_low": F.greatest(F.lit(0.0), F.col("accuracy") - half), "ci_high": F.least(F.lit(1.0), F.col("accuracy") + half)})


def roc_auc(df: DataFrame, y: str, score: str, keys: list[str] = []) -> DataFrame:
    """Area under the ROC curve by ranks, ties counted half; null if a class is missing.

    Ranks come from counts per distinct score: tied scores are one row, so a constant score doesn't sort all rows.
    """
    cells = df.groupBy(*keys, score).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    w = Window.partitionBy(*keys).orderBy(score)
    below = F.coalesce(F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cells.withColumn("_below", below).groupBy(*keys).agg(F.sum(F.col("p") * (F.col("_below") + F.col("q") / 2)).alias("a"), F.sum("p").alias("n1"), F.sum("q").alias("n0"))
    return sums.select(*keys, F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("a") / (F.col("n1") * F.col("n0"))).alias("roc_auc"))


def log_loss(y: Column, p: Column, clip: float = 1e-6) -> Column:
    """Mean log loss of probabilities cut to [clip, 1 - clip]; an aggregate."""
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def regression(df: DataFrame, y: str, predicted: str, keys: list[str] = []) -> DataFrame:
    """n, MAE, RMSE, R squared, and the share of equal signs among pairs without a zero."""
    e = F.col(predicted) - F.col(y)
    pair = (F.col(predicted) != 0) & (F.col(y) != 0)
    df = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.when(pair, (F.signum(predicted) == F.signum(y)).cast("double"))).alias("directional_accuracy"),
    )
    return df


def mean_and_spread(df: DataFrame, metrics: list[str], keys: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over folds; NaN counts as absent."""
    aggs = []
    for m in metrics:
        x = F.nullif(F.nanvl(F.col(m).cast("double"), F.lit(float("inf"))), F.lit(float("inf")))
        aggs += [F.avg(x).alias(f"{m}_mean"), F.stddev_pop(x).alias(f"{m}_sd")]
    return df.groupBy(*keys).agg(*aggs)
