"""Forward labels that never cross a gap, and splits that keep labels from leaking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barflow.operators.features import NAMES

HORIZON = 5


def with_labels(df: DataFrame, horizon: int = HORIZON, neutral: float = 0.0) -> DataFrame:
    """y_return (log return over the horizon; null past the end or across a gap), y_class, y_up and label_end."""
    w = Window.partitionBy("symbol").orderBy("ts")
    crossed = F.max((F.col("gap_before") > 0).cast("int")).over(w.rowsBetween(1, horizon)) == 1
    df = df.withColumn("y_return", F.when(~crossed, F.log(F.lead("close", horizon).over(w) / F.col("close"))))
    y = F.col("y_return")
    y_class = F.when(y > neutral, 1.0).when(y < -neutral, -1.0).when(y.isNotNull(), 0.0)
    df = df.withColumn("y_class", y_class).withColumn("y_up", F.when(F.col("y_class") == 1, 1.0).when(F.col("y_class") == -1, 0.0))
    return df.withColumn("label_end", F.lead("session_date", horizon).over(w))


def complete(df: DataFrame) -> DataFrame:
    """Rows with all features and a label."""
    return df.dropna(subset=[*NAMES, "y_return"])


def labelled(df: DataFrame) -> DataFrame:
    return df.where("y_up is not null")


def nth_session_after(df: DataFrame, boundary: Column, n: int) -> DataFrame:
    """One row: the n-th distinct session after the boundary, or the last one if there are fewer; null without any."""
    after = df.where(F.col("session_date") > boundary).select("session_date").distinct().orderBy("session_date").limit(n)
    return after.agg(F.max("session_date").alias("embargo_end"))


def purged(df: DataFrame, boundary: Column, embargo: int, end: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): train ends with labels at the boundary, test starts after ``embargo`` sessions and ends by ``end``."""
    train = df.where((F.col("session_date") <= boundary) & (F.col("label_end") <= boundary))
    test = df.crossJoin(F.broadcast(nth_session_after(df, boundary, embargo))).where((F.col("session_date") > boundary) & (F.col("embargo_end").isNull() | (F.col("session_date") > F.col("embargo_end")))).drop("embargo_end")
    if end is not None:
        test = test.where((F.col("session_date") <= end) & (F.col("label_end") <= end))
    return train, test


def chronological(df: DataFrame, train_end: Column, validation_end: Column, embargo: int = HORIZON) -> DataFrame:
    """Rows with split: train, validation or test, purged and embargoed at both boundaries."""
    train, _ = purged(df, train_end, embargo)
    _, validation = purged(df, train_end, embargo, validation_end)
    _, test = purged(df, validation_end, embargo)
    parts = [(train, "train"), (validation, "validation"), (test, "test")]
    out = None
    for part, name in parts:
        part = part.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def fold_bounds(df: DataFrame, embargo: int = HORIZON, years: list[int] | None = None) -> list:
    """(fold, boundary, end, embargo_end) of each year's fold: all ``years``, or every year of the data but the first.

    The sessions after a boundary are found by their number: distinct dates, and years in the driver, are what this holds.
    """
    days = df.select("session_date").where("session_date is not null").distinct()
    ranked = days.withColumn("_no", F.row_number().over(Window.orderBy("session_date")))
    yearly = days.groupBy(F.year("session_date").alias("fold")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("fold")
    before, total = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.sum("_n").over(Window.partitionBy())
    folds = yearly.select("fold", F.least(before + embargo, total).alias("_no"), before.alias("_before")).where("_before > 0").join(ranked, "_no")
    folds = folds.where(F.col("fold").isin(years)) if years is not None else folds
    return folds.select("fold", F.make_date(F.col("fold") - 1, F.lit(12), F.lit(31)).alias("boundary"), F.make_date("fold", F.lit(12), F.lit(31)).alias("end"), F.col("session_date").alias("embargo_end")).orderBy("fold").collect()


def walk_forward(df: DataFrame, years: list[int] | None = None, embargo: int = HORIZON) -> DataFrame:
    """Rows with fold and role: for each year, all purged rows before it to train and its own to test, in one pass."""
    roles = []
    for fold, boundary, end, after in fold_bounds(df, embargo, years):
        day, label = F.col("session_date"), F.col("label_end")
        role = lambda name: F.struct(F.lit(fold).alias("fold"), F.lit(name).alias("role"))  # noqa: B023, E731
        roles += [F.when((day <= F.lit(boundary)) & (label <= F.lit(boundary)), role("train")), F.when((day > F.lit(after)) & (day <= F.lit(end)) & (label <= F.lit(end)), role("test"))]
    if not roles:
        return df.limit(0).withColumn("fold", F.lit(0)).withColumn("role", F.lit(""))
    found = F.explode(F.filter(F.array(*roles), lambda x: x.isNotNull())).alias("_r")
    return df.select("*", found).select(*df.columns, "_r.fold", "_r.role")


def early_stopping(train: DataFrame, embargo: int = HORIZON) -> DataFrame:
    """Training rows with is_validation: the last year is held back, purged; rows in between are dropped."""
    last = train.agg(F.add_months(F.max("session_date"), -12).alias("cut"))
    df = train.crossJoin(F.broadcast(last))
    late = df.where("session_date > cut").select("session_date").distinct().orderBy("session_date").limit(embargo).agg(F.max("session_date").alias("embargo_end"))
    df = df.crossJoin(F.broadcast(late))
    fit = (F.col("session_date") <= F.col("cut")) & (F.col("label_end") <= F.col("cut"))
    hold = F.col("session_date") > F.col("embargo_end")
    return df.where(fit | hold).withColumn("is_validation", hold).drop("cut", "embargo_end")
