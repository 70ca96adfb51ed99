"""Baselines, fitted models, scoring and the rules of promotion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from barflow.functions import timegrid as G
from barflow.operators import backtest as B, contract, dataset as D, evaluation as E, features as X

#: A model: fitted on training rows, it adds ``score`` to others.
Fit = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


def majority(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """P(up) = the share of up labels, for every row."""
    p = train.agg(F.avg("y_up").alias("score"))
    return lambda df: df.crossJoin(F.broadcast(p))


def train_mean(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
    m = train.agg(F.avg("y_return").alias("score"))
    return lambda df: df.crossJoin(F.broadcast(m))


def zero(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn("score", F.lit(0.0))


def momentum(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Score = the last five bars' return; up if above 0."""
    return lambda df: df.withColumn("score", F.col("ret_5"))


def random_control(seed: int = 7) -> Fit:
    """A uniform score from the row's symbol and date: the same on every run and partitioning."""
    return lambda train: lambda df: df.withColumn("score", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "symbol", "session_date"), 11) / F.lit(float(1 << 53)))


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline that scores rows."""

    model: PipelineModel
    score: Callable[[PipelineModel, DataFrame], DataFrame]

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.score(self.model, df)


def _vectors(features: list[str]) -> list:
    return [VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="error"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True)]


def logistic(features: list[str], c: float = 0.1) -> Fit:
    """Logistic regression on features scaled by their population deviation, with an L2 penalty of 1 / (c * n)."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        rows = train.where("y_up is not null")
        n = max(rows.count(), 1)
        model = Pipeline(stages=[*_vectors(features), LogisticRegression(featuresCol="_x", labelCol="y_up", regParam=_population(n) / (c * n), elasticNetParam=0.0, standardization=False, probabilityCol="_p", rawPredictionCol="_z", predictionCol="_y")]).fit(rows)
        return Fitted(model, _score)

    return fit


def _population(n: int) -> float:
    """The share of a penalty on weights of features scaled by the sample's deviation, as the scaler does, that equals one by the population's."""
    return (n - 1) / n if n > 1 else 1.0


def ridge(features: list[str], alpha: float = 10.0) -> Fit:
    """Least squares on features scaled by their population deviation, with a penalty of alpha. The solver scales the labels by their deviation
    and divides the penalty by it, so it is given the penalty times that."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        rows = train.where("y_return is not null")
        n, spread = rows.agg(F.count(F.lit(1)), F.coalesce(F.stddev_pop("y_return"), F.lit(0.0))).first()
        model = Pipeline(stages=[*_vectors(features), LinearRegression(featuresCol="_x", labelCol="y_return", regParam=alpha * _population(max(n, 1)) * spread / max(n, 1), elasticNetParam=0.0, standardization=False, solver="normal", predictionCol="score")]).fit(rows)
        return Fitted(model, lambda m, df: m.transform(df).drop("_raw", "_x"))

    return fit


def boosted(features: list[str], seed: int = 7, depth: int = 3, rounds: int = 20, step: float = 0.1, least: int = 20) -> Fit:
    """Gradient-boosted trees with log loss; the last year of the training rows, purged, stops them early."""

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        rows = D.early_stopping(train.where("y_up is not null"))
        trees = GBTClassifier(featuresCol="_raw", labelCol="y_up", maxDepth=depth, maxIter=rounds, stepSize=step, minInstancesPerNode=least, subsamplingRate=0.8, seed=seed, validationIndicatorCol="is_validation", validationTol=1e-4)
        trees.setProbabilityCol("_p").setRawPredictionCol("_z").setPredictionCol("_y")
        model = Pipeline(stages=[_vectors(features)[0], trees]).fit(rows)
        return Fitted(model, _score)

    return fit


def _score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("_p")[1]).drop("_raw", "_x", "_p", "_z", "_y")


def coefficients(fitted: Fitted, features: list[str], top: int = 10) -> list[tuple[str, float]]:
    """The largest weights of a linear model, or shares of gain of a tree ensemble: one number a feature."""
    if hasattr(fitted, "gain"):
        return sorted(((c, fitted.gain[c]) for c in features), key=lambda x: (-x[1], x[0]))[:top]
    last = fitted.model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return sorted(zip(features, map(float, values.toArray())), key=lambda x: (-abs(x[1]), x[0]))[:top]


def fit_and_score(fit: Fit, train: DataFrame, test: DataFrame) -> DataFrame:
    """Scored, labelled test rows of a model fitted on labelled training rows."""
    return fit(D.labelled(train))(D.labelled(test)).select("symbol", "session_date", "y_up", "y_return", "score")


METRICS = ["n", "accuracy", "balanced_accuracy", "precision_up", "recall_up", "f1_macro", "base_rate", "edge", "roc_auc"]


def metrics(scored: DataFrame, keys: list[str], probability: bool = True) -> DataFrame:
    """(keys, metric, value): classification metrics at 0.5 (0 for a score that is no probability), AUC and log loss, of all keys
    in one aggregation each."""
    cut = F.col("score") >= 0.5 if probability else F.col("score") > 0
    df = scored.withColumn("_c", cut.cast("int"))
    one, names = E.classification(df, "y_up", "_c", keys).join(E.roc_auc(df, "y_up", "score", keys), keys), list(METRICS)
    if probability:
        one = one.join(df.groupBy(*keys).agg(E.log_loss(F.col("y_up"), F.col("score")).alias("log_loss")), keys)
        names.append("log_loss")
    return one.select(*keys, F.explode(F.create_map(*[x for m in names for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"))


def evaluated(scored: DataFrame, name: str, probability: bool = True) -> DataFrame:
    """(model, metric, value) of one model's scores."""
    return metrics(scored.withColumn("model", F.lit(name)), ["model"], probability)


def predicted(sets: list[tuple[object, DataFrame, DataFrame]], models: dict[str, Fit]) -> DataFrame:
    """(model, fold, symbol, session_date, y_up, y_return, score): every model fitted on every fold's training rows, and what it says
    of the fold's test rows."""
    out = None
    for fold, train, test in sets:
        for name, fit in models.items():
            part = fit_and_score(fit, train, test).select(F.lit(name).alias("model"), F.lit(fold).alias("fold"), "*")
            out = part if out is None else out.unionByName(part)
    return out


def fold_sets(df: DataFrame, years: list[int] | None = None, embargo: int = D.HORIZON) -> list[tuple[int, DataFrame, DataFrame]]:
    """(year, train, test) of each walk-forward fold."""
    day, label, out = F.col("session_date"), F.col("label_end"), []
    for fold, boundary, end, after in D.fold_bounds(df, embargo, years):
        boundary, end, after = (F.lit(x) for x in (boundary, end, after))
        out.append((fold, df.where((day <= boundary) & (label <= boundary)), df.where((day > after) & (day <= end) & (label <= end))))
    return out


def development(df: DataFrame, models: dict[str, Fit], years: list[int], embargo: int = D.HORIZON) -> DataFrame:
    """(model, fold, metric, value) of every model on every walk-forward year."""
    return metrics(predicted(fold_sets(df, years, embargo), models), ["model", "fold"])


def development_run(df: DataFrame, models: dict[str, Fit], train_end: Column, validation_end: Column, strategies: list[str], costs: list[float], horizon: int = D.HORIZON, years: list[int] | None = None, null_model: str = "majority") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, candidates, backtests) of the rows up to ``validation_end``.

    report: (section, model, fold, metric, value) of a validation after ``train_end`` and of the walk-forward folds. candidates:
    the models by mean log loss over the folds, with whether they beat the null model. backtests: of the out-of-sample
    predictions of all folds on end, by model, strategy, cost and offset. Rows after ``validation_end`` are not looked at.
    """
    train, validation = D.purged(df, train_end, horizon, validation_end)
    own, _ = D.purged(df, validation_end, horizon)
    oos = predicted(fold_sets(own, years, horizon), models)
    walk = metrics(oos, ["model", "fold"])
    held = metrics(predicted([(0, train, validation)], models), ["model"]).withColumn("fold", F.lit(None).cast("int"))
    report = walk.withColumn("section", F.lit("walk_forward")).unionByName(held.withColumn("section", F.lit("validation")))
    return report.select("section", "model", "fold", "metric", "value"), ranked(walk, null_model), B.grid(oos, strategies, costs, horizon, keys=["model"])


def held_out_test(df: DataFrame, models: dict[str, Fit], development_end: Column, strategies: list[str], costs: list[float], horizon: int = D.HORIZON) -> tuple[DataFrame, DataFrame]:
    """(metrics, backtests) of models that are fitted once more on all development rows and judged once on what comes after."""
    train, test = D.purged(df, development_end, horizon)
    scored = predicted([(0, train, test)], models)
    return metrics(scored, ["model"]), B.grid(scored, strategies, costs, horizon, keys=["model"])


def recent_years(df: DataFrame, years: int) -> list[int]:
    """The last ``years`` full years of the labels."""
    last = df.agg(F.year(F.max("label_end"))).first()[0]
    return [] if last is None else list(range(last - years, last))


def recent_evaluation(df: DataFrame, fit: Fit, years: int = 3, embargo: int = D.HORIZON) -> DataFrame:
    """(model, fold, role, metric, value): the model and the majority on the last full years; the last one's role is test, that of
    those before it wf."""
    found = recent_years(df, years)
    rows = development(df, {"model": fit, "null": majority}, found, embargo)
    return rows.withColumn("role", F.when(F.col("fold") == F.lit(found[-1] if found else None), "test").otherwise("wf"))


def evaluation_tags(rows: DataFrame) -> DataFrame:
    """One row: means over the wf folds and the test's numbers, as a version's tags hold them."""
    of = lambda kind, role, metric: F.avg(F.when((F.col("model") == kind) & (F.col("role") == role) & (F.col("metric") == metric), F.col("value")))
    losses = [of(kind, role, "log_loss").alias(f"{role}_{'null_' * (kind == 'null')}log_loss") for role in ("wf", "test") for kind in ("model", "null")]
    return rows.agg(*losses, *[of("model", "test", m).alias(f"test_{m}") for m in ("roc_auc", "accuracy", "base_rate")])


def ranked(results: DataFrame, null_model: str = "majority") -> DataFrame:
    """Models by mean log loss over the folds, with whether they beat the null model; the first is the candidate."""
    means = results.where("metric = 'log_loss'").groupBy("model").agg(F.avg("value").alias("log_loss"))
    null = means.where(F.col("model") == null_model).select(F.col("log_loss").alias("null_log_loss"))
    return means.crossJoin(F.broadcast(null)).withColumn("beats_null", F.col("log_loss") < F.col("null_log_loss")).orderBy("log_loss", "model")


def tuned(df: DataFrame, grid: dict[str, Fit], years: list[int]) -> DataFrame:
    """Points of a parameter grid by mean log loss over the folds."""
    return development(df, grid, years).where("metric = 'log_loss'").groupBy("model").agg(F.avg("value").alias("log_loss")).orderBy("log_loss", "model")


def target_time(ts: Column, interval: Column, horizon: int) -> Column:
    """The time a prediction is about: business days ahead for daily bars, else a number of bars."""
    ahead = G.plus_seconds(ts, G.duration(interval) * horizon)
    return F.when(interval == "1d", G.add_business_days(ts, horizon)).otherwise(ahead)


def predictions(scored: DataFrame, name: str, version: str, feature_set: str, horizon: int = D.HORIZON) -> DataFrame:
    """Rows with P(up) in ``score`` -> prediction rows, their ids from the bar's ``event_id``, with the features that they were made
    from. Rows without one probability in [0, 1] give none."""
    p = F.col("score")
    df = scored.where(p.between(0, 1))
    kept = not set(X.NAMES) - set(df.columns)  # the inputs, if they are there
    df = X.feature_map(df, "features") if kept else df.withColumn("features", F.lit(None).cast("map<string,double>"))
    return df.select(
        contract.prediction_id(F.col("event_id"), F.lit(name), F.lit(version), F.lit(horizon)).alias("prediction_id"), "symbol", F.col("interval").alias("bar_interval"), "ts",
        target_time(F.col("ts"), F.col("interval"), horizon).alias("target_ts"), F.lit(horizon).alias("horizon_bars"), F.lit("direction").alias("task"), F.when(p >= 0.5, "up").otherwise("down").alias("predicted_direction"),
        F.create_map(F.lit("up"), p, F.lit("down"), 1 - p).alias("class_probabilities"), F.greatest(p, 1 - p).alias("confidence"), F.lit(name).alias("model_name"), F.lit(version).alias("model_version"), F.lit(feature_set).alias("feature_set_version"), "features",
    )


def skipped(rows: DataFrame, violations: Column) -> DataFrame:
    """(reason, n): ready rows that get no prediction, by what is wrong with their input or ``no_model``."""
    reason = F.when(~F.col("has_model"), "no_model").when(F.size(violations) > 0, "rejected_input")
    return rows.where("ready").withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


#: Allowed moves between stages, from none for a version that is not registered. What is archived stays so.
TRANSITIONS = [
    (None, "candidate"), ("candidate", "challenger"), ("candidate", "champion"), ("candidate", "archived"), ("challenger", "champion"), ("challenger", "archived"), ("champion", "archived"),
]
#: Stages that one version of a model holds at a time, and the least gain in log loss over the base rate that leads there.
HELD, LEAST_GAIN = ("challenger", "champion"), 0.001
EVALUATION = ("wf_log_loss", "wf_null_log_loss", "test_log_loss", "test_null_log_loss")


def bad_transitions(requests: DataFrame) -> DataFrame:
    allowed = requests.sparkSession.createDataFrame(TRANSITIONS, "from_stage string, to_stage string")
    return requests.join(F.broadcast(allowed), requests["from_stage"].eqNullSafe(allowed["from_stage"]) & (requests["to_stage"] == allowed["to_stage"]), "left_anti")


def gates(candidates: DataFrame, feature_set: str, least_gain: float = LEAST_GAIN) -> DataFrame:
    """(version, gate, passed, hard, blocking) of ``candidates(version, to_stage, feature_set_version, override)`` and the four
    columns of ``EVALUATION``.

    The feature set must match whatever the override, unless a version is archived. Who is to be challenger or champion needs
    an evaluation; where there is one, the smaller of its gains, in walk-forward folds and test, must reach ``least_gain``. These
    two an override lets pass.
    """
    gain = F.least(F.col("wf_null_log_loss") - F.col("wf_log_loss"), F.col("test_null_log_loss") - F.col("test_log_loss"))
    known, held = F.lit(True), F.col("to_stage").isin(*HELD)
    for c in EVALUATION:
        known = known & F.col(c).isNotNull()
    gate = lambda name, asked, passed, hard: F.when(asked, F.struct(F.lit(name).alias("gate"), F.coalesce(passed, F.lit(False)).alias("passed"), F.lit(hard).alias("hard")))
    each = F.array(gate("feature_set_compatible", F.lit(True), F.col("feature_set_version") == feature_set, True), gate("has_evaluation", held, known, False), gate("beats_base_rate", held & known, gain >= least_gain, False))
    df = candidates.where("to_stage <> 'archived'").select("version", "override", F.explode(F.filter(each, lambda g: g.isNotNull())).alias("g")).select("version", "override", "g.*")
    return df.withColumn("blocking", ~F.col("passed") & (F.col("hard") | ~F.col("override"))).drop("override")


def promoted(requests: DataFrame, holders: DataFrame, now: Column) -> DataFrame:
    """Audit rows of ``requests(model_name, model_version, from_stage, to_stage, reason, actor)`` that are granted: one each, and
    one for the version of ``holders(model_name, model_version, stage)`` that a new challenger or champion displaces."""
    rows = requests.withColumn("created_at", now)
    taken = requests.where(F.col("to_stage").isin(*HELD)).select("model_name", F.col("to_stage").alias("stage"), F.col("model_version").alias("_new"), "reason", "actor")
    gone = holders.join(taken, ["model_name", "stage"]).where("model_version <> _new")
    why = F.concat(F.lit("replaced by version "), F.col("_new"), F.lit(": "), F.col("reason"))
    return rows.unionByName(gone.select("model_name", "model_version", F.col("stage").alias("from_stage"), F.lit("archived").alias("to_stage"), why.alias("reason"), "actor", now.alias("created_at")))


def holders(status: DataFrame) -> DataFrame:
    """Of ``version_status``, the versions that hold a stage which one version holds at a time: of several the newest, of equally new ones
    that of the latest move."""
    return status.where(F.col("stage").isin(*HELD)).groupBy("model_name", "stage").agg(F.max_by("model_version", F.struct("since", "moved")).alias("model_version"))


def version_status(deployments: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Each version's stage after its last move, that move's id as ``moved``, with its ``tags(model_name, model_version, ...)``: those of its evaluation, and others. A version
    that was registered but never moved has no stage."""
    last = deployments.groupBy("model_name", "model_version").agg(F.max_by("to_stage", "id").alias("stage"), F.max("created_at").alias("since"), F.max("id").alias("moved"))
    return last if tags is None else last.join(tags, ["model_name", "model_version"], "full")
