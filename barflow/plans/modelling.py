"""Queries of splits, metrics, backtests and fitted models over daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.operators import boosting as B2, backtest as B, contract as C, dataset as D, evaluation as E, features as X, models as M
from barflow.plans.common import day, rd, sq, sqs
from barflow.plans.indicators import FEATURES_SQL, LABELS_SQL, _READY, gapped
from barflow.sources.bars import ORDER_SQL, order_bars
from barflow.sources.session import shared_folder

_TRAIN, _VALID = "1996-12-31", "1997-12-31"
_HORIZON = 5


def labelled(spark, d):
    """Labelled bars with a momentum score and a probability made from it."""
    df = D.with_labels(X.features(gapped(spark, d)))
    return df.withColumn("score", F.col("ret_5")).withColumn("p", 1 / (1 + F.exp(-F.col("ret_5"))))


_LAB = f"{LABELS_SQL.rstrip()}, b AS (SELECT symbol, day AS session_date, ts, ret_5 AS score, 1 / (1 + exp(-ret_5)) AS p, y_return, y_class, y_up, label_end FROM y)"


def split_purge_embargo(spark, d):
    """Chronological train, validation and test, purged and embargoed."""
    df = D.chronological(labelled(spark, d), F.lit(_TRAIN).cast("date"), F.lit(_VALID).cast("date"))
    return df.select("symbol", "session_date", "split", "label_end")


def split_walk_forward(spark, d):
    """Every year of the data but the first is a fold."""
    df = D.walk_forward(labelled(spark, d).select("symbol", "session_date", "label_end"))
    return df.groupBy("fold", "role", "symbol").agg(F.count(F.lit(1)).alias("n"), F.min("session_date").alias("first"), F.max("session_date").alias("last"))


def split_early_stopping(spark, d):
    train, _ = D.purged(labelled(spark, d), F.lit(_VALID).cast("date"), _HORIZON)
    return D.early_stopping(train).groupBy("symbol", "is_validation").agg(F.count(F.lit(1)).alias("n"), F.min("session_date").alias("first"), F.max("session_date").alias("last"))


def eval_classification(spark, d):
    df = labelled(spark, d).where("y_up is not null and score is not null").withColumn("c", (F.col("score") > 0).cast("int"))
    out = E.classification(df, "y_up", "c", ["symbol"], _HORIZON)
    return out.select("symbol", "tp", "fp", "fn", "tn", *[rd(c, 6) for c in ("accuracy", "balanced_accuracy", "precision_up", "recall_up", "f1_up", "f1_macro", "base_rate", "edge", "ci_low", "ci_high")])


def eval_auc(spark, d):
    df = labelled(spark, d).where("y_up is not null and score is not null").withColumn("s", F.round("score", 1))
    return E.roc_auc(df, "y_up", "s", ["symbol"]).select("symbol", rd("roc_auc", 6))


def eval_logloss(spark, d):
    df = labelled(spark, d).where("y_up is not null and p is not null")
    return df.groupBy("symbol").agg(E.log_loss(F.col("y_up"), F.col("p")).alias("log_loss")).select("symbol", rd("log_loss", 6))


def eval_regression(spark, d):
    df = labelled(spark, d).where("y_return is not null and score is not null")
    return E.regression(df, "y_return", "score", ["symbol"]).select("symbol", "n", *[rd(c, 5) for c in ("mae", "rmse", "r2", "directional_accuracy")])


def eval_folds(spark, d):
    """Mean and spread over the years of a yearly accuracy."""
    df = labelled(spark, d).where("y_up is not null and score is not null").withColumn("year", F.year("session_date")).withColumn("c", (F.col("score") > 0).cast("int"))
    yearly = E.classification(df, "y_up", "c", ["symbol", "year"])
    return E.mean_and_spread(yearly, ["accuracy"], ["symbol"]).select("symbol", rd("accuracy_mean", 6), rd("accuracy_sd", 6))


def panel(spark, d):
    """Orders by day: a score from the last five bars, forward returns, some of both missing."""
    df = D.with_labels(order_bars(spark, d).withColumn("gap_before", F.lit(0)).withColumn("session_date", F.to_date("ts")))
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    small = F.tanh("y_return") / 50
    return df.select("symbol", "session_date", F.log(F.col("close") / F.lag("close", 5).over(w)).alias("score"), small.alias("y_return"))


_PANEL = f"""{ORDER_SQL},
pl AS (SELECT symbol, CAST(ts AS DATE) AS session_date, ln(close / lag(close, 5) OVER w) AS score, tanh(ln(lead(close, 5) OVER w / close)) / 50 AS y_return FROM od WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
dt AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS no FROM (SELECT DISTINCT session_date FROM pl)),
rb AS (SELECT pl.*, no % 5 AS "offset", no // 5 AS period FROM pl JOIN dt USING (session_date)),
rk AS (SELECT *, count(score) OVER (PARTITION BY session_date) AS n, row_number() OVER (PARTITION BY session_date ORDER BY score IS NULL, score DESC, symbol) AS rk FROM rb),
wt AS (SELECT *, CASE WHEN score IS NULL THEN 0.0 ELSE 1.0::DOUBLE / n END AS buy_hold, CASE WHEN score IS NOT NULL AND rk <= least(2, n) THEN 1.0::DOUBLE / least(2, n) ELSE 0 END AS top_k,
         CASE WHEN score IS NULL THEN 0 WHEN rk <= least(2, n // 2) THEN 0.5::DOUBLE / least(2, n // 2) WHEN rk > n - least(2, n // 2) THEN -0.5::DOUBLE / least(2, n // 2) ELSE 0 END AS long_short FROM rk),
st AS (SELECT symbol, session_date, "offset", period, y_return, s.strategy, CASE s.strategy WHEN 'buy_hold' THEN buy_hold WHEN 'top_k' THEN top_k ELSE long_short END AS weight FROM wt, (VALUES ('buy_hold'), ('top_k'), ('long_short')) AS s(strategy)),
gr AS (SELECT p.strategy, p."offset", p.period, p.session_date, y.symbol, coalesce(st.weight, 0) AS weight, st.y_return
       FROM (SELECT DISTINCT strategy, "offset", period, session_date FROM st) p CROSS JOIN (SELECT DISTINCT symbol FROM st) y LEFT JOIN st ON st.strategy = p.strategy AND st.session_date = p.session_date AND st.symbol = y.symbol),
gd AS (SELECT *, lag(weight, 1, 0) OVER (PARTITION BY strategy, "offset", symbol ORDER BY period) AS before FROM gr),
pr AS (SELECT strategy, "offset", period, session_date, coalesce(sum(weight * (exp(y_return) - 1)), 0) AS gross, sum(abs(weight - before)) AS turnover, sum(abs(weight)) AS exposure FROM gd GROUP BY 1, 2, 3, 4),
ct AS (SELECT *, turnover * bps / 1e4 AS cost, gross - turnover * bps / 1e4 AS net FROM pr, (VALUES (0.0::DOUBLE), (10.0), (20.0)) AS c(bps)),
eq AS (SELECT *, product(1 + net) OVER (PARTITION BY strategy, bps, "offset" ORDER BY period) AS equity FROM ct),
dd AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY strategy, bps, "offset" ORDER BY period)) - 1 AS down FROM eq),
sm AS (SELECT strategy, bps, "offset", count(*) AS periods, product(1 + net) AS growth, avg(cost) * 50.4 AS annual_cost, avg(net) AS m, stddev_samp(net) AS sd, min(down) AS max_drawdown, avg((net > 0)::INT) AS hit_rate, avg(turnover) AS avg_turnover, avg(exposure) AS avg_exposure FROM dd GROUP BY 1, 2, 3),
sv AS (SELECT *, CASE WHEN growth > 0 THEN growth ** (50.4 / periods) - 1 ELSE -1 END AS annual_return, periods / 50.4 AS years, sd * sqrt(50.4) AS annual_volatility, m / sd * sqrt(50.4) AS sharpe, m / sd * sqrt(periods) AS t_stat FROM sm)
"""


def bt_weights(spark, d):
    df, out = B.rebalances(panel(spark, d), _HORIZON), None
    for name in ("buy_hold", "top_k", "long_short"):
        part = B.weights(df, name, 2).select("symbol", "session_date", "offset", F.lit(name).alias("strategy"), rd("weight", 6))
        out = part if out is None else out.unionByName(part)
    return out


def bt_periods(spark, d):
    df = B.periods(B.weights(B.rebalances(panel(spark, d), _HORIZON), "top_k", 2), 10.0)
    return df.select("offset", "session_date", *[rd(c, 7) for c in ("gross", "turnover", "exposure", "cost", "net")])


_METRICS = {"years": 6, "annual_cost": 6, "growth": 5, "annual_return": 5, "annual_volatility": 6, "sharpe": 5, "t_stat": 5, "max_drawdown": 6, "hit_rate": 6, "avg_turnover": 6, "avg_exposure": 6}


def bt_summary(spark, d):
    df = B.periods(B.weights(B.rebalances(panel(spark, d), _HORIZON), "long_short", 2), 10.0)
    return B.summary(df, _HORIZON).select("offset", "periods", *[rd(c, n) for c, n in _METRICS.items()])


_LOST = {2: "-1.0", 3: "-1.3", 4: "-0.999"}


def bt_losses(spark, d):
    """Summaries where the third period of an offset loses all, more than all, or nearly all."""
    df = B.periods(B.weights(B.rebalances(panel(spark, d), _HORIZON), "long_short", 2), 10.0)
    net = F.col("net")
    for offset, lost in _LOST.items():
        net = F.when((F.col("offset") == offset) & (F.col("period") == 2), F.lit(float(lost))).otherwise(net)
    return B.summary(df.withColumn("net", net), _HORIZON).select("offset", *[rd(c, 5) for c in ("growth", "annual_return", "max_drawdown")])


def bt_offsets(spark, d):
    df = B.periods(B.weights(B.rebalances(panel(spark, d), _HORIZON), "long_short", 2), 10.0)
    return B.over_offsets(B.summary(df, _HORIZON)).select(*[rd(c, 5) for c in ("sharpe_min", "sharpe_median", "sharpe_max", "annual_return_median")])


def bt_costs(spark, d):
    """Every strategy at three costs and all offsets."""
    df = B.grid(panel(spark, d), ["buy_hold", "top_k", "long_short"], [0.0, 10.0, 20.0], _HORIZON, 2)
    return df.select("strategy", rd("cost_bps", 1), "offset", "periods", rd("growth", 5), rd("sharpe", 5))


def _dataset(spark, d):
    """The complete rows, written once: fits read them many times."""
    shared_folder(spark)
    return D.complete(labelled(spark, d)).checkpoint()


def _sets(spark, d):
    df = _dataset(spark, d)
    return D.purged(df, F.lit(_VALID).cast("date"), _HORIZON)


def model_baselines(spark, d):
    """Majority, momentum, zero and mean baselines: each score's mean on the test rows."""
    train, test = _sets(spark, d)
    out = None
    for name, fit in (("majority", M.majority), ("momentum", M.momentum), ("zero", M.zero), ("train_mean", M.train_mean)):
        part = fit(D.labelled(train))(D.labelled(test).drop("score")).agg(F.count(F.lit(1)).alias("n"), rd(F.avg("score"), 6, "mean_score")).select(F.lit(name).alias("model"), "n", "mean_score")
        out = part if out is None else out.unionByName(part)
    return out


def model_predictions(spark, d):
    """Scored bars as prediction rows with derived ids and target times."""
    df = labelled(spark, d).where("p is not null").withColumn("score", F.col("p")).withColumn("event_id", F.concat_ws("-", "symbol", F.unix_micros("ts").cast("string")))
    out = M.predictions(df, "momentum", "1", X.VERSION)
    return out.select("prediction_id", "symbol", F.to_date("ts").alias("day"), F.to_date("target_ts").alias("target_day"), "predicted_direction", rd("confidence", 6))


def ml_logistic(spark, d):
    train, test = _sets(spark, d)
    return M.evaluated(M.fit_and_score(M.logistic(X.NAMES), train.drop("score"), test.drop("score")), "logistic")


def ml_ridge(spark, d):
    train, test = _sets(spark, d)
    df = M.ridge(X.NAMES)(train.drop("score"))(test.drop("score"))
    return E.regression(df, "y_return", "score", ["symbol"])


def ml_gbt(spark, d):
    train, test = _sets(spark, d)
    return M.evaluated(M.fit_and_score(M.boosted(X.NAMES), train.drop("score"), test.drop("score")), "boosted")


def ml_boosted_leaves(spark, d):
    """Metrics of leaf-wise boosted trees on a held-out time."""
    train, test = _sets(spark, d)
    fit = B2.boosted_leaves(X.NAMES, leaves=6, rounds=6, step=0.2)
    return M.evaluated(M.fit_and_score(fit, train.drop("score"), test.drop("score")), "boosted_leaves")


#: Two models that SQL can follow: the share of up labels, and a probability from the last five bars' return.
_PLAIN = {"majority": M.majority, "momentum": lambda train: lambda df: df.withColumn("score", F.col("p"))}
_SHOWN = ["n", "accuracy", "log_loss", "roc_auc"]


def ml_held_out(spark, d):
    """Models fitted on all rows up to a date and judged once on those after it."""
    found, _ = M.held_out_test(_dataset(spark, d).drop("score"), _PLAIN, F.lit(_VALID).cast("date"), ["top_k"], [10.0])
    return found.where(F.col("metric").isin(_SHOWN)).select("model", "metric", rd("value", 6))


def ml_recent_evaluation(spark, d):
    """The tags of a model retrained on its last three full years."""
    return M.evaluation_tags(M.recent_evaluation(_dataset(spark, d).drop("score"), _PLAIN["momentum"])).select(*[rd(c, 6) for c in _TAGS])


_TAGS = ["wf_log_loss", "wf_null_log_loss", "test_log_loss", "test_null_log_loss", "test_accuracy", "test_base_rate"]


def ml_development_run(spark, d):
    """Validation and walk-forward folds of all rows up to a date."""
    report, _, _ = M.development_run(_dataset(spark, d).drop("score"), _PLAIN, F.lit(_TRAIN).cast("date"), F.lit(_VALID).cast("date"), ["top_k"], [10.0])
    return report.where(F.col("metric").isin(_SHOWN)).select("section", "model", "fold", "metric", rd("value", 6))


def ml_candidates(spark, d):
    """Models by mean log loss over the folds of a development run, against the share of up labels."""
    _, found, _ = M.development_run(_dataset(spark, d).drop("score"), _PLAIN, F.lit(_TRAIN).cast("date"), F.lit(_VALID).cast("date"), ["top_k"], [10.0])
    return found.select("model", rd("log_loss", 6), rd("null_log_loss", 6), "beats_null")


def bt_models(spark, d):
    """Backtests of what two models say of a held-out time, by strategy and at four costs."""
    _, tests = M.held_out_test(_dataset(spark, d).drop("score"), _PLAIN, F.lit(_VALID).cast("date"), ["buy_hold", "top_k", "long_short"], [0.0, 5.0, 10.0, 20.0])
    return tests.select("model", "strategy", rd("cost_bps", 1), "offset", "periods", rd("growth", 5), rd("max_drawdown", 5))


def model_skipped(spark, d):
    """Ready rows that get no prediction, by the reason: no model, or an input that breaks a rule."""
    df = X.features(gapped(spark, d)).withColumn("has_model", F.col("symbol") != "N").withColumn("close_pos", F.when(F.dayofmonth("ts") == 7, float("nan")).otherwise(F.col("close_pos")))
    df = X.feature_map(df).withColumn("feature_set_version", F.lit(X.VERSION))
    return M.skipped(df, C.feature_violations(X.NAMES, X.VERSION))


def model_snapshots(spark, d):
    """The inputs that predictions keep."""
    df = labelled(spark, d).where("ready and p is not null").withColumn("score", F.col("p")).withColumn("event_id", F.concat_ws("-", "symbol", F.unix_micros("ts").cast("string")))
    out = M.predictions(df, "momentum", "1", X.VERSION)
    return out.select("symbol", F.to_date("ts").alias("day"), F.size("features").alias("n"), rd(F.col("features")["ret_5"], 6, "ret_5"), rd(F.col("features")["close_pos"], 6, "close_pos"))


def ml_coefficients(spark, d):
    """The ten largest weights of the logistic model."""
    train, _ = _sets(spark, d)
    found = M.coefficients(M.logistic(X.NAMES)(D.labelled(train).drop("score")), X.NAMES)
    return spark.createDataFrame(found, "feature string, weight double")


def ml_development(spark, d):
    """Baselines on a fold a year, ranked by log loss against the majority."""
    df = _dataset(spark, d).drop("score")
    results = M.development(df, {"majority": M.majority, "random": M.random_control()}, [r.fold for r in D.fold_bounds(df, _HORIZON)])
    return M.ranked(results)


_DEPLOY = """dp AS (SELECT o_orderkey AS id, 'm' || (o_custkey % 5) AS model_name, 'v' || (o_orderkey % 7) AS model_version,
  CASE o_orderkey % 5 WHEN 1 THEN 'candidate' WHEN 2 THEN 'challenger' WHEN 3 THEN 'champion' WHEN 4 THEN 'archived' END AS from_stage,
  CASE (o_orderkey // 5) % 4 WHEN 0 THEN 'candidate' WHEN 1 THEN 'challenger' WHEN 2 THEN 'champion' ELSE 'archived' END AS to_stage, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders)"""


def deployments(spark, d):
    k = F.col("o_orderkey")
    stage = lambda x, names: F.element_at(F.array(*map(F.lit, names)), (x + 1).cast("int"))
    return spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("id"), F.concat(F.lit("m"), F.col("o_custkey") % 5).alias("model_name"), F.concat(F.lit("v"), k % 7).alias("model_version"), stage(k % 5, [None, "candidate", "challenger", "champion", "archived"]).alias("from_stage"),
        stage(F.floor(k / 5) % 4, ["candidate", "challenger", "champion", "archived"]).alias("to_stage"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


def model_bad_transitions(spark, d):
    return M.bad_transitions(deployments(spark, d)).groupBy("from_stage", "to_stage").agg(F.count(F.lit(1)).alias("n"))


def _evaluated(spark, d):
    """Deployments as requests, some of another feature set, some without an evaluation."""
    k = F.col("id")
    null = lambda c, by: F.when(k % by != 0, c)
    return deployments(spark, d).select(
        k.cast("string").alias("version"), "model_name", "model_version", "from_stage", "to_stage", F.when(k % 5 == 0, "fs-0").otherwise(X.VERSION).alias("feature_set_version"), (k % 2 == 0).alias("override"),
        null(0.69 - (k % 11 - 5) * 0.0007, 3).alias("wf_log_loss"), F.lit(0.69).alias("wf_null_log_loss"), null(0.68 - (k % 13 - 5) * 0.0007, 7).alias("test_log_loss"), F.lit(0.68).alias("test_null_log_loss"), F.lit("better").alias("reason"), F.lit("op").alias("actor"),
    )


def model_gates(spark, d):
    return M.gates(_evaluated(spark, d), X.VERSION).groupBy("gate", "hard").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.count_if("blocking").alias("blocking"))


def model_promotions(spark, d):
    """Audit rows of the requests that are allowed and pass their gates, against what holds the stages before them."""
    asked = _evaluated(spark, d)
    allowed = asked.join(M.bad_transitions(asked).select("version"), "version", "left_anti")
    granted = allowed.join(M.gates(allowed, X.VERSION).where("blocking").select("version").distinct(), "version", "left_anti")
    columns = ["model_name", "model_version", "from_stage", "to_stage", "reason", "actor"]
    held = M.holders(M.version_status(deployments(spark, d)))
    out = M.promoted(granted.select(*columns), held, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def model_version_status(spark, d):
    return M.version_status(deployments(spark, d)).select("model_name", "model_version", "stage", F.to_date("since").alias("since"))


_BAD = "coalesce(from_stage, '') || '>' || to_stage NOT IN ('>candidate', 'candidate>challenger', 'candidate>champion', 'candidate>archived', 'challenger>champion', 'challenger>archived', 'champion>archived')"
_GATES = """c AS (SELECT *, id % 5 <> 0 AS fs, id % 2 = 0 AS ov, CASE WHEN id % 3 <> 0 THEN 0.69::DOUBLE - (id % 11 - 5) * 0.0007::DOUBLE END AS wl, CASE WHEN id % 7 <> 0 THEN 0.68::DOUBLE - (id % 13 - 5) * 0.0007::DOUBLE END AS tl FROM dp),
q AS (SELECT *, to_stage IN ('challenger', 'champion') AS held, wl IS NOT NULL AND tl IS NOT NULL AS known FROM c WHERE to_stage <> 'archived'),
g AS (SELECT id, ov, 'feature_set_compatible' AS gate, true AS hard, fs AS passed FROM q UNION ALL SELECT id, ov, 'has_evaluation', false, known FROM q WHERE held
  UNION ALL SELECT id, ov, 'beats_base_rate', false, least(0.69::DOUBLE - wl, 0.68::DOUBLE - tl) >= 0.001 FROM q WHERE held AND known)"""
_B = "FROM b WHERE y_up IS NOT NULL AND score IS NOT NULL"
_CM = """count(*) FILTER (y_up = 1 AND score > 0) AS tp, count(*) FILTER (y_up = 0 AND score > 0) AS fp, count(*) FILTER (y_up = 1 AND score <= 0) AS fn, count(*) FILTER (y_up = 0 AND score <= 0) AS tn, count(*)::DOUBLE AS n"""
QUERIES = {q.__name__: q for q in (split_purge_embargo, split_walk_forward, split_early_stopping, eval_classification, eval_auc, eval_logloss, eval_regression, eval_folds, bt_weights, bt_periods, bt_summary, bt_losses, bt_offsets, bt_costs, model_baselines, model_predictions, model_bad_transitions, model_gates, model_promotions, model_version_status, model_skipped, model_snapshots, ml_held_out, ml_recent_evaluation, ml_development_run, ml_candidates, bt_models, ml_coefficients, ml_logistic, ml_ridge, ml_gbt, ml_boosted_leaves, ml_development)}


def _after(boundary: str) -> str:
    return f"(SELECT max(session_date) FROM (SELECT DISTINCT session_date FROM b WHERE session_date > DATE '{boundary}' ORDER BY 1 LIMIT 5))"


def _test(boundary: str, end: str | None = None) -> str:
    tail = f" AND session_date <= DATE '{end}' AND label_end <= DATE '{end}'" if end else ""
    return f"session_date > {_after(boundary)}{tail}"


def _train(boundary: str) -> str:
    return f"session_date <= DATE '{boundary}' AND label_end <= DATE '{boundary}'"


_FOLDS = """ds AS (SELECT session_date AS day, row_number() OVER (ORDER BY session_date) AS no FROM (SELECT DISTINCT session_date FROM b WHERE session_date IS NOT NULL)),
yr AS (SELECT year(day) AS fold, min(no) - 1 AS before FROM ds GROUP BY 1),
fo AS (SELECT fold, make_date(fold - 1, 12, 31) AS bd, make_date(fold, 12, 31) AS en, day AS emb FROM yr, (SELECT count(*) AS total FROM ds) JOIN ds ON no = least(before + 5, total) WHERE before > 0),
fd AS (SELECT fold, 'train' AS role, b.* FROM b JOIN fo ON session_date <= bd AND label_end <= bd UNION ALL SELECT fold, 'test', b.* FROM b JOIN fo ON session_date > emb AND session_date <= en AND label_end <= en)"""
_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in X.NAMES)
_SETS = f"""{LABELS_SQL.rstrip()}, b AS (SELECT symbol, day AS session_date, ret_5, y_return, y_up, label_end FROM y WHERE y_return IS NOT NULL AND {_COMPLETE}),
tr AS (SELECT * FROM b WHERE y_up IS NOT NULL AND {_train(_VALID)}), te AS (SELECT * FROM b WHERE y_up IS NOT NULL AND {_test(_VALID)})"""
_ALL = f"""{LABELS_SQL.rstrip()}, al AS (SELECT symbol, day AS session_date, ret_5, 1 / (1 + exp(-ret_5)) AS p, y_return, y_up, label_end FROM y WHERE y_return IS NOT NULL AND {_COMPLETE})"""
_JUDGED = """mj AS (SELECT section, fold, avg(y_up) AS q FROM st WHERE role = 'train' AND y_up IS NOT NULL GROUP BY 1, 2),
jd AS (SELECT st.section, st.fold, y_up, 'majority' AS model, q FROM st JOIN mj ON st.section = mj.section AND st.fold IS NOT DISTINCT FROM mj.fold WHERE role = 'test' AND y_up IS NOT NULL UNION ALL SELECT section, fold, y_up, 'momentum', p FROM st WHERE role = 'test' AND y_up IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY section, model, fold ORDER BY q) + (count(*) OVER (PARTITION BY section, model, fold, q) - 1) / 2.0::DOUBLE AS r, least(greatest(q, 1e-6), 1 - 1e-6) AS c FROM jd),
mt AS (SELECT section, model, fold, count(*)::DOUBLE AS n, avg(((q >= 0.5) = (y_up = 1))::INT) AS accuracy, avg(-(y_up * ln(c) + (1 - y_up) * ln(1 - c))) AS log_loss, greatest(avg(y_up), 1 - avg(y_up)) AS base_rate,
  (sum(r) FILTER (y_up = 1) - count(*) FILTER (y_up = 1) * (count(*) FILTER (y_up = 1) + 1) / 2) / (count(*) FILTER (y_up = 1) * count(*) FILTER (y_up = 0)) AS roc_auc FROM rk GROUP BY 1, 2, 3),
ml AS (SELECT section, model, fold, v.metric, CASE v.metric WHEN 'n' THEN n WHEN 'accuracy' THEN accuracy WHEN 'log_loss' THEN log_loss ELSE roc_auc END AS value FROM mt, (VALUES ('n'), ('accuracy'), ('log_loss'), ('roc_auc')) AS v(metric))"""
_RUN = f"""{_ALL}, b AS (SELECT * FROM al WHERE {_train(_VALID)}), {_FOLDS},
st AS (SELECT 'walk_forward' AS section, fold, role, y_up, p FROM fd UNION ALL SELECT 'validation', NULL, 'train', y_up, p FROM al WHERE {_train(_TRAIN)} UNION ALL SELECT 'validation', NULL, 'test', y_up, p FROM al WHERE {_test(_TRAIN, _VALID)}), {_JUDGED}"""
_HELD = f"""{_ALL}, b AS (SELECT * FROM al), st AS (SELECT 'test' AS section, 0 AS fold, 'train' AS role, y_up, p FROM b WHERE {_train(_VALID)} UNION ALL SELECT 'test', 0, 'test', y_up, p FROM b WHERE {_test(_VALID)}), {_JUDGED}"""
_RECENT = f"""{_ALL}, b AS (SELECT * FROM al), {_FOLDS}, ly AS (SELECT year(max(label_end)) - 1 AS ly FROM b), st AS (SELECT CASE WHEN fold = ly THEN 'test' ELSE 'wf' END AS section, fold, role, y_up, p FROM fd, ly WHERE fold BETWEEN ly - 2 AND ly), {_JUDGED}"""
_PID = "sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(symbol || '-' || epoch_us(ts) || ':momentum:1:5'))"
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
ORACLES = {
    "split_purge_embargo": f"{_LAB} SELECT symbol, session_date, 'train' AS split, label_end FROM b WHERE {_train(_TRAIN)} UNION ALL SELECT symbol, session_date, 'validation', label_end FROM b WHERE {_test(_TRAIN, _VALID)} UNION ALL SELECT symbol, session_date, 'test', label_end FROM b WHERE {_test(_VALID)}",
    "split_walk_forward": f'{_LAB}, {_FOLDS} SELECT fold::INT AS fold, role, symbol, count(*) AS n, min(session_date) AS "first", max(session_date) AS "last" FROM fd GROUP BY 1, 2, 3',
    "split_early_stopping": f"""{_LAB}, t AS (SELECT * FROM b WHERE {_train(_VALID)}), c AS (SELECT CAST(max(session_date) - INTERVAL 12 MONTH AS DATE) AS cut FROM t),
e AS (SELECT max(session_date) AS emb FROM (SELECT DISTINCT session_date FROM t, c WHERE session_date > cut ORDER BY 1 LIMIT 5)),
v AS (SELECT t.*, session_date > emb AS is_validation FROM t, c, e WHERE (session_date <= cut AND label_end <= cut) OR session_date > emb)
SELECT symbol, is_validation, count(*) AS n, min(session_date) AS "first", max(session_date) AS "last" FROM v GROUP BY 1, 2""",
    "eval_classification": f"""{_LAB}, c AS (SELECT symbol, {_CM} {_B} GROUP BY 1),
m AS (SELECT *, (tp + tn) / n AS accuracy, (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2 AS balanced_accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision_up, coalesce(tp / nullif(tp + fn, 0), 0) AS recall_up,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_up, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1_macro, greatest(tp + fn, tn + fp) / n AS base_rate FROM c),
z AS (SELECT *, accuracy - base_rate AS edge, greatest(0, accuracy - 1.96 * sqrt(accuracy * (1 - accuracy) / greatest(1, n / 5))) AS ci_low, least(1, accuracy + 1.96 * sqrt(accuracy * (1 - accuracy) / greatest(1, n / 5))) AS ci_high FROM m)
SELECT symbol, tp, fp, fn, tn, {sqs({c: 6 for c in ("accuracy", "balanced_accuracy", "precision_up", "recall_up", "f1_up", "f1_macro", "base_rate", "edge", "ci_low", "ci_high")})} FROM z""",
    "eval_auc": f"""{_LAB}, s AS (SELECT symbol, y_up, round(score, 1) AS s {_B}), ra AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY s) + (count(*) OVER (PARTITION BY symbol, s) - 1) / 2.0::DOUBLE AS rk FROM s)
SELECT symbol, {sq("(sum(rk) FILTER (y_up = 1) - count(*) FILTER (y_up = 1) * (count(*) FILTER (y_up = 1) + 1) / 2) / (count(*) FILTER (y_up = 1) * count(*) FILTER (y_up = 0))", 6, 'roc_auc')} FROM ra GROUP BY symbol""",
    "eval_logloss": f"{_LAB}, s AS (SELECT symbol, y_up, least(greatest(p, 1e-6), 1 - 1e-6) AS q {_B}) SELECT symbol, {sq('avg(-(y_up * ln(q) + (1 - y_up) * ln(1 - q)))', 6, 'log_loss')} FROM s GROUP BY 1",
    "eval_regression": f"""{_LAB}, s AS (SELECT symbol, score, y_return AS y, score - y_return AS e FROM b WHERE y_return IS NOT NULL AND score IS NOT NULL)
SELECT symbol, count(*) AS n, {sq('avg(abs(e))', 5, 'mae')}, {sq('sqrt(avg(e * e))', 5, 'rmse')}, {sq('1 - sum(e * e) / (var_pop(y) * count(*))', 5, 'r2')}, {sq('avg((sign(score) = sign(y))::INT) FILTER (score <> 0 AND y <> 0)', 5, 'directional_accuracy')} FROM s GROUP BY 1""",
    "eval_folds": f"{_LAB}, a AS (SELECT symbol, year(session_date) AS yr, avg(((score > 0) = (y_up = 1))::INT) AS acc {_B} GROUP BY 1, 2) SELECT symbol, {sq('avg(acc)', 6, 'accuracy_mean')}, {sq('stddev_pop(acc)', 6, 'accuracy_sd')} FROM a GROUP BY 1",
    "bt_weights": f'WITH {_PANEL} SELECT symbol, session_date, "offset", strategy, {sq("weight", 6)} FROM st',
    "bt_periods": f"WITH {_PANEL} SELECT \"offset\", session_date, {sqs({c: 7 for c in ('gross', 'turnover', 'exposure', 'cost', 'net')})} FROM ct WHERE strategy = 'top_k' AND bps = 10",
    "bt_summary": f"WITH {_PANEL} SELECT \"offset\", periods, {sqs(_METRICS)} FROM sv WHERE strategy = 'long_short' AND bps = 10",
    "bt_losses": f"""WITH {_PANEL}, lt AS (SELECT * REPLACE (CASE {' '.join(f'WHEN "offset" = {k} AND period = 2 THEN {v}::DOUBLE' for k, v in _LOST.items())} ELSE net END AS net) FROM ct WHERE strategy = 'long_short' AND bps = 10),
le AS (SELECT *, product(1 + net) OVER (PARTITION BY "offset" ORDER BY period) AS equity FROM lt), ld AS (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY "offset" ORDER BY period)) - 1 AS down FROM le),
lg AS (SELECT "offset", product(1 + net) AS growth, count(*) AS n, min(down) AS max_drawdown FROM ld GROUP BY 1), la AS (SELECT *, CASE WHEN growth > 0 THEN growth ** (50.4 / n) - 1 ELSE -1 END AS annual_return FROM lg)
SELECT "offset", {sqs({"growth": 5, "annual_return": 5, "max_drawdown": 5})} FROM la""",
    "bt_offsets": f"WITH {_PANEL} SELECT {sq('min(sharpe)', 5, 'sharpe_min')}, {sq('median(sharpe)', 5, 'sharpe_median')}, {sq('max(sharpe)', 5, 'sharpe_max')}, {sq('median(annual_return)', 5, 'annual_return_median')} FROM sv WHERE strategy = 'long_short' AND bps = 10",
    "bt_costs": f'WITH {_PANEL} SELECT strategy, {sq("bps", 1, "cost_bps")}, "offset", periods, {sqs({"growth": 5, "sharpe": 5})} FROM sv',
    "model_snapshots": f"{FEATURES_SQL} SELECT symbol, day, {len(X.NAMES)} AS n, {sqs({'ret_5': 6, 'close_pos': 6})} FROM x WHERE {_READY}",
    "model_skipped": f"{FEATURES_SQL} SELECT CASE WHEN symbol = 'N' THEN 'no_model' ELSE 'rejected_input' END AS reason, count(*) AS n FROM x WHERE {_READY} AND (symbol = 'N' OR day(day) = 7) GROUP BY 1",
    "ml_held_out": f"{_HELD} SELECT model, metric, {sq('value', 6)} FROM ml",
    "ml_development_run": f"{_RUN} SELECT section, model, fold::INT AS fold, metric, {sq('value', 6)} FROM ml",
    "ml_candidates": f"{_RUN}, ca AS (SELECT model, avg(value) AS log_loss FROM ml WHERE section = 'walk_forward' AND metric = 'log_loss' GROUP BY 1), cn AS (SELECT log_loss AS null_log_loss FROM ca WHERE model = 'majority') SELECT model, {sq('log_loss', 6)}, {sq('null_log_loss', 6)}, log_loss < null_log_loss AS beats_null FROM ca, cn",
    "ml_recent_evaluation": f"""{_RECENT}, tg AS (SELECT avg(log_loss) FILTER (section = 'wf' AND model = 'momentum') AS wf_log_loss, avg(log_loss) FILTER (section = 'wf' AND model = 'majority') AS wf_null_log_loss, avg(log_loss) FILTER (section = 'test' AND model = 'momentum') AS test_log_loss,
  avg(log_loss) FILTER (section = 'test' AND model = 'majority') AS test_null_log_loss, avg(accuracy) FILTER (section = 'test' AND model = 'momentum') AS test_accuracy, avg(base_rate) FILTER (section = 'test' AND model = 'momentum') AS test_base_rate FROM mt) SELECT {sqs(dict.fromkeys(_TAGS, 6))} FROM tg""",
    "model_baselines": f"{_SETS} SELECT 'majority' AS model, count(*) AS n, {sq('(SELECT avg(y_up) FROM tr)', 6, 'mean_score')} FROM te UNION ALL SELECT 'momentum', count(*), {sq('avg(ret_5)', 6, 'mean_score')} FROM te UNION ALL SELECT 'zero', count(*), 0.0 FROM te UNION ALL SELECT 'train_mean', count(*), {sq('(SELECT avg(y_return) FROM tr)', 6, 'mean_score')} FROM te",
    "model_predictions": f"""{_LAB}, h AS (SELECT *, {_PID} AS h FROM b WHERE p IS NOT NULL)
SELECT {_UUID} AS prediction_id, symbol, session_date AS day, CAST(session_date + (CASE WHEN isodow(ts) > 5 THEN 8 - isodow(ts) ELSE 0 END + 5 + 2 * ((CASE WHEN isodow(ts) > 5 THEN 0 ELSE isodow(ts) - 1 END + 5) // 5))::INT AS DATE) AS target_day,
CASE WHEN p >= 0.5 THEN 'up' ELSE 'down' END AS predicted_direction, {sq('greatest(p, 1 - p)', 6, 'confidence')} FROM h""",
    "model_bad_transitions": f"WITH {_DEPLOY} SELECT from_stage, to_stage, count(*) AS n FROM dp WHERE {_BAD} GROUP BY 1, 2",
    "model_gates": f"WITH {_DEPLOY}, {_GATES} SELECT gate, hard, count(*) AS n, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed AND (hard OR NOT ov)) AS blocking FROM g GROUP BY 1, 2",
    "model_promotions": f"""WITH {_DEPLOY}, {_GATES},
ok AS (SELECT * FROM c WHERE NOT ({_BAD}) AND id NOT IN (SELECT id FROM g WHERE NOT passed AND (hard OR NOT ov))),
vs AS (SELECT model_name, model_version, arg_max(to_stage, id) AS stage, max(created_at) AS since, max(id) AS moved FROM dp GROUP BY 1, 2),
hd AS (SELECT model_name, stage, arg_max(model_version, (since, moved)) AS model_version FROM vs WHERE stage IN ('challenger', 'champion') GROUP BY 1, 2),
au AS (SELECT model_name, model_version, from_stage, to_stage, 'better' AS reason FROM ok
  UNION ALL SELECT hd.model_name, hd.model_version, hd.stage, 'archived', 'replaced by version ' || ok.model_version || ': better' FROM hd JOIN ok ON hd.model_name = ok.model_name AND hd.stage = ok.to_stage AND hd.model_version <> ok.model_version)
SELECT model_name, model_version, from_stage, to_stage, reason, 'op' AS actor, count(*) AS n FROM au GROUP BY 1, 2, 3, 4, 5""",
    "model_version_status": f"WITH {_DEPLOY} SELECT model_name, model_version, arg_max(to_stage, id) AS stage, CAST(max(created_at) AS DATE) AS since FROM dp GROUP BY 1, 2",
}
