"""Fitted models against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barflow.operators import boosting as L, dataset as D, models as M

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    days = pd.bdate_range("2020-01-01", "2022-12-30")
    x = rng.normal(size=(2 * len(days), 3)).round(3)
    z = 1.5 * (x[:, 0] > 0.3) - 1.2 * (x[:, 1] > 0) * (x[:, 0] < 0) - 0.2
    up = (rng.random(len(x)) < 1 / (1 + np.exp(-z))).astype(float)
    out = pd.DataFrame(x, columns=NAMES).assign(y_up=up, y_return=0.02 * z + rng.normal(0, 0.01, len(x)), symbol=["S", "T"] * len(days), session_date=np.repeat(days.date, 2))
    return out.assign(label_end=out.session_date + pd.Timedelta(days=7))


@pytest.fixture(scope="module")
def rows(spark, table):
    return spark.createDataFrame(table).repartition(5).checkpoint()


def test_logistic_minimises_its_penalised_loss(rows, table):
    fitted = M.logistic(NAMES, c=0.1)(rows)
    x = table[NAMES].to_numpy()
    x, y, n = (x - x.mean(axis=0)) / x.std(axis=0), table.y_up.to_numpy(), len(x)
    w = np.zeros(4)
    full = np.column_stack([x, np.ones(n)])
    penalty = np.array([1.0, 1.0, 1.0, 0.0]) / (0.1 * n)
    for _ in range(30):  # Newton
        p = 1 / (1 + np.exp(-full @ w))
        w -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full / n + np.diag(penalty), full.T @ (p - y) / n + penalty * w)
    got = {(r.symbol, r.session_date): r.score for r in fitted(rows).collect()}
    want = 1 / (1 + np.exp(-full @ w))
    assert [got[k] for k in zip(table.symbol, table.session_date)] == pytest.approx(want.tolist(), abs=2e-4)
    assert [c for c, _ in M.coefficients(fitted, NAMES)][0] == "a" and M.coefficients(fitted, NAMES, 2)[0][1] == pytest.approx(w[0], abs=1e-3)


def test_ridge_solves_its_normal_equations(rows, table):
    fitted = M.ridge(NAMES, alpha=10.0)(rows)
    x = table[NAMES].to_numpy()
    x, y = (x - x.mean(axis=0)) / x.std(axis=0), table.y_return.to_numpy()
    w = np.linalg.solve(x.T @ x + 10.0 * np.eye(3), x.T @ (y - y.mean()))
    got = {(r.symbol, r.session_date): r.score for r in fitted(rows).collect()}
    assert [got[k] for k in zip(table.symbol, table.session_date)] == pytest.approx((x @ w + y.mean()).tolist(), abs=1e-6)


def test_best_split_by_trying_all():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sums = np.abs(rng.normal(size=(3, 6, 3)))
        sums[..., 0] = rng.normal(size=(3, 6))
        sums[..., 2] = rng.integers(0, 9, (3, 6))
        ways = [(0.0, 0, 0)]
        for f in range(3):
            for b in range(5):
                (g1, h1, n1), (g2, h2, n2) = sums[f, : b + 1].sum(axis=0), sums[f, b + 1 :].sum(axis=0)
                if min(n1, n2) >= 10:
                    ways.append((g1 * g1 / (h1 + 2) + g2 * g2 / (h2 + 2) - (g1 + g2) ** 2 / (h1 + h2 + 2), f, b))
        assert L.best_split(sums, 2.0, 10)[0] == pytest.approx(max(0.0, max(ways)[0]), abs=1e-9)


def plain(table, leaves, rounds, step, penalty, least, edges):
    """Leaf-wise boosting over the same bins, one row set a leaf."""
    x = np.stack([np.searchsorted(e, table[c], "left") for c, e in zip(NAMES, edges)], axis=1)
    y = table.y_up.to_numpy()
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h, sets = p - y, p * (1 - p), [np.arange(len(y))]
        while len(sets) < leaves:
            ways = []
            for i, own in enumerate(sets):
                for f in range(3):
                    for cut in range(len(edges[f])):
                        right = x[own, f] > cut
                        if min(right.sum(), (~right).sum()) >= least:
                            part = lambda m: g[own][m].sum() ** 2 / (h[own][m].sum() + penalty)  # noqa: B023, E731
                            ways.append((part(right) + part(~right) - part(np.ones(len(own), bool)), -i, -f, -cut))
            gain, i, f, cut = max(ways)
            if gain <= 1e-12:
                break
            own = sets[-i]
            right = x[own, -f] > -cut
            sets[-i] = own[~right]
            sets.append(own[right])
        for own in sets:
            raw[own] -= step * g[own].sum() / (h[own].sum() + penalty)
    return raw


def test_leaf_wise_trees_equal_a_plain_search(spark, rows, table):
    fit = L.boosted_leaves(NAMES, leaves=5, rounds=3, step=0.3, penalty=1.5, least=20, bins=16, patience=99, subsample=1.0, columns=1.0)
    model = fit(rows)
    assert 1 <= len(model.trees) <= 3 and all(len(t.values) == 5 for t in model.trees)
    learned = {(r.symbol, r.session_date) for r in D.early_stopping(rows).where("not is_validation").select("symbol", "session_date").collect()}
    own = table[[k in learned for k in zip(table.symbol, table.session_date)]]
    # the search knows the share of all learned rows only, as the fit does
    want = plain(own, 5, len(model.trees), 0.3, 1.5, 20, model.edges)
    got = {(r.symbol, r.session_date): r.score for r in model(rows).collect()}
    assert [got[k] for k in zip(own.symbol, own.session_date)] == pytest.approx((1 / (1 + np.exp(-want))).tolist(), abs=1e-9)


def test_leaf_wise_boosting_finds_a_signal_and_stops(rows, table):
    fit = L.boosted_leaves(NAMES, leaves=4, rounds=8, step=0.5, least=20, bins=32, patience=2)
    model = fit(rows)
    assert {c for c, _ in M.coefficients(model, NAMES, 2)} == {"a", "b"} and sum(model.gain.values()) == pytest.approx(1.0)
    p = np.array([r.score for r in model(rows).orderBy("symbol", "session_date").collect()])
    y = table.sort_values(["symbol", "session_date"]).y_up.to_numpy()
    loss = lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    assert loss(p) < loss(np.full(len(y), y.mean())) - 0.03
    again = fit(rows.repartition(2))
    assert again.raw(again.bins(table[NAMES].to_numpy())) == pytest.approx(model.raw(model.bins(table[NAMES].to_numpy())).tolist())
    assert L.boosted_leaves(NAMES)(rows.limit(0)).trees == []


def test_spark_boosting_and_grid(rows):
    fitted = M.boosted(NAMES, depth=2, rounds=3)(rows)
    assert {c for c, _ in M.coefficients(fitted, NAMES, 2)} == {"a", "b"}
    grid = {"weak": M.majority, "strong": lambda train: M.boosted(NAMES, depth=2, rounds=3)(train)}
    got = M.tuned(rows.withColumn("ret_5", F.col("a")), grid, [2022]).collect()
    assert [r.model for r in got] == ["strong", "weak"] and got[0].log_loss < got[1].log_loss


def test_random_control_depends_on_the_row_alone(rows):
    score = M.random_control()(rows)
    a, b = ({(r.symbol, r.session_date): r.score for r in score(x).collect()} for x in (rows, rows.repartition(3)))
    assert a == b and 0 <= min(a.values()) and max(a.values()) < 1 and abs(np.mean(list(a.values())) - 0.5) < 0.05
