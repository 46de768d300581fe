"""Co-moments, fits of all folds from one pass, and in-task stochastic descent."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.functions.ranking import auc_by_rank
from attrition.operators import evaluate as EV
from attrition.operators import models as M
from attrition.operators.moments import CoMoments, by_class, co_moments, merged

NAMES = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 4000
    y = rng.integers(0, 2, n).astype(float)
    x = rng.normal(size=(n, 6)) + y[:, None] * [1.0, 0.5, 0.0, -0.7, 0.2, 0.0] + [1e6, 0, 0, 0, 0, 5]
    x[:, 4] = x[:, 1] - 2 * x[:, 3]  # collinear
    fold = rng.integers(0, 5, n)
    rows = [(i, int(fold[i]), float(y[i]), *map(float, x[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, fold int, label double, " + ", ".join(f"{c} double" for c in NAMES))
    return df.repartition(9), x, y, fold


@pytest.mark.parametrize("pairs", [True, False])
def test_merge_in_any_order(pairs):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4)) * [1, 1e-3, 1e3, 1] + [0, 1e6, 0, 3]
    x[rng.random(x.shape) < 0.1] = np.nan
    whole = CoMoments.of(x, pairs)
    cuts = [0, 1, 1, 40, 300, 499, 500]
    parts = [CoMoments.of(x[a:b], pairs) for a, b in zip(cuts, cuts[1:])]
    for order in (parts, parts[::-1]):
        m = merged(order)
        assert np.allclose(m.n, whole.n) and np.allclose(m.mean, whole.mean, rtol=1e-12)
        assert np.allclose(m.products, whole.products, rtol=1e-9, atol=1e-9 * np.abs(whole.products).max())


def test_moments_by_fold_and_class(table):
    df, x, y, fold = table
    found = co_moments(df, NAMES, "label", "fold")
    assert set(found) == {(f, c) for f in range(5) for c in (0.0, 1.0)}
    for c, m in by_class(found, without=2).items():
        part = x[(fold != 2) & (y == c)]
        assert m.n[0] == len(part) and np.allclose(m.mean, part.mean(axis=0))
        assert np.allclose(m.products, (part - part.mean(axis=0)).T @ (part - part.mean(axis=0)), rtol=1e-8, atol=1e-6)


def test_missing_values_and_labels(spark):
    rows = [(0.0, 1.0, None), (0.0, 3.0, 2.0), (0.0, float("nan"), 4.0), (1.0, 5.0, 6.0), (None, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "label double, a double, b double")
    each = co_moments(df, ["a", "b"], "label", pairs=False)
    assert set(each) == {(0, 0.0), (0, 1.0)}
    assert each[0, 0.0].n.tolist() == [2, 2] and each[0, 0.0].mean.tolist() == [2, 3] and each[0, 0.0].products.tolist() == [2, 2]
    assert co_moments(df, ["a", "b"], "label")[0, 0.0].n.tolist() == [1, 1]
    assert co_moments(df.where("false"), ["a", "b"], "label") == {}


@pytest.mark.parametrize("make", [lambda: M.LinearDiscriminant(NAMES), lambda: M.GaussianNaiveBayes(NAMES)])
def test_fold_fits_equal_separate_fits(table, make):
    df = table[0]
    folds = make().fit_folds(df)
    scored = folds.transform(df).select("id", "fold", "score", "prediction").collect()
    for f in range(5):
        alone = make().fit(df.where(F.col("fold") != f)).transform(df.where(F.col("fold") == f))
        want = {r.id: r for r in alone.collect()}
        mine = [r for r in scored if r.fold == f]
        assert len(mine) == len(want)
        assert max(abs(r.score - want[r.id].score) for r in mine) < 1e-9
        assert all(r.prediction == want[r.id].prediction for r in mine)
    full = {r.id: r.score for r in make().fit(df).transform(df).collect()}
    assert max(abs(r.score - full[r.id]) for r in folds.full.transform(df).collect()) < 1e-9


def test_multiclass_naive_bayes_and_missing_features(spark):
    rng = np.random.default_rng(1)
    rows = [(float(c), float(rng.normal(3 * c)), float(rng.normal(-c))) for c in range(4) for _ in range(200)]
    df = spark.createDataFrame(rows, "label double, a double, b double")
    out = M.GaussianNaiveBayes(["a", "b"]).fit(df).transform(df)
    assert "score" not in out.columns
    assert out.where("prediction = label").count() > 0.8 * 800
    hole = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert M.GaussianNaiveBayes(["a", "b"]).fit(df).transform(hole).first().prediction is None


def _one_machine_sgd(x, y, epochs, eta0, power_t, alpha, seed):
    rng, w, t = np.random.default_rng(seed), np.zeros(x.shape[1] + 1), 0
    x1 = np.column_stack([x, np.ones(len(x))])
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            t += 1
            p = 1 / (1 + np.exp(-x1[i] @ w))
            w -= eta0 / t ** power_t * ((p - y[i]) * x1[i] + alpha * np.append(w[:-1], 0))
    return w


def _auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_sgd_is_as_good_as_on_one_machine(spark, table):
    _, x, y, fold = table
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    rows = [(i, int(fold[i]), float(y[i]), *map(float, x[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "id long, fold int, label double, " + ", ".join(f"{c} double" for c in NAMES)).repartition(6)
    one = _one_machine_sgd(x, y, 10, 0.05, 0.25, 1e-4, 0)
    here = M.SGDLogistic(NAMES)
    model = here.fit(df)
    assert _auc(x @ model.w + model.b, y) > _auc(x @ one[:-1] + one[-1], y) - 0.005
    assert len(here.losses) == 10 and here.losses[-1] < here.losses[0]
    again = M.SGDLogistic(NAMES).fit(df)
    assert np.allclose(again.w, model.w) or np.allclose(again.w, model.w, atol=0.05)  # order of rows may differ
    _, oof, metrics = EV.cross_validate(df, lambda: M.SGDLogistic(NAMES), refit=True)
    assert oof.count() == len(y) and metrics.count() == 5
    assert auc_by_rank(oof, "score", "label").first().auc > _auc(x @ one[:-1] + one[-1], y) - 0.01


def test_sgd_skips_incomplete_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(0.0, -1.0), (1.0, 1.0), (1.0, None), (None, 5.0)] * 50, "label double, x double")
    model = M.SGDLogistic(["x"]).fit(df)
    assert model.w[0] > 0
    assert M.SGDLogistic(["x"]).fit(df.where("false")).w.tolist() == [0.0]
