import random

import numpy as np
import pytest

from attrition.llm import toxicity as T


def fit_models(rows, cols, labels, folds, n_features, p):
    """The chain on one machine: models of all rows, later ones on out-of-fold probabilities of earlier ones."""
    n, models = len(labels), []
    before = np.zeros((n, 0))
    for k in range(labels.shape[1]):
        y = labels[:, k]

        def fitted(use):
            use = use & ~np.isnan(y)
            number = np.cumsum(use) - 1
            own = use[rows]
            return T.fit_linear(number[rows[own]], cols[own], before[use], y[use], n_features, p.ridge)

        models.append(fitted(np.ones(n, bool)))
        if k + 1 < labels.shape[1]:
            held_out = np.zeros(n)
            for f in range(p.folds):
                own = folds == f
                held_out[own] = fitted(~own).logit(rows, cols, before)[own]
            before = np.column_stack([before, T.sigmoid(held_out)])
    return models


def test_fits_in_tasks_equal_one_machine(spark):
    rng = np.random.default_rng(8)
    x = rng.random((300, 12)) < 0.3
    y = (x[:, :3] @ [1.0, 2, -1] + rng.normal(size=300) > 0.5).astype(float)
    z = ((y > 0) ^ (rng.random(300) < 0.1)).astype(float)
    labels = np.column_stack([y, z, rng.random(300) < 0.5]).astype(float)
    labels[rng.random(labels.shape) < 0.05] = np.nan
    fold = rng.integers(0, 5, 300)
    data = [(i, int(fold[i]), [None if np.isnan(v) else float(v) for v in labels[i]], np.flatnonzero(x[i]).tolist())
            for i in range(300)]
    hits = spark.createDataFrame(data, "row bigint, fold int, y array<double>, hits array<int>").repartition(4)
    got = T.fit_in_tasks(hits, 3, 12, T.Params())
    for one, two in zip(got, fit_models(*np.nonzero(x), labels, fold, 12, T.Params())):
        assert np.allclose(one.weights, two.weights, atol=1e-9) and np.allclose(one.earlier, two.earlier, atol=1e-9)
        assert one.intercept == pytest.approx(two.intercept)
    assert [len(m.earlier) for m in T.fit_in_tasks(hits.where("false"), 2, 12, T.Params())] == [0, 1]


@pytest.fixture(scope="module")
def made(spark):
    """(documents, labels): toxic texts hold a bad word or a word with a bad beginning."""
    rnd = random.Random(5)
    docs, labels = [], []
    for k in range(600):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(5, 60))]
        toxic, rude = rnd.random() < 0.25, rnd.random() < 0.3
        if rude:
            words.insert(rnd.randrange(len(words)), rnd.choice(["rudeword", "impolite"]))
        if toxic:
            words.insert(rnd.randrange(len(words)), rnd.choice(["Vile!", f"grim{rnd.randrange(99)}xyz"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(rude), int(toxic), None))
    labels += [(3, labels[3][1], labels[3][2], None), (None, 1, 1, None), (4, None, None, None), (9999, 1, 1, None)]
    return (spark.createDataFrame(docs, "doc_id bigint, text string"),
            spark.createDataFrame(labels, "doc_id bigint, rude int, toxic int, text string"))


@pytest.fixture(scope="module")
def chain(made):
    docs, labels = made
    return T.fit_chain(docs, labels.where("doc_id % 4 > 0 OR doc_id IS NULL"), ["rude", "toxic"])


def test_held_out_accuracy(made, chain):
    docs, labels = made
    got = {r.doc_id: (r.p_rude >= 0.5, r.p_toxic >= 0.5) for r in T.score(docs, chain).collect()}
    truth = {r.doc_id: (r.rude == 1, r.toxic == 1) for r in labels.where("doc_id % 4 = 0 AND toxic >= 0").collect()}
    for k in range(2):
        assert np.mean([got[i][k] == y[k] for i, y in truth.items()]) > 0.97


def test_models_solve_their_problem():
    rng = np.random.default_rng(2)
    x = rng.random((200, 5)) < 0.4
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [2.0, -1, 0, 1, 0] - 0.5)))).astype(float)
    rows, cols = np.nonzero(x)
    before = rng.random((200, 1))
    m = T.fit_linear(rows, cols, before, y, 5, 1e-2)
    error = T.sigmoid(m.logit(rows, cols, before)) - y
    assert np.abs(x.T @ error + 2 * m.weights).max() < 1e-2 and abs(error.sum()) < 1e-2
    assert np.abs(before.T @ error + 2 * m.earlier).max() < 1e-2
    only = T.fit_linear(rows, cols, before, np.zeros(200), 5, 1e-2)
    assert (T.sigmoid(only.logit(rows, cols, before)) < 1e-4).all()


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(3)
    n = 400
    first = rng.random(n) < 0.5
    rows, cols = np.flatnonzero(first), np.zeros(int(first.sum()), int)
    labels = np.column_stack([first, first]).astype(float)
    models = fit_models(rows, cols, labels, np.arange(n) % 5, 1, T.Params())
    assert models[0].earlier.shape == (0,) and models[1].earlier.shape == (1,) and models[1].earlier[0] > 0
    labels[::7, 0] = np.nan
    assert len(fit_models(rows, cols, labels, np.arange(n) % 5, 1, T.Params())) == 2


def test_odd_texts_and_dropping(spark, chain):
    rows = [(1, None, 1), (2, "", 2), (3, "?!", 3), (4, "you VILE thing", 4), (4, "you VILE thing", 5), (None, "grim7xyz w1", 6),
            (5, "w1 " * 5000, 7), (6, "w1 " * 5000 + "vile vile grim9xyz", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, p_toxic int")
    scored = T.score(docs, chain)
    assert scored.columns == ["doc_id", "p_rude", "p_toxic"] and scored.count() == len(rows)
    kept = T.drop_toxic(docs, chain)
    assert kept.columns == docs.columns
    assert sorted(r.p_toxic for r in kept.collect()) == [1, 2, 3, 7]


def test_without_labels_or_documents(spark, docs_of, made, chain):
    docs, labels = made
    empty = T.fit_chain(docs, labels.limit(0), ["rude", "toxic"])
    assert T.drop_toxic(docs, empty).count() == docs.count()
    assert T.score(docs_of([]), chain).count() == 0


def test_repeated_documents_and_an_empty_table(spark, made):
    docs, labels = made
    twice = docs.unionByName(docs.where("doc_id % 3 = 0")).unionByName(spark.createDataFrame([(None, "x"), (3, None)], docs.schema))
    chain = T.fit_chain(twice, labels.where("doc_id % 4 > 0"), ["rude", "toxic"])
    assert len(chain.models) == 2 and T.drop_toxic(twice, chain).count() < twice.count()
    none = T.fit_chain(docs.limit(0), labels, ["rude", "toxic"])
    assert T.drop_toxic(docs, none).count() == docs.count()
