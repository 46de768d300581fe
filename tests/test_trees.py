import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from attrition.operators import models as M
from attrition.operators import trees as T
from attrition.sources.sinks import load_saved, save_model


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(1500, 6)), 1)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(1500) < 0.1)).astype(float)
    some = [(i, *map(float, r), float(t), i % 3) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(some, "id long, " + ", ".join(f"x{j} double" for j in range(6)) + ", label double, fold int")
    df = df.withColumn("features", array_to_vector(F.array(*[f"x{j}" for j in range(6)])))
    return df.select("id", "features", "label", "fold").checkpoint(eager=True)


def scores(df):
    return {r["id"]: r["score"] for r in df.select("id", "score").collect()}


def test_deep_tree_is_the_tree_of_spark_ml(spark, rows):
    spark_tree = DecisionTreeClassifier(maxDepth=30, seed=46).fit(rows)
    expected = {r[0]: r[1] for r in spark_tree.transform(rows).select("id", vector_to_array("probability")[1]).collect()}
    for task_rows in (50_000, 200):  # all in one task; top levels from histograms
        model = T.DeepForest(1, 30, bootstrap=False, tried="all", task_rows=task_rows).fit(rows)
        out = model.transform(rows)
        assert scores(out) == pytest.approx(expected, abs=1e-12)
        assert out.where((F.col("score") > 0.5) != (F.col("prediction") == 1)).isEmpty()


def test_deep_models_do_not_keep_their_nodes_in_the_driver(rows):
    for estimator in (M.random_forest(4), M.extra_trees(4), M.decision_tree()):
        assert isinstance(estimator, T.DeepForest) and estimator.settings()["max_depth"] == 30
    model = T.DeepForest(4, 30, task_rows=200).fit(rows)
    in_driver = sum(len(top["id"]) for top in model.tops)
    stored = model.subtrees.select(F.sum(F.length("feature") / 2)).first()[0]
    assert in_driver < 4 * 2 * 2 * 1500 / 200 < stored
    groups = model.subtrees.selectExpr("max(c0 + c1)").first()[0]
    assert groups <= 200


def test_forest_does_not_depend_on_where_nodes_are_grown(rows):
    large, small = (T.DeepForest(3, 30, task_rows=n).fit(rows) for n in (50_000, 300))
    assert scores(small.transform(rows)) == pytest.approx(scores(large.transform(rows)), abs=1e-12)


def test_folds_side_by_side_are_the_fits_without_each_fold(rows):
    make = T.DeepForest(3, 30, bootstrap=False, task_rows=500)
    models = make.fit_folds(rows)
    judged = scores(models.transform(rows))
    assert len(judged) == 1500
    alone = scores(models.by_fold[2].transform(rows.where("fold = 2")))
    assert alone == pytest.approx({k: judged[k] for k in alone}, abs=1e-12)
    tree = T.DeepForest(1, 30, bootstrap=False, tried="all").fit_folds(rows)
    alone = T.DeepForest(1, 30, bootstrap=False, tried="all").fit(rows.where("fold <> 1")).transform(rows.where("fold = 1"))
    assert scores(tree.by_fold[1].transform(rows.where("fold = 1"))) == pytest.approx(scores(alone), abs=1e-12)


def test_forest_is_saved_and_loaded(spark, rows, tmp_path):
    model = T.DeepForest(3, 30, task_rows=200).fit_folds(rows).by_fold[1]
    save_model(model, f"{tmp_path}/forest")
    assert scores(load_saved(spark, f"{tmp_path}/forest").transform(rows)) == pytest.approx(scores(model.transform(rows)), abs=1e-12)


def test_repeated_rows_and_one_class(rows):
    twice = rows.unionByName(rows)
    out = T.DeepForest(2, 30, task_rows=1000).fit(twice).transform(twice)
    assert out.count() == 3000 and out.columns == [*rows.columns, "prediction", "score"]
    ones = rows.where("label = 1")
    assert {r[0] for r in T.DeepForest(2, 30, task_rows=100).fit(ones).transform(rows).select("score").collect()} == {1.0}
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        T.DeepForest(2, 30).fit(rows.withColumn("label", F.lit(2.0)))


def test_bootstrap_weights_are_poisson_draws():
    w = T.bootstrap_weights(46, 3, np.arange(200_000))
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert not np.array_equal(w, T.bootstrap_weights(46, 4, np.arange(200_000)))
