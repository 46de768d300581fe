"""Hand-written models and estimators through save and load, alone and as pipeline stages; safe table replacement."""

import tempfile

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from attrition.operators import evaluate as EV
from attrition.operators import features as FE
from attrition.operators import models as M
from attrition.operators.sampling import with_hash_folds
from attrition.sources import sinks

NAMES = ["x1", "x2"]
MAKERS = {
    "lda": lambda: M.LinearDiscriminant(NAMES),
    "naive_bayes": lambda: M.GaussianNaiveBayes(NAMES),
    "sgd": lambda: M.SGDLogistic(NAMES, epochs=3),
    "svm": lambda: M.RandomFeatureSVM(NAMES, n_components=12, max_iter=5),
    "knn": lambda: M.NearestNeighbours(NAMES, k=7),
}


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, 2)) + y[:, None]
    rows = [(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, label double")


def scores(df):
    return [(r.id, r.score, r.prediction) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("name", MAKERS)
def test_model_and_estimator_survive_a_round_trip(spark, blobs, name):
    path = tempfile.mkdtemp() + "/m"
    estimator = MAKERS[name]()
    model = estimator.fit(blobs)
    sinks.save_model(model, path)
    again = sinks.load_model(type(model), path)
    assert again.uid == model.uid and scores(again.transform(blobs)) == scores(model.transform(blobs))
    assert type(sinks.load_saved(spark, path)) is type(model)
    sinks.save_model(model, path)  # overwrites
    estimator.write().overwrite().save(path)
    assert type(estimator).load(path).settings() == estimator.settings()


@pytest.mark.parametrize("name", MAKERS)
def test_pipelines_hold_them(blobs, name):
    path = tempfile.mkdtemp()
    pipeline = Pipeline(stages=[VectorAssembler(inputCols=NAMES, outputCol="together"), MAKERS[name]()])
    pipeline.write().overwrite().save(path + "/p")
    fitted = Pipeline.load(path + "/p").fit(blobs)
    fitted.write().overwrite().save(path + "/f")
    again = PipelineModel.load(path + "/f").transform(blobs)
    assert "together" in again.columns and scores(again) == scores(fitted.transform(blobs))


def test_arrays_larger_than_a_block(spark, monkeypatch):
    from attrition.operators import persistence as P

    monkeypatch.setattr(P, "_BLOCK", 7)
    arrays = {"a": np.arange(60.0).reshape(3, 20), "b": np.array(2.5), "c": np.zeros((0, 4))}
    path = tempfile.mkdtemp() + "/a"
    P.write_arrays(spark, path, arrays)
    found = P.read_arrays(spark, path)
    assert {k: v.tolist() for k, v in found.items()} == {k: v.tolist() for k, v in arrays.items()}
    assert found["c"].shape == (0, 4)


def test_comparison_saves_reloads_judges_and_writes(spark, blobs):
    data = with_hash_folds(FE.assemble_features(blobs, NAMES), ["id"], 3)
    where = tempfile.mkdtemp()
    train, test = data.where("id % 4 <> 0"), data.where("id % 4 = 0")
    models = {**MAKERS, "tree": lambda: M.decision_tree(3), "logistic": lambda: M.logistic_regression(5)}
    out = EV.compare_models(train, models, test=test, model_dir=where + "/models", prediction_dir=where + "/pred",
                            id_col="id").collect()
    assert len(out) == 3 * len(models) and all(r.score_auc > 0.6 and r.test_hard_auc > 0.6 for r in out)
    for name in models:
        model = sinks.load_saved(spark, f"{where}/models/{name}")
        pred = EV.confusion(model.transform(test), "label", "prediction").first().roc_auc
        assert pred == pytest.approx(next(r.test_hard_auc for r in out if r.model == name))
        rows = spark.read.option("header", True).csv(f"{where}/pred/{name}")
        assert rows.columns == ["id", "purchased"] and rows.count() == test.count()


def test_replacing_a_table_that_is_read_or_fails(spark):
    spark.sql("DROP TABLE IF EXISTS t_attr_swap")
    sinks.replace_table(spark.range(5), "t_attr_swap")
    sinks.replace_table(spark.table("t_attr_swap").where("id > 1"), "t_attr_swap")  # reads what it replaces
    assert sorted(r.id for r in spark.table("t_attr_swap").collect()) == [2, 3, 4]
    broken = spark.range(100).select(F.expr("raise_error('no')").cast("long").alias("id"))
    with pytest.raises(Exception):
        sinks.replace_table(broken, "t_attr_swap")
    assert sorted(r.id for r in spark.table("t_attr_swap").collect()) == [2, 3, 4]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("t_attr_swap__")] == []
    spark.sql("DROP TABLE t_attr_swap")
