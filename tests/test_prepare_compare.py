"""Model-input preparation with the default rules, and the model comparison table."""

import numpy as np
from pyspark.sql import functions as F

from attrition.operators import clean as C
from attrition.operators import evaluate as EV
from attrition.operators import features as FE
from attrition.operators import models as M
from attrition.operators.sampling import hash_split, with_hash_folds


def test_prepare_data_default_rules(spark):
    rows = [
        (1, 1, 10.0, "a", "M", None),
        (2, 0, 0.0, "a", "F", 1.0),     # profitability 0: dropped
        (3, 1, 5.0, "b", "M", 2.0),     # status b: dropped
        (4, 0, 7.0, "a", "X", 3.0),     # gender X: dropped (gender is categorical)
        (5, 1, 8.0, "a", "", 4.0),      # '' gender: dropped by the level rule before the replacement
        (6, 0, 9.0, "a", "F", None),
    ]
    df = spark.createDataFrame(rows, "id long, churn int, profitability double, status string, gender string, x double")
    out = {r["id"]: r for r in C.prepare_data(df, ["x"], ["gender"], "churn", ["id"]).collect()}
    assert set(out) == {1, 6}
    assert out[1]["x"] == 0.0 and out[6]["gender"] == "F"  # null -> 0 on numeric columns
    assert C.prepare_data(df, ["x"], [], "churn", ["id"]).count() == 4  # gender not categorical: ids 1, 4, 5, 6 kept
    assert list(C.prepare_data(df, ["x"], ["gender"], "churn", ["id"]).columns) == ["id", "churn", "x", "gender"]
    blanks = C.prepare_data(df, ["x"], ["gender"], "churn", ["id"], membership={})
    assert "NULL" in {r["gender"] for r in blanks.collect()}  # '' -> 'NULL' on categoricals


def test_compare_models_table(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=400) + 2 * y
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                               "id long, x double, label double")
    data = with_hash_folds(FE.assemble_features(hash_split(df, ["id"], 0.7), ["x"]), ["id"], 3)
    train, test = data.where(F.col("split") == "train"), data.where(F.col("split") == "test")
    table = EV.compare_models(train, {"lr": lambda: M.logistic_regression(20),
                                      "nb": lambda: M.GaussianNaiveBayes(["x"])}, test=test).collect()
    assert len(table) == 6 and {r["model"] for r in table} == {"lr", "nb"}
    assert all(r["score_auc"] > 0.8 and r["test_hard_auc"] > 0.75 and r["seconds"] > 0 for r in table)


def test_compare_models_works_on_several_models_at_once(spark):
    """Each stand-in waits for the other in its first fit; one model after the other would never get on."""
    import threading

    from pyspark.ml.classification import LogisticRegression

    df = spark.createDataFrame([(i, float(i % 2), float(i % 2 + i % 3)) for i in range(60)], "id long, label double, x double")
    data = with_hash_folds(FE.assemble_features(df, ["x"]), ["id"], 2)
    both = threading.Barrier(2, timeout=60)
    seen = set()

    class Waits(LogisticRegression):
        def __init__(self, name):
            super().__init__(maxIter=2)
            self.name = name

        def _fit(self, rows):
            if self.name not in seen:
                seen.add(self.name)
                both.wait()
            return super()._fit(rows)

    table = EV.compare_models(data, {n: lambda n=n: Waits(n) for n in ("a", "b")}).collect()
    assert [(r["model"], r["fold"]) for r in table if r["fold"] == 0] == [("a", 0), ("b", 0)]
    assert [r["model"] for r in table] == ["a", "a", "b", "b"]
