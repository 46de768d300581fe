"""Resampling, folds, confusion metrics and rank AUC properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.functions.ranking import auc_by_rank
from attrition.operators import evaluate as EV
from attrition.operators import sampling as S


def test_resample_keeps_positives_and_clamps(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    out = S.resample(df, "y", 1.0, seed=1)
    counts = {r["y"]: r["count"] for r in S.class_counts(out, "y").collect()}
    assert counts[1] == 400
    assert 250 < counts[0] < 550
    assert S.negative_fraction(10, 5, 1.0) == 1.0  # fraction above 1 is clamped
    assert S.resample(df, "y", 0) is df
    with pytest.raises(ValueError):
        S.resample(df.where("y = 0"), "y", 1.0)


def test_folds_partition_and_stratify(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    hashed = S.with_hash_folds(df, ["id"], 4)
    assert hashed.select("fold").distinct().count() == 4 and hashed.count() == 1003
    strat = S.with_stratified_folds(df, "y", ["id"], 5).groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in strat if r["y"] == y]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    uni = S.with_uniform_column(df, 46)
    parts = [S.fold_filter(uni, 4, i) for i in range(4)]
    assert sum(v.count() for v, _ in parts) == 1003
    assert all(v.count() + t.count() == 1003 for v, t in parts)
    split = S.hash_split(df, ["id"], 0.7).groupBy("split").count().collect()
    share = {r["split"]: r["count"] for r in split}["train"] / 1003
    assert 0.6 < share < 0.8


def test_confusion_and_hard_auc(spark):
    rows = [(1, 1), (1, 1), (1, 0), (0, 0), (0, 1), (0, 0), (0, 0)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = EV.confusion(df).first()
    assert (m["n_true_pos"], m["n_false_neg"], m["n_false_pos"], m["n_true_neg"]) == (2, 1, 1, 3)
    assert m["roc_auc"] == pytest.approx((2 / 3 + 3 / 4) / 2)
    hard = auc_by_rank(df.withColumn("s", F.col("prediction").cast("double")), "s", "label").first()["auc"]
    assert hard == pytest.approx(m["roc_auc"])  # hard-label AUC = (TPR + TNR) / 2


def test_auc_invariant_under_monotone_transform(spark):
    rng = np.random.default_rng(3)
    rows = [(float(s), int(y)) for s, y in zip(rng.normal(size=400), rng.integers(0, 2, 400))]
    df = spark.createDataFrame(rows, "s double, y int")
    a = auc_by_rank(df, "s", "y").first()["auc"]
    b = auc_by_rank(df.withColumn("s", F.exp(F.col("s") * 3)), "s", "y").first()["auc"]
    assert 0.0 <= a <= 1.0 and a == pytest.approx(b)


def test_resample_ratio_two_halves_the_negatives(spark):
    df = spark.range(20000).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in S.class_counts(S.resample(df, "y", 2.0, seed=7), "y").collect()}
    assert counts[1] == 5000
    assert 2200 < counts[0] < 2800  # expected 2500: positives / negatives ~ 2
