"""Feature weights and recursive feature elimination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.ranking import auc_by_rank
from .evaluate import cross_validate
from .features import assemble_features
from .models import FEATURES


def feature_weights(spark, model, names: list[str]) -> DataFrame:
    """(feature, weight) of a linear model, ascending by weight (d rows)."""
    coef = [float(x) for x in model.coefficients.toArray()]
    rows = list(zip(names, coef))
    return spark.createDataFrame(rows, "feature string, weight double").orderBy("weight", "feature")


def feature_importances(model, names: list[str]) -> list[tuple[str, float]]:
    imp = model.featureImportances.toArray()
    return sorted(zip(names, (float(x) for x in imp)), key=lambda t: (t[1], t[0]))


def feature_elimination(data: DataFrame, features: list[str], make_estimator: Callable[[], object],
                        label: str = "label", fold_col: str = "fold", step: int = 1,
                        min_features: int = 1) -> tuple[DataFrame, list[str]]:
    """Recursive elimination: fit, drop the ``step`` least important features, score out-of-fold AUC.

    Returns ((n_features, features, score_auc) per size, best feature list).
    Each size is one cross-validation on a persisted frame.
    """
    spark = data.sparkSession
    current = list(features)
    results = []
    base = data.select(*{*features, label, fold_col}).persist()
    try:
        while True:
            assembled = assemble_features(base, current, output_col=FEATURES)
            _, oof, _ = cross_validate(assembled, make_estimator, label, fold_col)
            auc = auc_by_rank(oof, "score", label).first()["auc"]
            results.append((len(current), ",".join(current), auc))
            if len(current) <= min_features:
                break
            full = make_estimator().fit(assembled)
            ranked = feature_importances(full, current)
            drop = {n for n, _ in ranked[:min(step, len(current) - min_features)]}
            current = [c for c in current if c not in drop]
    finally:
        base.unpersist()
    table = spark.createDataFrame(results, "n_features int, features string, score_auc double")
    best = max(results, key=lambda r: ((r[2] if r[2] is not None else -1.0), -r[0]))
    return table, best[1].split(",")
