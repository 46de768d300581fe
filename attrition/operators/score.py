"""Scoring accounts and the summary views built on the scored table."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import percent_of, rate_band
from ..schema import KEY, PREDICTION_COL, SCORE_COL


def score_accounts(model, df: DataFrame, drivers: list[str], key: str = KEY,
                   score_col: str = SCORE_COL, prediction_col: str = PREDICTION_COL) -> DataFrame:
    """(account, probability of leaving, 0/1 prediction, driver columns) from a fitted model."""
    out = model.transform(df)
    if "score" in out.columns:
        p = F.col("score")
    else:
        p = vector_to_array(F.col("probability"))[1]
    return out.select(key, p.alias(score_col), F.col("prediction").cast("int").alias(prediction_col), *drivers)


def churn_summary(scored: DataFrame, prediction_col: str = PREDICTION_COL) -> DataFrame:
    """One row: predicted leavers, predicted loyal, leaver percentage, its band and one-decimal text."""
    agg = scored.agg(F.count_if(F.col(prediction_col) == 1).alias("n_churned"),
                     F.count_if(F.col(prediction_col) == 0).alias("n_loyal"),
                     F.count(F.lit(1)).alias("n_total"))
    pct = percent_of("n_churned", "n_total")
    return agg.select("n_churned", "n_loyal", "n_total", pct.alias("churn_pct"),
                      rate_band(pct).alias("band"), F.format_number(pct, 1).alias("churn_rate_text"))


def predicted_churners(scored: DataFrame, score_col: str = SCORE_COL, prediction_col: str = PREDICTION_COL,
                       key: str = KEY) -> DataFrame:
    """Predicted leavers, most likely first (ties by account)."""
    return scored.where(F.col(prediction_col) == 1).orderBy(F.col(score_col).desc(), F.col(key).asc())


def call_list(scored: DataFrame, k: int = 200, score_col: str = SCORE_COL, prediction_col: str = PREDICTION_COL,
              key: str = KEY) -> DataFrame:
    """Top ``k`` (account, probability) of the predicted leavers (a top-k: one bounded sort)."""
    return predicted_churners(scored, score_col, prediction_col, key).select(key, score_col).limit(k)
