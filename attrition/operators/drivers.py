"""Driver analysis: loyal-population box statistics and scaled driver values of leavers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selection import exact_quantiles
from ..schema import KEY, PREDICTION_COL, SCORE_COL


def gather_drivers(df: DataFrame, id_cols: list[str], drivers: list[str]) -> DataFrame:
    """Wide -> long (id..., driver, value), values cast to double."""
    casted = df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in drivers])
    return casted.unpivot(id_cols, drivers, "driver", "value")


def loyal_quartiles(scored: DataFrame, drivers: list[str], prediction_col: str = PREDICTION_COL) -> DataFrame:
    """(driver, q1, median, q3, iqr) over the accounts predicted to stay (exact, interpolated)."""
    loyal = gather_drivers(scored.where(F.col(prediction_col) == 0), [], drivers)
    q = exact_quantiles(loyal, ["driver"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return q.withColumn("iqr", F.col("q3") - F.col("q1"))


def box_stats(scored: DataFrame, drivers: list[str], prediction_col: str = PREDICTION_COL) -> DataFrame:
    """Box-plot statistics per driver over loyal accounts.

    Hinges (q1, median, q3), whiskers at the furthest value within 1.5 IQR of
    the hinges, the number of values beyond them and n. The quartile table is
    one row per driver, a bounded broadcast.
    """
    loyal = gather_drivers(scored.where(F.col(prediction_col) == 0), [], drivers).where(
        F.col("value").isNotNull())
    q = loyal_quartiles(scored, drivers, prediction_col)
    j = loyal.join(F.broadcast(q), "driver")
    lo = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi = F.col("q3") + F.lit(1.5) * F.col("iqr")
    v = F.col("value")
    return j.groupBy("driver").agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.first("iqr").alias("iqr"),
        F.min(F.when(v >= lo, v)).alias("whisker_lo"), F.max(F.when(v <= hi, v)).alias("whisker_hi"),
        F.count_if((v < lo) | (v > hi)).alias("n_outliers"), F.count(F.lit(1)).alias("n"))


def outliers(scored: DataFrame, drivers: list[str], key: str = KEY, prediction_col: str = PREDICTION_COL) -> DataFrame:
    """(account, driver, value): the loyal accounts' values beyond 1.5 IQR of the hinges, the points of a box plot."""
    loyal = gather_drivers(scored.where(F.col(prediction_col) == 0), [key], drivers)
    j = loyal.join(F.broadcast(loyal_quartiles(scored, drivers, prediction_col)), "driver")  # a row per driver
    reach = F.lit(1.5) * F.col("iqr")
    return j.where((F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)).select(
        key, "driver", "value")


def scaled_box_stats(scored: DataFrame, drivers: list[str], prediction_col: str = PREDICTION_COL) -> DataFrame:
    """Box statistics of the loyal accounts' drivers after robust scaling by their own median and IQR.

    This is the box drawn behind each leaver's points (median 0, IQR 1 unless
    the IQR is 0, in which case the scaled values are null and dropped).
    """
    from .features import RobustScalerColumns

    loyal = scored.where(F.col(prediction_col) == 0)
    scaled = RobustScalerColumns(drivers).fit(loyal).transform(loyal)
    return box_stats(scaled, drivers, prediction_col)


def driver_analysis(scored: DataFrame, drivers: list[str], accounts: list | None = None,
                    key: str = KEY, score_col: str = SCORE_COL, prediction_col: str = PREDICTION_COL,
                    view: tuple[float, float] = (-3.0, 30.0)) -> DataFrame:
    """Leavers' drivers scaled by the loyal median and IQR, in long form.

    (account, probability, prediction, driver, value, in_view); IQR 0 gives a
    null value. ``accounts`` keeps only the chosen accounts; ``in_view`` flags
    values inside the display window.
    """
    q = loyal_quartiles(scored, drivers, prediction_col)
    churned = scored.where(F.col(prediction_col) == 1)
    if accounts is not None:
        churned = churned.where(F.col(key).isin(list(accounts)))
    long = gather_drivers(churned, [key, score_col, prediction_col], drivers)
    j = long.join(F.broadcast(q.select("driver", "median", "iqr")), "driver")
    value = F.try_divide(F.col("value") - F.col("median"), F.col("iqr"))
    return j.select(key, score_col, prediction_col, "driver", value.alias("value"),
                    value.between(view[0], view[1]).alias("in_view"))
