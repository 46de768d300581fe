"""Account-level aggregation of the monthly usage panel and the label join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clean_number_sql, null_if_nan_sql, q
from ..schema import EXPLORATORY_LABEL, KEY, KEY_COLUMNS, LABEL, MONTH, MONTHS_PRESENT


def feature_columns(panel: DataFrame, exclude=KEY_COLUMNS) -> list[str]:
    from ..schema import numeric_columns

    return numeric_columns(panel, exclude=exclude)


def account_means(panel: DataFrame, key: str = KEY, features: list[str] | None = None) -> DataFrame:
    """One row per account: the mean of every feature under its own name.

    A single hash aggregate (partial + final); the calendar and key columns are
    never averaged, so nothing has to be dropped or renamed afterwards.
    """
    feats = features if features is not None else feature_columns(panel)
    return panel.groupBy(key).agg(*[F.expr(f"avg({q(c)}) AS {q(c)}") for c in feats])


def join_label(accounts: DataFrame, labels: DataFrame, key: str = KEY, how: str = "inner") -> DataFrame:
    """Equi-join on one named key (the key appears once). Catalyst/AQE pick the strategy."""
    return accounts.join(labels, key, how)


def account_table(panel: DataFrame, labels: DataFrame, key: str = KEY) -> DataFrame:
    """Account means joined with the label (inner: accounts missing on either side drop)."""
    return join_label(account_means(panel, key), labels, key)


def assert_unique_key(df: DataFrame, key: str = KEY) -> DataFrame:
    """Keys that occur more than once (empty when the key is unique)."""
    return df.groupBy(key).count().where(F.col("count") > 1)


def account_months_means(panel: DataFrame, labels: DataFrame | None = None, key: str = KEY,
                         features: list[str] | None = None, label: str = LABEL) -> DataFrame:
    """Exploratory account frame: months present, NaN-skipping mean of each feature and of the label.

    Rules of the exploratory path: null keys are dropped, NaN is skipped by the
    mean, +inf becomes NaN and every NaN/null becomes 0 afterwards.
    """
    feats = features if features is not None else feature_columns(panel)
    data = panel.where(F.col(key).isNotNull())
    if labels is not None:
        data = data.join(labels.select(key, F.col(label).alias("_label")), key, "left")
    aggs = [f"count({q(MONTH)}) AS {q(MONTHS_PRESENT)}"]
    aggs += [f"avg({null_if_nan_sql(f'CAST({q(c)} AS DOUBLE)')}) AS {q(c)}" for c in feats]
    if labels is not None:
        aggs.append("avg(CAST(_label AS DOUBLE)) AS _label")
    agg = data.groupBy(key).agg(*[F.expr(a) for a in aggs])
    cleaned = [q(key), q(MONTHS_PRESENT)] + [f"{clean_number_sql(q(c))} AS {q(c)}" for c in feats]
    if labels is not None:
        cleaned.append(f"{clean_number_sql('_label')} AS {q(EXPLORATORY_LABEL)}")
    return agg.selectExpr(*cleaned)


def distinct_keys(panel: DataFrame, key: str = KEY) -> DataFrame:
    return panel.select(key).where(F.col(key).isNotNull()).distinct()


def spot_check(panel: DataFrame, account_id, columns: list[str], key: str = KEY) -> DataFrame:
    """Averages of ``columns`` for one account (dictionary-style aggregate after a filter)."""
    return panel.where(F.col(key) == F.lit(account_id)).agg({c: "avg" for c in columns})


def spot_check_all(panel: DataFrame, table: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """The spot check for every account at once: the panel re-averaged next to the stored table.

    Returns key, ``avg_<c>`` recomputed from the panel, ``<c>`` from the table and
    ``matches`` (all equal up to a relative 1e-9).
    """
    again = panel.groupBy(key).agg(*[F.avg(c).alias(f"avg_{c}") for c in columns])
    both = again.join(table.select(key, *columns), key, "inner")
    ok = F.lit(True)
    for c in columns:
        size = F.greatest(F.abs(F.col(f"avg_{c}")), F.abs(F.col(c)), F.lit(1.0))
        ok = ok & F.coalesce(F.abs(F.col(f"avg_{c}") - F.col(c)) <= size * 1e-9, F.lit(True))
    return both.withColumn("matches", ok)
