"""Class balance, resampling, train/test splits and fold assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import hash_fold, hash_uniform, key_hash, uniform_fold
from ..functions.ranking import ranked
from .clean import split_half_open


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, count)."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def negative_fraction(n_pos: int, n_neg: int, pos_to_neg_ratio: float) -> float:
    """Share of negatives kept so that positives : negatives ~ ``pos_to_neg_ratio`` (at most 1)."""
    if n_neg == 0 or n_pos == 0:
        raise ValueError(f"both classes are needed to resample (positives={n_pos}, negatives={n_neg})")
    return min(1.0, float(n_pos) / n_neg / pos_to_neg_ratio)


def resample(df: DataFrame, label: str, pos_to_neg_ratio: float = 1.0, seed: int = 46,
             positive=1, negative=0, keys: list[str] | None = None) -> DataFrame:
    """Keep every positive and each negative with probability ``n1 / n0 / ratio``; other labels go.

    ``ratio <= 0`` returns ``df`` unchanged. The class counts are two numbers
    (one small aggregate over the two classes); the sampling itself is a narrow draw per row, so
    sizes are approximate, not exact. With ``keys`` the draw is a hash of
    them, and the same row is kept in every run; else it is ``rand(seed)``.
    """
    if pos_to_neg_ratio <= 0:
        return df
    y = F.col(label)
    n = df.where(y.isin(positive, negative)).agg(F.count_if(y == positive).alias("pos"),
                                                 F.count_if(y == negative).alias("neg")).first()
    frac = negative_fraction(n["pos"], n["neg"], pos_to_neg_ratio)
    if keys is None:
        return df.sampleBy(label, fractions={positive: 1.0, negative: frac}, seed=seed)
    return df.where((y == positive) | ((y == negative) & (hash_uniform(keys, seed) < F.lit(frac))))


def hash_split(df: DataFrame, keys: list[str], train_share: float = 0.7, seed: int = 42,
               column: str = "split") -> DataFrame:
    """Deterministic train/test label from a hash of the key (stable across partitionings)."""
    return df.withColumn(column, F.when(hash_uniform(keys, seed) < F.lit(train_share), F.lit("train"))
                         .otherwise(F.lit("test")))


def random_split(df: DataFrame, train_share: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    train, test = df.randomSplit([train_share, 1.0 - train_share], seed)
    return train, test


def with_hash_folds(df: DataFrame, keys: list[str], k: int, seed: int = 46, column: str = "fold") -> DataFrame:
    """Fold id from a hash of the key: the same row always lands in the same fold."""
    return df.withColumn(column, hash_fold(keys, k, seed))


def with_uniform_folds(df: DataFrame, k: int, seed: int = 46, column: str = "fold") -> DataFrame:
    """Fold id from ``rand(seed)``, written once to the checkpoint folder so every reuse agrees.

    ``rand`` is evaluated per partition; recomputing an uncheckpointed frame
    after a lost executor or a different partitioning could move rows.
    """
    return df.withColumn(column, uniform_fold(k, seed)).checkpoint(eager=True)


def with_uniform_column(df: DataFrame, seed: int = 46, column: str = "uid_rand") -> DataFrame:
    """All columns plus a uniform [0, 1) column from ``rand(seed)`` (integer seed), checkpointed.

    Written once so that every fold filter sees the same draw.
    """
    return df.select("*", F.rand(int(seed)).alias(column)).checkpoint(eager=True)


def fold_filter(df: DataFrame, k: int, i: int, column: str = "uid_rand") -> tuple[DataFrame, DataFrame]:
    """(validation, train) for fold ``i`` of a uniform column: validation = [i/k, (i+1)/k)."""
    return split_half_open(df, column, i / k, (i + 1) / k)


def with_stratified_folds(df: DataFrame, label: str, keys: list[str], k: int, seed: int = 46,
                          column: str = "fold") -> DataFrame:
    """Exactly stratified folds: inside each class rows are ranked by a key hash and dealt round-robin.

    Every class contributes ``floor(n_c / k)`` or ``ceil(n_c / k)`` rows to each
    fold. Ranking is done range by range (no class is sent to a single task).
    """
    h = df.withColumn("_h", key_hash(keys, seed))
    r = ranked(h, [label], "_h", tiebreak=keys)
    return r.withColumn(column, F.pmod(F.col("row_index"), F.lit(k)).cast("int")).drop(
        "_h", "row_index", "group_size")
