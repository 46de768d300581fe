"""Exploratory summaries: describe, correlation matrices, churn rate by level, class distributions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.selection import exact_quantiles

QUARTILES = {"p25": 0.25, "p50": 0.50, "p75": 0.75}


def _long(df: DataFrame, cols: list[str], ids: list[str] = ()) -> DataFrame:
    casted = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return casted.unpivot(list(ids), cols, "column", "value")


def describe_columns(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation, exact), max per column.

    Long form: one row per column (and per ``by`` group). Nulls and NaN are skipped.
    """
    by = list(by)
    long = _long(df, cols, by)
    v = F.col("_v")
    stats = {"count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
    q = exact_quantiles(long, [*by, "column"], "value", QUARTILES, stats=stats)
    return q.where("count > 0").select(*by, "column", "count", "mean", "std", "min", *QUARTILES, "max")


def _moment_sums(cols: list[str], shift: list[float]):
    """Partial sums per class for Pearson's r over pairwise present values (float64, shifted by a value per column)."""
    d = len(cols)

    def sum_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                           pa.array([v.tobytes() for v in sums.values()], pa.binary())],
                                          ["class", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]) - shift
            classes = np.asarray(batch.column("_class"))
            for k in np.unique(classes):
                part = x[classes == k]
                there = ~np.isnan(part)
                part, there = np.where(there, part, 0.0), there.astype(np.float64)
                # per pair (a, b): rows, sum of a, sum of squares of a, sum of products
                new = np.stack([there.T @ there, part.T @ there, (part * part).T @ there, part.T @ part])
                sums[int(k)] = sums[int(k)] + new if int(k) in sums else new
        yield sum_rows(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                new = np.frombuffer(row["sums"]).reshape(4, d, d)
                sums[row["class"]] = sums[row["class"]] + new if row["class"] in sums else new
        yield sum_rows(sums)

    return run, add


def correlation_sums(df: DataFrame, cols: list[str], label: str | None = None) -> dict[int, np.ndarray]:
    """Moment sums per class (0: label 0, 1: label above 0, 2: any other), each d x d, in one pass over the rows.

    A first small aggregate gives the columns' means, which only shift the
    values (the sums then keep their digits). NaN counts as missing.
    """
    cols = list(cols)
    as_double = [F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in cols]
    y = F.col(label).cast("double") if label else F.lit(None).cast("double")
    group = F.when(y > 0, 1).when(y == 0, 0).otherwise(2).cast("int").alias("_class")
    base = df.select(*as_double, group)
    means = base.agg(*[F.avg(c).alias(c) for c in cols]).first()
    run, add = _moment_sums(cols, [float(means[c] or 0.0) for c in cols])
    schema = "class int, sums binary"
    rows = base.mapInArrow(run, schema).repartition("class").mapInArrow(add, schema).collect()  # at most 3 rows
    return {r["class"]: np.frombuffer(r["sums"]).reshape(4, len(cols), len(cols)) for r in rows}


def correlation_from_sums(sums: np.ndarray) -> np.ndarray:
    """Pearson matrix over pairwise present values; NaN where a variance is zero."""
    n, sa, saa, sab = sums
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = n * sab - sa * sa.T
        va, vb = n * saa - sa * sa, (n * saa - sa * sa).T
        va, vb = (np.where(v <= 1e-12 * n * s, 0.0, v) for v, s in ((va, saa), (vb, saa.T)))
        return np.where(va * vb > 0, np.clip(cov / np.sqrt(va * vb), -1.0, 1.0), np.nan)


def correlation_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Pearson matrix of ``cols`` over pairwise present values (one distributed pass; the d x d result is small)."""
    found = correlation_sums(df, cols)
    return correlation_from_sums(sum(found.values())) if found else np.full((len(cols), len(cols)), np.nan)


def _matrix_rows(mat: np.ndarray, cols: list[str], slice_name: str, lower_only: bool) -> list[tuple]:
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if not (lower_only and j >= i):
                r = float(mat[i, j])
                rows.append((slice_name, a, b, None if math.isnan(r) else r))
    return rows


_MATRIX_SCHEMA = "slice string, a string, b string, r double"


def correlation_long(df: DataFrame, cols: list[str], slice_name: str = "all",
                     lower_only: bool = True) -> DataFrame:
    """(slice, a, b, r) for the strict lower triangle (b before a in ``cols``); NaN -> null."""
    rows = _matrix_rows(correlation_matrix(df, cols), list(cols), slice_name, lower_only)
    return df.sparkSession.createDataFrame(rows, _MATRIX_SCHEMA)


def correlation_by_class(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Correlations on all rows, on positives (label > 0) and on negatives (label == 0), from one pass by class."""
    cols = list(cols)
    found = correlation_sums(df, cols, label)
    none = np.zeros((4, len(cols), len(cols)))
    parts = {"all": sum(found.values(), none), "positive": found.get(1, none), "negative": found.get(0, none)}
    rows = [r for name, sums in parts.items() for r in _matrix_rows(correlation_from_sums(sums), cols, name, True)]
    return df.sparkSession.createDataFrame(rows, _MATRIX_SCHEMA)


def melt(df: DataFrame, id_cols: list[str], value_cols: list[str], var_name: str = "variable",
         value_name: str = "value") -> DataFrame:
    """Wide -> long (values cast to double)."""
    casted = df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in value_cols])
    return casted.unpivot(id_cols, value_cols, var_name, value_name)


def rate_by_level(df: DataFrame, label: str, indicators: list[str]) -> DataFrame:
    """Mean label (churn rate) and row count per (indicator, level)."""
    long = melt(df, [label], indicators)
    return long.groupBy("variable", "value").agg(
        F.avg(F.col(label).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def class_quartiles(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Exact quartiles of every column within each class (inner box of a violin plot)."""
    long = _long(df, cols, [label])
    return exact_quantiles(long, [label, "column"], "value", QUARTILES, method="linear")


def class_histogram(df: DataFrame, cols: list[str], label: str, n_bins: int = 50) -> DataFrame:
    """Equal-width histogram per (column, class) on the column's overall range.

    (column, label, bucket, lo, hi, count). The range is one row per column: a
    bounded broadcast.
    """
    long = _long(df, cols, [label]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    rng = long.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = long.join(F.broadcast(rng), "column")
    pos = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * F.lit(float(n_bins))
    bucket = F.least(F.coalesce(F.floor(pos), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    agg = j.groupBy("column", label, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(n_bins))
    return agg.select("column", label, "bucket", (F.col("_lo") + F.col("bucket") * step).alias("lo"),
                      (F.col("_lo") + (F.col("bucket") + 1) * step).alias("hi"), "count")


def class_density(df: DataFrame, cols: list[str], label: str, n_bins: int = 50,
                  grid_points: int = 64) -> DataFrame:
    """Gaussian kernel density per (column, class) on a fixed grid, from the fine histogram.

    Bandwidth by Scott's rule on the class moments (at least half a bin). The
    grid spans the column's overall range; the smoothing works on at most
    ``n_bins`` x ``grid_points`` cells per (column, class), independent of the
    row count. Output (column, label, x, density).
    """
    long = _long(df, cols, [label]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    rng = long.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = long.join(F.broadcast(rng), "column")  # one row per column: bounded
    nb = F.lit(float(n_bins))
    pos = F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * nb
    bucket = F.least(F.coalesce(F.floor(pos), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    hist = j.groupBy("column", label, bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    mom = long.groupBy("column", label).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("value").alias("_sd"))
    width = (F.col("_hi") - F.col("_lo")) / nb
    h = hist.join(mom, ["column", label]).withColumn(
        "_bw", F.greatest(F.coalesce(F.col("_sd"), F.lit(0.0)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2)),
                          width / F.lit(2.0)))
    centre = F.col("_lo") + (F.col("bucket") + F.lit(0.5)) * width
    g = F.explode(F.sequence(F.lit(0), F.lit(grid_points - 1))).alias("_g")
    pts = h.select("column", label, "_n", "_bw", "count", "_lo", "_hi", centre.alias("_c"), g)
    x = F.col("_lo") + F.col("_g") * (F.col("_hi") - F.col("_lo")) / F.lit(float(grid_points - 1))
    z = F.try_divide(x - F.col("_c"), F.col("_bw"))
    k = F.try_divide(F.exp(F.lit(-0.5) * z * z), F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))
    contrib = F.coalesce(F.try_divide(F.col("count") * k, F.col("_n").cast("double")), F.lit(0.0))
    return pts.groupBy("column", label, "_g").agg(F.first(x).alias("x"), F.sum(contrib).alias("density")) \
        .drop("_g")
