"""Column profiler: per-column statistics, value frequencies and histograms.

Shape of the plan: the columns of one kind are unpivoted to (column, value)
and a **single** ``groupBy("column")`` computes every statistic. The unpivot
is a narrow Expand and the partial aggregate collapses each task's rows to one
row per column before the shuffle, so the exchange is tiny whatever the input
size; sketches (distinct count, percentiles, histogram) are bounded in size.

Statistics per column (in this order): type, dType, missing_data_fraction,
distinct_values, zeros_fraction, avg, stddev_of_avg, stddev, min, pc25,
pc50, pc75, max. Fractions are percentages of *all* rows rounded to 3
decimals; percentiles are observed values. Columns without any present value
keep only type and dType. Numeric-only statistics are null for categoricals.

``exact=True`` replaces the two sketches by exact distributed computations
(distinct values by a two-level aggregation, discrete percentiles by rank
selection, 64-bit integers and decimals in their own type); the default
follows the sketch-based original.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import not_missing, standard_error
from ..functions.selection import exact_quantiles

STAT_ORDER = ("type", "dType", "missing_data_fraction", "distinct_values", "zeros_fraction", "avg",
              "stddev_of_avg", "stddev", "min", "pc25", "pc50", "pc75", "max")
PERCENTILES = {"pc25": 0.25, "pc50": 0.50, "pc75": 0.75}

_NUM = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)
_CAT = (T.StringType, T.BinaryType, T.BooleanType, T.CharType, T.VarcharType)


def column_kinds(df: DataFrame) -> dict[str, tuple[str, str]]:
    """column -> (kind, Spark type name); kind is num, cat or other."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, _NUM):
            kind = "num"
        elif isinstance(f.dataType, _CAT):
            kind = "cat"
        else:
            kind = "other"
        out[f.name] = (kind, f.dataType.simpleString())
    return out


def _long(df: DataFrame, cols: list[str], cast: str) -> DataFrame:
    """(column, value) rows for ``cols`` cast to one type (a narrow unpivot)."""
    casted = df.select(*[F.col(c).cast(cast).alias(c) for c in cols])
    return casted.unpivot([], cols, "column", "value")


def _fraction(part: Column, total: Column, digits: int) -> Column:
    return F.round(F.try_divide(part.cast("double"), total.cast("double")) * F.lit(100.0), digits)


def _missing(digits: int) -> Column:
    """``round(100 - present / rows * 100, digits)``: percentage of rows without a value."""
    share = F.try_divide(F.col("_present").cast("double"), F.col("_rows").cast("double")) * F.lit(100.0)
    return F.round(F.lit(100.0) - share, digits)


def _meta(kinds: dict[str, tuple[str, str]], spark) -> DataFrame:
    rows = [(c, k, t, i) for i, (c, (k, t)) in enumerate(kinds.items())]
    return spark.createDataFrame(rows, "column string, type string, dType string, position int")


def _by_type(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Column type of the unpivoted value -> columns; 64-bit integers and decimals keep all their digits."""
    out: dict[str, list[str]] = {}
    for c in cols:
        t = df.schema[c].dataType
        out.setdefault(t.simpleString() if isinstance(t, (T.LongType, T.DecimalType)) else "double", []).append(c)
    return out


def numeric_stats(df: DataFrame, cols: list[str], exact: bool = False, accuracy: int = 10_000,
                  digits: int = 3) -> DataFrame:
    if exact:
        parts = [_exact_stats(_long(df, some, kind)) for kind, some in _by_type(df, cols).items()]
        stats = parts[0]
        for p in parts[1:]:
            stats = stats.unionByName(p)
    else:
        long = _long(df, cols, "double")
        v = F.col("value")
        ok = not_missing(v, "num")
        pv = F.when(ok, v)
        stats = long.groupBy("column").agg(
            F.count(F.lit(1)).alias("_rows"), *[c.alias(n) for n, c in _moments(pv).items()],
            F.approx_count_distinct(pv).alias("distinct_values"),
            F.percentile_approx(pv, list(PERCENTILES.values()), accuracy).alias("_pcts"))
        stats = stats.select("*", *[F.col("_pcts")[i].alias(n) for i, n in enumerate(PERCENTILES)])
    return stats.select(
        "column", "_rows", "_present",
        _missing(digits).alias("missing_data_fraction"),
        F.col("distinct_values").cast("long").alias("distinct_values"),
        _fraction(F.col("_zeros"), F.col("_rows"), digits).alias("zeros_fraction"),
        "avg", standard_error("stddev", "_present").alias("stddev_of_avg"), "stddev",
        "min", *PERCENTILES, "max")


def _moments(v: Column) -> dict[str, Column]:
    return {"_present": F.count(v), "_zeros": F.count_if(v == 0), "avg": F.avg(v), "stddev": F.stddev_samp(v),
            "min": F.min(v), "max": F.max(v)}


def _exact_stats(long: DataFrame) -> DataFrame:
    """Moments, discrete percentiles and distinct count of (column, value) in the values' own type, then as double."""
    stats = {"_rows": F.count(F.lit(1)), **_moments(F.col("_v"))}
    out = exact_quantiles(long, ["column"], "value", PERCENTILES, method="discrete", with_distinct=True, stats=stats)
    return out.select("column", "_rows", "_present", "_zeros", F.col("n_distinct").alias("distinct_values"),
                      *[F.col(c).cast("double").alias(c) for c in ("avg", "stddev", "min", *PERCENTILES, "max")])


def categorical_stats(df: DataFrame, cols: list[str], exact: bool = False, digits: int = 3) -> DataFrame:
    long = _long(df, cols, "string")
    v = F.col("value")
    ok = not_missing(v, "cat")
    aggs = [F.count(F.lit(1)).alias("_rows"), F.count_if(ok).alias("_present")]
    if not exact:
        aggs.append(F.approx_count_distinct(F.when(ok, v)).alias("distinct_values"))
    stats = long.groupBy("column").agg(*aggs)
    if exact:
        distinct = long.where(ok).select("column", "value").distinct().groupBy("column").agg(
            F.count(F.lit(1)).alias("distinct_values"))
        stats = stats.join(distinct, "column", "left")
    return stats.select(
        "column", "_rows", "_present",
        _missing(digits).alias("missing_data_fraction"),
        F.col("distinct_values").cast("long").alias("distinct_values"))


def other_stats(df: DataFrame, cols: list[str], digits: int = 3) -> DataFrame:
    """Dates, timestamps, nested types: only the missing fraction (nulls)."""
    exprs = [F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("_present")) for c in cols]
    one = df.agg(F.count(F.lit(1)).alias("_rows"), F.array(*exprs).alias("_cols"))
    return one.select("_rows", F.explode("_cols").alias("s")).select(
        F.col("s.column").alias("column"), "_rows", F.col("s._present").alias("_present"),
        _missing(digits).alias("missing_data_fraction"))


def profile(df: DataFrame, exact: bool = False, accuracy: int = 10_000, digits: int = 3) -> DataFrame:
    """Long profile: one row per column of ``df`` with the 13 statistics (see module doc)."""
    kinds = column_kinds(df)
    by_kind = {k: [c for c, (kk, _) in kinds.items() if kk == k] for k in ("num", "cat", "other")}
    parts = []
    if by_kind["num"]:
        parts.append(numeric_stats(df, by_kind["num"], exact, accuracy, digits))
    if by_kind["cat"]:
        parts.append(categorical_stats(df, by_kind["cat"], exact, digits))
    if by_kind["other"]:
        parts.append(other_stats(df, by_kind["other"], digits))
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.unionByName(p, allowMissingColumns=True)
    meta = _meta(kinds, df.sparkSession)
    joined = meta.join(stats, "column", "left")
    empty = F.coalesce(F.col("_present"), F.lit(0)) == 0
    out = [F.col("column"), F.col("type"), F.col("dType")]
    for name in STAT_ORDER[2:]:
        c = F.col(name) if name in stats.columns else F.lit(None).cast("double")
        out.append(F.when(empty, F.lit(None)).otherwise(c).alias(name))
    return joined.select(*out, "position").orderBy("position").drop("position")


def profile_report(profile_df: DataFrame, column: str) -> DataFrame:
    """Human-readable view of one column: (statistic, value) rows in the fixed order."""
    row = profile_df.where(F.col("column") == column)
    pairs = [F.struct(F.lit(s).alias("statistic"), F.col(s).cast("string").alias("value")) for s in STAT_ORDER]
    return row.select(F.inline(F.array(*pairs)))


def top_values(df: DataFrame, cols: list[str], k: int = 25, buckets: int | None = None,
               include_missing: bool = False) -> DataFrame:
    """The ``k`` most frequent values of every column: (column, value, count, rank).

    Ties are broken by value. Two-stage top-k: a first window keeps the best
    ``k`` per (column, hash bucket of the value), so no task ever sorts a whole
    high-cardinality column; the second window ranks at most buckets x k rows.
    """
    long = _long(df, cols, "string")
    if not include_missing:
        long = long.where(not_missing("value", "cat"))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window

    nb = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [F.col("count").desc(), F.col("value").asc_nulls_first()]
    stage = counts.withColumn("_bk", F.pmod(F.xxhash64("value"), F.lit(nb)))
    stage = stage.withColumn("_r", F.row_number().over(Window.partitionBy("column", "_bk").orderBy(*order)))
    stage = stage.where(F.col("_r") <= k).drop("_r", "_bk")
    ranked = stage.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def histogram_adaptive(df: DataFrame, cols: list[str], n_bins: int = 25) -> DataFrame:
    """Adaptive histogram per numeric column: (column, bin centre, count), at most ``n_bins`` rows each.

    Bins come from Spark's mergeable streaming histogram; their placement depends
    on merge order, so bins are not bit-reproducible across partitionings.
    """
    long = _long(df, cols, "double").where(not_missing("value", "num"))
    h = long.groupBy("column").agg(F.histogram_numeric("value", F.lit(n_bins)).alias("_h"))
    return h.select("column", F.inline("_h")).select(
        "column", F.col("x").cast("double").alias("bin"), F.col("y").cast("double").alias("count"))


def _equal_width(long: DataFrame, n_bins: int, weight: Column) -> DataFrame:
    rng = long.groupBy("column").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    # one row per column: a bounded broadcast
    j = long.join(F.broadcast(rng), "column")
    width = F.col("_hi") - F.col("_lo")
    pos = F.try_divide(F.col("value") - F.col("_lo"), width) * F.lit(float(n_bins))
    bucket = F.least(F.coalesce(F.floor(pos), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    agg = j.groupBy("column", bucket.alias("bucket")).agg(
        F.sum(weight).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(n_bins))
    return agg.select("column", "bucket",
                      (F.col("_lo") + F.col("bucket") * step).alias("lo"),
                      (F.col("_lo") + (F.col("bucket") + 1) * step).alias("hi"),
                      "count")


def histogram_equal_width(df: DataFrame, cols: list[str], n_bins: int = 10) -> DataFrame:
    """Equal-width histogram of the rows: (column, bucket, lo, hi, count); reproducible."""
    long = _long(df, cols, "double").where(not_missing("value", "num"))
    return _equal_width(long, n_bins, F.lit(1)).withColumn("count", F.col("count").cast("long"))


def rebin_histogram(hist: DataFrame, n_bins: int = 10) -> DataFrame:
    """Re-bin (column, bin, count) into ``n_bins`` equal-width bins weighted by count."""
    long = hist.select("column", F.col("bin").alias("value"), "count")
    return _equal_width(long.withColumnRenamed("count", "_w"), n_bins, F.col("_w"))
