"""Model inputs: one-hot encoding, vector assembly, standard and robust scaling."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import dlit, q
from ..functions.ranking import ranked
from ..functions.selection import exact_quantiles
from ..sources.staging import stage


def encode_features(df: DataFrame, cat_features: list[str], suffix: str = "ohe",
                    drop_last: bool = True, handle_invalid: str = "error") -> tuple[DataFrame, dict[str, list[str]]]:
    """Index each categorical by descending frequency (ties alphabetical) and one-hot encode it.

    Output column ``<col><suffix>`` (no separator). Returns the frame and, per
    encoded column, its level names without the dropped last level. With the
    default ``handle_invalid="error"`` the dropped slot is the least frequent
    level (``"keep"`` would add an invalid slot and drop that one instead).
    The fitted indexer holds every level in the driver; ``encode_levels`` does not.
    """
    if not cat_features:
        return df, {}
    idx_cols = [f"{c}_index" for c in cat_features]
    out_cols = [f"{c}{suffix}" for c in cat_features]
    indexer = StringIndexer(inputCols=list(cat_features), outputCols=idx_cols,
                            stringOrderType="frequencyDesc", handleInvalid=handle_invalid).fit(df)
    encoder = OneHotEncoder(inputCols=idx_cols, outputCols=out_cols, dropLast=drop_last,
                            handleInvalid="keep" if handle_invalid == "keep" else "error").fit(indexer.transform(df))
    encoded = encoder.transform(indexer.transform(df))
    keep_all = handle_invalid == "keep" or not drop_last
    labels = {o: list(lv if keep_all else lv[:-1]) for o, lv in zip(out_cols, indexer.labelsArray)}
    return encoded, labels


def level_index(df: DataFrame, column: str) -> DataFrame:
    """(level, index): the non-null levels numbered from 0 by descending frequency, ties by level.

    Levels are counted with partial aggregation and numbered range by range
    (prefix counts), so neither a task nor the driver holds all of them.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(
        (-F.count(F.lit(1))).alias("_rarity"))
    return ranked(counts, [], "_rarity", tiebreak=["level"]).select("level", F.col("row_index").cast("double").alias("index"))


def encode_levels(df: DataFrame, cat_features: list[str], suffix: str = "ohe", drop_last: bool = True,
                  handle_invalid: str = "error") -> tuple[DataFrame, dict[str, DataFrame]]:
    """One-hot encoding for any number of levels: sparse vectors ``<col><suffix>`` and the table of levels by column.

    Index and slots are those of ``encode_features``, with the level table as a
    joined (level, index) frame. Spark broadcasts it only below its size
    threshold; the driver holds no level. A null level is an error as soon as a row is
    read, or with ``handle_invalid="keep"`` a slot of its own behind the levels.
    """
    tables: dict[str, DataFrame] = {}
    out = df
    for c in cat_features:
        tables[f"{c}{suffix}"] = levels = stage(level_index(df, c), "levels")
        named = levels.select(F.col("level").alias(f"_l_{c}"), F.col("index").alias(f"{c}_index"))
        out = out.join(named, F.col(c).cast("string") == F.col(f"_l_{c}"), "left").drop(f"_l_{c}")
    encoder = OneHotEncoder(inputCols=[f"{c}_index" for c in cat_features], outputCols=list(tables), dropLast=drop_last,
                            handleInvalid=handle_invalid)
    if handle_invalid == "keep":  # the slot behind the levels
        sizes = {c: tables[f"{c}{suffix}"].count() for c in cat_features}
        out = out.withColumns({f"{c}_index": F.coalesce(f"{c}_index", F.lit(float(n))) for c, n in sizes.items()})
    else:
        failure = F.raise_error(F.lit("a categorical holds a null level")).cast("double")
        out = out.withColumns({f"{c}_index": F.coalesce(f"{c}_index", failure) for c in cat_features})
    return (encoder.fit(out).transform(out) if cat_features else out), tables


def level_table(df: DataFrame, column: str, drop_last: bool = True) -> DataFrame:
    """(level, index, slot, count) of a categorical: slot is the one-hot position, null for the dropped level."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(
        F.count(F.lit(1)).alias("count"))
    numbered = ranked(counts.withColumn("_rarity", -F.col("count")), [], "_rarity", tiebreak=["level"])
    index = F.col("row_index").cast("int")
    kept = F.lit(not drop_last) | (F.col("row_index") < F.col("group_size") - 1)
    return numbered.select("level", index.alias("index"), F.when(kept, index).alias("slot"), "count")


def assemble_features(df: DataFrame, num_features: list[str], cat_features: list[str] = (),
                      output_col: str = "features", handle_invalid: str = "error") -> DataFrame:
    """Numeric columns and encoded categoricals into one vector (run the fill step first)."""
    return VectorAssembler(inputCols=[*num_features, *cat_features], outputCol=output_col,
                           handleInvalid=handle_invalid).transform(df)


class StandardScalerColumns:
    """Zero mean, unit sample standard deviation, column by column (constant column -> 0)."""

    def __init__(self, cols: list[str]):
        self.cols = list(cols)
        self.means: dict[str, float] = {}
        self.stds: dict[str, float] = {}

    def fit(self, df: DataFrame) -> StandardScalerColumns:
        aggs = []
        for c in self.cols:
            aggs += [F.expr(f"avg(CAST({q(c)} AS DOUBLE)) AS `m_{c}`"),
                     F.expr(f"stddev_samp(CAST({q(c)} AS DOUBLE)) AS `s_{c}`")]
        row = df.agg(*aggs).first()  # 2 x d numbers
        self.means = {c: row[f"m_{c}"] for c in self.cols}
        self.stds = {c: row[f"s_{c}"] for c in self.cols}
        return self

    def expressions(self) -> dict[str, str]:
        out = {}
        for c in self.cols:
            m, s = self.means[c], self.stds[c]
            if m is None or s is None or s == 0:
                out[c] = "0D"
            else:
                out[c] = f"coalesce(try_divide(CAST({q(c)} AS DOUBLE) - {dlit(m)}, {dlit(s)}), 0D)"
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.expr(e) for c, e in self.expressions().items()})


class RobustScalerColumns:
    """``(x - median) / IQR`` with the median and IQR of a reference subset (exact, interpolated).

    IQR 0 gives null (no finite scale exists).
    """

    def __init__(self, cols: list[str]):
        self.cols = list(cols)
        self.median: dict[str, float] = {}
        self.iqr: dict[str, float] = {}

    def fit(self, reference: DataFrame) -> RobustScalerColumns:
        long = reference.select(*[F.col(c).cast("double").alias(c) for c in self.cols]).unpivot(
            [], self.cols, "driver", "value")
        stats = exact_quantiles(long, ["driver"], "value", {"q1": 0.25, "med": 0.5, "q3": 0.75})
        for r in stats.collect():  # one row per column
            self.median[r["driver"]] = r["med"]
            self.iqr[r["driver"]] = None if r["q1"] is None else r["q3"] - r["q1"]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c in self.cols:
            m, i = self.median.get(c), self.iqr.get(c)
            exprs[c] = F.expr("CAST(NULL AS DOUBLE)" if m is None or not i else
                              f"try_divide(CAST({q(c)} AS DOUBLE) - {dlit(m)}, {dlit(i)})")
        return df.withColumns(exprs)
