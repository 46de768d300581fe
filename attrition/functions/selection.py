"""Exact quantiles by rank selection: sketched brackets, one counting pass, a small sort.

1. One aggregate per group counts the values and sketches, for every wanted
   rank, a value safely below and one safely above it (a bracket).
2. One pass counts what lies between the brackets and, inside them, every
   distinct value.  Both collapse map-side: a task sends one row per gap and
   one per distinct value near a wanted rank, some thousandths of the rows at most.
3. Running counts over what is left give the values at the exact ranks.

While brackets would still hold more than ``MAX_INSIDE`` values, another pass
narrows them.  No (group, value) table of all rows is written or sorted.  The
sketches only steer: a rank that was not found inside its bracket is looked
for again in a wider one, so results are exact.

Groups are joined with their brackets by an ordinary join; Spark broadcasts
that table (one row per group) only below its size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import stage

#: Rank error of the first sketch is n / ACCURACY.
ACCURACY = 2_000
#: Values of a group that may lie inside its brackets.
MAX_INSIDE = 1_000_000

_GRID = 1_000


def _ranks(p: float, method: str) -> tuple[Column, Column, Column]:
    """0-based ranks below and above the quantile, and the weight of the upper one."""
    n = F.col("_n")
    if method == "linear":
        at = F.lit(float(p)) * (n - F.lit(1)).cast("double")
        return F.floor(at), F.ceil(at), at - F.floor(at)
    if method == "discrete":
        at = F.greatest(F.ceil(F.lit(float(p)) * n.cast("double")) - F.lit(1), F.lit(0))
        return at, at, F.lit(0.0)
    raise ValueError(method)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def _brackets(values: DataFrame, keys: list[str], probs: list[float], margin: float, accuracy: int,
              stats: dict[str, Column]) -> DataFrame:
    """(keys, _n, lo0, hi0, lo1, ..., stats) per group; a group of few values is one bracket."""
    wanted = [q for p in probs for q in (max(0.0, p - margin), min(1.0, p + margin))]
    agg = values.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.percentile_approx("_v", wanted, max(accuracy, 100)).alias("_b"), *[c.alias(name) for name, c in stats.items()])
    few = F.col("_n") <= accuracy
    out = []
    for i, p in enumerate(probs):
        # the sketch works in doubles; the ends of a group are exact
        first, last = few | F.lit(p - margin <= 0), few | F.lit(p + margin >= 1)
        out += [F.when(first, F.col("_least")).otherwise(F.col("_b")[2 * i]).alias(f"_lo{i}"),
                F.when(last, F.col("_most")).otherwise(F.col("_b")[2 * i + 1]).alias(f"_hi{i}")]
    return agg.select(*keys, "_n", *out, *stats)


def _narrower(values: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float], method: str) -> DataFrame:
    """Brackets cut down to a few thousandths of themselves, by one pass over the rows inside."""
    v = F.col("_v")
    inside = [v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(probs))]
    aggs = []
    for i, within in enumerate(inside):
        aggs += [F.count_if(v < F.col(f"_lo{i}")).alias(f"_below{i}"), F.count_if(within).alias(f"_in{i}"),
                 F.percentile_approx(F.when(within, v), [g / _GRID for g in range(_GRID + 1)], 4 * _GRID).alias(f"_g{i}")]
    counted = _null_safe(values, brackets, keys).groupBy(*keys).agg(F.first("_n").alias("_n"), *aggs)
    out = []
    for i, p in enumerate(probs):
        lower, upper, _ = _ranks(p, method)
        share = [F.try_divide((r - F.col(f"_below{i}")).cast("double"), F.col(f"_in{i}").cast("double")) * _GRID
                 for r in (lower, upper)]
        first = F.greatest(F.floor(share[0]) - 3, F.lit(0)).cast("int")
        last = F.least(F.ceil(share[1]) + 3, F.lit(_GRID)).cast("int")
        out += [F.get(f"_g{i}", first).alias(f"_lo{i}"), F.get(f"_g{i}", last).alias(f"_hi{i}")]
    return counted.select(*keys, "_n", *out)


def _select(values: DataFrame, brackets: DataFrame, keys: list[str], probs: dict[str, float], method: str) -> DataFrame:
    """(keys, quantiles); null where a rank does not lie inside its bracket."""
    v, k = F.col("_v"), len(probs)
    inside, passed = F.lit(False), F.lit(0)
    for i in range(k):
        inside = inside | v.between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
        passed = passed + (v > F.col(f"_hi{i}")).cast("int")
    counts = (_null_safe(values, brackets.select(*keys, "_n", *[f"_{s}{i}" for i in range(k) for s in ("lo", "hi")]), keys)
              .select(*keys, "_n", passed.alias("_gap"), F.when(inside, v).alias("_value"))
              .groupBy(*keys, "_n", "_gap", "_value").agg(F.count(F.lit(1)).alias("_count")))
    # what lies outside is smaller than an inside value of the same gap number
    order = Window.partitionBy(*keys).orderBy("_gap", F.col("_value").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("_upto", F.sum("_count").over(order))
    before = F.col("_upto") - F.col("_count")

    def at(rank: Column) -> Column:
        return F.max(F.when((before <= rank) & (rank < F.col("_upto")), F.col("_value")))

    ends, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        lower, upper, weight = _ranks(p, method)
        ends += [at(lower).alias(f"_l{i}"), at(upper).alias(f"_u{i}")]
        low, high = F.col(f"_l{i}").cast("double"), F.col(f"_u{i}").cast("double")
        if method == "discrete":
            out.append(F.col(f"_l{i}").alias(name))
        else:
            out.append(F.when(high.isNull(), None).when(weight == 0, low).otherwise(low + weight * (high - low)).alias(name))
    return upto.groupBy(*keys, "_n").agg(*ends).select(*keys, *out)


def exact_quantiles(df: DataFrame, group_cols, value_col: str, probs: dict[str, float], method: str = "linear",
                    with_distinct: bool = False, stats: dict[str, Column] | None = None,
                    accuracy: int = ACCURACY, max_inside: float = MAX_INSIDE) -> DataFrame:
    """Exact quantiles of a numeric column per group: one row per group, a column per name, stored.

    ``method="linear"``: position ``p (n - 1)`` interpolated between neighbours
    (R type 7, Spark ``percentile``, DuckDB ``quantile_cont``), as double.
    ``method="discrete"``: the element at 0-based index ``ceil(p n) - 1``
    (DuckDB ``quantile_disc``, an exact ``percentile_approx``), in the column's type.
    Nulls and NaN are ignored; a group without other values has no row.
    ``with_distinct`` adds ``n_distinct``, the distinct values of the group.
    ``stats``: named aggregates made by the same first pass over all rows; they
    may use ``_v``, the value or null where it is missing. Every group then has a row.
    """
    keys, names, stats = list(group_cols), list(probs), dict(stats or {})
    v = F.col(value_col)
    if isinstance(df.schema[value_col].dataType, (T.DoubleType, T.FloatType)):
        v = F.when(~F.isnan(v), v)
    every = df.withColumn("_v", v)
    slim = every.where(F.col("_v").isNotNull()).select(*keys, "_v")
    wanted = list(probs.values())
    margin = 3.0 / accuracy
    todo = stage(_brackets(every, keys, wanted, margin, accuracy, stats), "brackets")
    base = todo.select(*keys, *stats)
    largest = todo.agg(F.max("_n")).first()[0] or 0
    unknown = F.lit(False)
    for name in names:
        unknown = unknown | F.col(name).isNull()
    found = None
    while True:
        expected = largest * 2 * margin * len(wanted)
        while expected > max_inside:
            todo = stage(_narrower(slim, todo, keys, wanted, method), "brackets")
            expected *= 8 / _GRID
        got = stage(_select(slim, todo, keys, probs, method), "quantiles")
        missed = got.where(unknown)
        known = got.where(~unknown)
        found = known if found is None else found.unionByName(known)
        if missed.isEmpty():
            break
        # a sketch was off: look again, in wider brackets; in the end, in whole groups
        if margin >= 1:
            raise RuntimeError("a rank was not found among all values of its group")
        margin *= 10
        if margin >= 1:
            max_inside = float("inf")
        rest = _null_safe(slim, missed.select(*keys), keys) if keys else slim
        todo = stage(_brackets(rest, keys, wanted, margin, accuracy, {}), "brackets")
    out = found
    if with_distinct:
        each = slim.groupBy(*keys, "_v").agg(F.lit(1).alias("_one"))
        out = _null_safe(out, each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_distinct")), keys)
    if stats:
        out = _null_safe(base, out, keys, "left").select(*keys, *stats, *names, *(["n_distinct"] if with_distinct else []))
    return out
