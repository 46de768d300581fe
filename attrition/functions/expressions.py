"""Column expressions: everything here stays inside Spark's generated code.

All ratios go through ``try_divide`` so ANSI mode stays on and a zero
denominator becomes null instead of an error or an infinity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def q(name: str) -> str:
    """Back-quoted column name for SQL expression text."""
    return "`" + name.replace("`", "``") + "`"


def dlit(x: float) -> str:
    """SQL text of an exact double literal (the shortest repr round-trips through a string cast)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def sql(text: str, alias: str | None = None) -> Column:
    """A column from SQL expression text: one parse in the JVM instead of many small calls."""
    c = F.expr(text)
    return c.alias(alias) if alias else c


def safe_ratio(num: str | Column, den: str | Column, fill: float | None = 0.0) -> Column:
    """``num / den``; x/0, 0/0, null/x and x/null become ``fill`` (null if ``fill`` is None)."""
    r = F.try_divide(col(num).cast("double"), col(den).cast("double"))
    return r if fill is None else F.coalesce(r, F.lit(float(fill)))


def null_if_nan_sql(expr: str) -> str:
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END"


def null_if_nan(c: str | Column) -> Column:
    """NaN -> null, so that ``avg`` skips it the way a pandas mean does."""
    if isinstance(c, str):
        return sql(null_if_nan_sql(f"CAST({q(c)} AS DOUBLE)"))
    c = col(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def pos_inf_to_null(c: str | Column) -> Column:
    c = col(c)
    return F.when(c == F.lit(math.inf), F.lit(None).cast("double")).otherwise(c)


def clean_number_sql(expr: str, fill: float = 0.0) -> str:
    x = f"CAST({expr} AS DOUBLE)"
    return (f"coalesce(CASE WHEN isnan({x}) OR {x} = double('infinity') THEN NULL ELSE {x} END, "
            f"CAST({float(fill)!r} AS DOUBLE))")


def clean_number(c: str | Column, fill: float = 0.0) -> Column:
    """+inf -> NaN -> ``fill`` and null -> ``fill`` (the exploratory cleanup)."""
    if isinstance(c, str):
        return sql(clean_number_sql(q(c), fill))
    c = col(c).cast("double")
    return F.coalesce(null_if_nan(pos_inf_to_null(c)), F.lit(float(fill)))


def tie_round(c: str | Column, digits: int = 4) -> Column:
    """Round half up with a tiny upward shift, identical in Spark and DuckDB.

    ``floor(x * 10^d + 0.5001) / 10^d`` never lands on an exact half for
    decimal-looking data, so two engines whose last bits differ still agree.
    """
    if isinstance(c, str):
        scale = 10 ** digits
        return sql(f"floor({q(c)} * {scale}D + 0.5001D) / {scale}D")
    scale = float(10 ** digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5001)) / F.lit(scale)


def tie_round_sql(expr: str, digits: int = 4) -> str:
    """SQL text of :func:`tie_round` for the DuckDB oracle."""
    scale = 10 ** digits
    return f"(floor(({expr}) * {scale} + 0.5001) / cast({scale}.0 as double))"


def percent_of(part: str | Column, total: str | Column) -> Column:
    """``part / total * 100`` with a null for an empty total."""
    return F.try_divide(col(part).cast("double"), col(total).cast("double")) * F.lit(100.0)


def round_half_up(c: str | Column, digits: int) -> Column:
    return F.round(col(c), digits)


def standard_error(stddev: str | Column, n: str | Column) -> Column:
    """``stddev / sqrt(n)``: the standard deviation of the mean estimator."""
    return F.try_divide(col(stddev), F.sqrt(col(n).cast("double")))


def rate_band(rate: str | Column, warning_at: float = 10.0, danger_at: float = 20.0) -> Column:
    """Band a percentage: success below ``warning_at``, warning below ``danger_at``, else danger.

    A boundary value goes to the higher band.
    """
    r = col(rate)
    return (F.when(r.isNull(), F.lit(None).cast("string"))
            .when(r < warning_at, F.lit("success"))
            .when(r < danger_at, F.lit("warning"))
            .otherwise(F.lit("danger")))


def in_half_open(c: str | Column, lo: float, hi: float) -> Column:
    """``lo <= c < hi``."""
    c = col(c)
    return (c >= F.lit(lo)) & (c < F.lit(hi))


def key_hash(keys: list[str] | tuple[str, ...], seed: int) -> Column:
    """A number below 2^60 from the MD5 of ``seed:key:...``, the same in every engine, session and partitioning."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("null")) for c in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")


def hash_uniform(keys: list[str] | tuple[str, ...], seed: int) -> Column:
    """A number of [0, 1) in steps of a millionth from the hash of the keys."""
    return F.pmod(key_hash(keys, seed), F.lit(1_000_000)) / F.lit(1_000_000.0)


def hash_fold(keys: list[str] | tuple[str, ...], k: int, seed: int = 46) -> Column:
    """Fold id in [0, k) from the hash of the keys: deterministic and independent of the partitioning."""
    return F.pmod(key_hash(keys, seed), F.lit(k)).cast("int")


def uniform_fold(k: int, seed: int = 46) -> Column:
    """Fold id ``floor(rand(seed) * k)``; materialise it before reuse (rand is per partition)."""
    return F.floor(F.rand(seed) * F.lit(k)).cast("int")


def not_missing(c: str | Column, kind: str) -> Column:
    """Row predicate 'value present': num -> not null and not NaN; cat -> not null and not ''."""
    c = col(c)
    if kind == "num":
        return c.isNotNull() & ~F.isnan(c.cast("double"))
    if kind == "cat":
        return c.isNotNull() & (c.cast("string") != F.lit(""))
    return c.isNotNull()
