"""Row filters, replacements, fills and the model-input preparation step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import in_half_open, not_missing, pos_inf_to_null


def filter_sql(df: DataFrame, predicate: str) -> DataFrame:
    """SQL-string predicate (a null comparison drops the row)."""
    return df.where(predicate)


def keep_levels(df: DataFrame, column: str, levels: Sequence, only_if_in: Sequence[str] | None = None) -> DataFrame:
    """Membership filter; skipped when ``only_if_in`` is given and does not list ``column``."""
    if only_if_in is not None and column not in only_if_in:
        return df
    return df.where(F.col(column).isin(list(levels)))


def split_half_open(df: DataFrame, column: str, lo: float, hi: float) -> tuple[DataFrame, DataFrame]:
    """(rows with lo <= c < hi, the complement)."""
    cond = in_half_open(column, lo, hi)
    return df.where(cond), df.where(~cond)


def present(df: DataFrame, column: str, kind: str) -> DataFrame:
    """One column with its present values only (num: not null/NaN; cat: not null/'')."""
    return df.select(column).where(not_missing(column, kind))


def non_missing_counts(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """One row: total rows and the number of present values of every column (one pass)."""
    return df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(not_missing(c, k)).alias(c) for c, k in kinds.items()])


def all_missing_columns(df: DataFrame, kinds: Mapping[str, str]) -> list[str]:
    """Columns without any present value (one aggregate; the result is one small row)."""
    row = non_missing_counts(df, kinds).first()
    return [c for c in kinds if row[c] == 0]


def replace_empty(df: DataFrame, cat_cols: Sequence[str], token: str = "NULL") -> DataFrame:
    """'' -> ``token`` on the categorical columns (a true null stays null)."""
    if not cat_cols:
        return df
    return df.replace("", token, subset=list(cat_cols))


def replace_pos_inf(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: pos_inf_to_null(c) for c in cols})


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """null and NaN -> 0 on ``cols`` (every numeric column when None)."""
    return df.fillna(0, subset=list(cols)) if cols is not None else df.fillna(0)


DEFAULT_FILTERS = ("profitability != 0", "status = 'a'")
DEFAULT_LEVELS = {"gender": ("M", "F")}


def prepare_data(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str] = (),
                 target_col: str | None = None, key_cols: Sequence[str] = (),
                 filters: Sequence[str] = DEFAULT_FILTERS,
                 membership: Mapping[str, Sequence] | None = DEFAULT_LEVELS) -> DataFrame:
    """Filter, replace '' by 'NULL' in categoricals, fill numeric nulls with 0, project.

    ``filters`` are SQL predicates applied in order; ``membership`` maps a
    column to the levels kept, applied only when the column is categorical
    (by default ``gender`` in M / F).
    """
    out = df
    for pred in filters:
        out = out.where(pred)
    for column, levels in (membership or {}).items():
        out = keep_levels(out, column, levels, only_if_in=cat_cols)
    out = replace_empty(out, cat_cols)
    if num_cols:
        out = out.fillna(0, subset=list(num_cols))
    cols = [*key_cols, *([target_col] if target_col else []), *num_cols, *cat_cols]
    return out.select(*cols)
