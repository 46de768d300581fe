"""Column expressions and distributed ranking helpers."""

from .expressions import (  # noqa: F401
    clean_number, hash_fold, in_half_open, not_missing, null_if_nan, percent_of,
    pos_inf_to_null, rate_band, safe_ratio, standard_error, tie_round, tie_round_sql,
    uniform_fold,
)
