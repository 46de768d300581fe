"""Attrition ratio features: safe divisions in one projection.

Rule of the exploratory notebook: every ratio is computed with IEEE division
first and cleaned at the very end (x/0 and 0/0 -> 0). Here a zero or missing
denominator gives null through ``try_divide`` and nulls become 0 at the end;
ratios built on an earlier ratio use its value *before* the cleanup, which
agrees with the IEEE rules (x / inf = 0, x / NaN -> 0). A negative over zero
(-inf in IEEE arithmetic, left in place there) is mapped to 0 as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import q

# Fixed values: (output, numerator, denominator) in the notebook's order. The
# twelfth rule's output is overwritten by the sixteenth; it is kept here under
# the separate name "avg_amountpersms" because rule 13 reads its first meaning.
RATIO_RULES = (
    ("avg_amountpercall", "calls_outgoing_spendings", "calls_outgoing_count"),
    ("avg_durationpercall", "calls_outgoing_duration", "calls_outgoing_count"),
    ("exp_to_mean_amount", "calls_outgoing_spendings_max", "avg_amountpercall"),
    ("exp_to_mean_duration", "calls_outgoing_duration_max", "avg_durationpercall"),
    ("avg_recharge", "reloads_sum", "reloads_count"),
    ("avg_amountpercall_onnet", "calls_outgoing_to_onnet_spendings", "calls_outgoing_to_onnet_count"),
    ("avg_durationpercall_onnet", "calls_outgoing_to_onnet_duration", "calls_outgoing_to_onnet_count"),
    ("avg_amountpercall_ofnet", "calls_outgoing_to_offnet_spendings", "calls_outgoing_to_offnet_count"),
    ("avg_durationpercall_ofnet", "calls_outgoing_to_offnet_duration", "calls_outgoing_to_offnet_count"),
    ("avg_amountpercall_oc", "calls_outgoing_to_abroad_spendings", "calls_outgoing_to_abroad_count"),
    ("avg_durationpercall_oc", "calls_outgoing_to_abroad_duration", "calls_outgoing_to_abroad_count"),
    ("avg_amountpersms", "sms_outgoing_spendings", "sms_outgoing_count"),
    ("exp_mean_sms", "sms_outgoing_spendings", "avg_amountpersms"),
    ("avg_amountpersms_onnet", "sms_outgoing_to_onnet_spendings", "sms_outgoing_to_onnet_count"),
    ("avg_amountpersms_ofnet", "sms_outgoing_to_offnet_spendings", "sms_outgoing_to_offnet_count"),
    ("avg_amountpersms_oc", "sms_outgoing_to_abroad_spendings", "sms_outgoing_to_abroad_count"),
    ("avg_amountpersms_i", "sms_incoming_spendings", "sms_incoming_count"),
    ("avg_amountpersms_oc_i", "sms_incoming_from_abroad_spendings", "sms_incoming_from_abroad_count"),
    ("avg_kbpersession", "gprs_usage", "gprs_session_count"),
    ("avg_amountpersession", "gprs_spendings", "gprs_session_count"),
    ("avg_recharge_l100", "last_100_reloads_sum", "last_100_reloads_count"),
)

# Internal helper outputs that are not part of the published ratio set.
INTERNAL = frozenset({"avg_amountpersms"})

RATIO_NAMES = tuple(name for name, _, _ in RATIO_RULES if name not in INTERNAL)


def ratio_expressions(rules=RATIO_RULES) -> dict[str, str]:
    """Uncleaned ratio expressions as SQL text, earlier ratios substituted inline (null on x/0)."""
    raw: dict[str, str] = {}
    for name, num, den in rules:
        n = raw.get(num, f"CAST({q(num)} AS DOUBLE)")
        d = raw.get(den, f"CAST({q(den)} AS DOUBLE)")
        raw[name] = f"try_divide({n}, {d})"
    return raw


def add_ratio_features(df: DataFrame, rules=RATIO_RULES, keep_internal: bool = False) -> DataFrame:
    """Append the ratio columns (x/0, 0/0, x/null -> 0) in a single projection."""
    raw = ratio_expressions(rules)
    out = {name: F.expr(f"coalesce({e}, 0D)") for name, e in raw.items()
           if keep_internal or name not in INTERNAL}
    return df.withColumns(out)


def ratio_features(df: DataFrame, key: str, rules=RATIO_RULES) -> DataFrame:
    """Key plus the published ratio columns only."""
    return add_ratio_features(df, rules).select(key, *RATIO_NAMES)
