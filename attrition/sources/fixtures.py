"""Derive the attrition inputs (usage panel, labels, scored accounts) from the order tables.

Mapping: account = customer; call = line item; on-net / off-net / abroad =
return flag N / A / R; spend = extended price; duration = quantity; month =
order month; label = 1 when a customer who ordered before the cut-off has no
order on or after it. Inactive days = longest run of days of the month without
such a call; ``last_100_*`` of calls, texts and data = over the account's last
100 line items up to the end of the month.

Plan shape (chosen for very large inputs):

* line items are first reduced to **one row per order** (partial aggregation
  before the shuffle, every measure is a count, sum or max and composes);
* orders are joined to that per-order summary on the order key (both sides
  hash-partitioned on it, no skew: order keys are unique);
* one aggregation per (account, year, month) builds every monthly measure; a
  hot account is spread over its months and combined map-side;
* the longest inactive runs come from one mergeable 31-bit mask per measure;
* as long as an account has no more than 100 line items, its last 100 are all of them: running
  sums of the monthly measures; lists are built only for accounts that get beyond that;
* there the last 100 line items are limited per order, then per (account, month), in
  every task before a shuffle; only lists of at most 100 meet along an account's months;
* the label is one aggregation over orders instead of two distincts and a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.activity import day_mask_sql, latest_per_group, longest_gap_sql, running_latest, sum_where
from ..schema import DRIVER_NAMES, FULL_FEATURES, KEY, PREDICTION_COL, SCORE_COL
from .staging import stage

CUTOFF = "2000-08-01 00:00:00"


def _cutoff(ts: str) -> Column:
    return F.lit(ts).cast("timestamp_ntz")


def _aggs(pairs: list[tuple[str, str]]) -> list[Column]:
    return [F.expr(f"{expr} AS {name}") for name, expr in pairs]


# (kind predicate over line items) for each call type
_KINDS = {"_on": "l_returnflag = 'N'", "_off": "l_returnflag = 'A'", "_ab": "l_returnflag = 'R'",
          "_sms": "l_linestatus = 'F'", "_in": "l_linestatus = 'O'", "_data": "l_quantity >= 45"}
_ON, _OFF, _AB, _SMS, _IN, _DATA = _KINDS
_SMS_AMOUNT = "_amount"


def order_line_summary(lineitem: DataFrame) -> DataFrame:
    """Per order: counts, sums and maxima of its line items by call type (one row per order)."""
    def cnt(cond: str) -> str:
        return f"count_if({cond})"

    def ssum(x: str, cond: str) -> str:
        return f"sum(CASE WHEN {cond} THEN {x} END)"

    pairs = [
        ("n_calls", "count(1)"), ("spend", "sum(l_extendedprice)"), ("dur", "sum(l_quantity)"),
        ("spend_max", "max(l_extendedprice)"), ("dur_max", "max(l_quantity)"),
    ]
    for tag, cond in (("on", _ON), ("off", _OFF), ("ab", _AB)):
        pairs += [(f"n_{tag}", cnt(cond)), (f"spend_{tag}", ssum("l_extendedprice", cond)),
                  (f"dur_{tag}", ssum("l_quantity", cond))]
    pairs += [("n_sms", cnt(_SMS)), ("sms_spend", ssum(_SMS_AMOUNT, _SMS)),
              ("sms_spend_max", f"max(CASE WHEN {_SMS} THEN {_SMS_AMOUNT} END)")]
    for tag, cond in (("on", _ON), ("off", _OFF), ("ab", _AB)):
        both = f"{_SMS} AND {cond}"
        pairs += [(f"n_sms_{tag}", cnt(both)), (f"sms_spend_{tag}", ssum(_SMS_AMOUNT, both))]
    pairs += [("n_in", cnt(_IN)), ("in_spend", ssum(_SMS_AMOUNT, _IN)),
              ("n_in_ab", cnt(f"{_IN} AND {_AB}")), ("in_spend_ab", ssum(_SMS_AMOUNT, f"{_IN} AND {_AB}")),
              ("n_data", cnt(_DATA)), ("data_usage", ssum("l_quantity", _DATA)),
              ("data_spend", ssum("l_extendedprice", _DATA))]
    # a bit per call type: a quantity is missing, which leaves the duration of the latest items unknown
    missing = " + ".join(f"CASE WHEN {cond} THEN {bit} ELSE 0 END" for bit, cond in ((1, "true"), (2, _ON), (4, _OFF), (8, _AB)))
    pairs.append(("missing", f"bit_or(CASE WHEN l_quantity IS NULL THEN {missing} ELSE 0 END)"))
    # the kinds are found once a line item; some thirty measures ask for them
    kinds = lineitem.selectExpr("l_orderkey", "l_quantity", "l_extendedprice", f"l_extendedprice * l_tax AS {_SMS_AMOUNT}",
                                *[f"{cond} AS {name}" for name, cond in _KINDS.items()])
    return kinds.groupBy("l_orderkey").agg(*_aggs(pairs))


# monthly feature -> how it combines the per-order summaries
_MONTHLY = [
    ("reloads_inactive_days", "CAST(day(last_day(max(d))) - day(max(d)) AS DOUBLE)"),
    ("reloads_count", "CAST(count(1) AS DOUBLE)"),
    ("reloads_sum", "sum(o_totalprice)"),
    ("last_100_reloads_count", "CAST(count_if(o_orderstatus = 'P') AS DOUBLE)"),
    ("last_100_reloads_sum", "coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 0D)"),
    ("calls_outgoing_count", "CAST(sum(n_calls) AS DOUBLE)"),
    ("calls_outgoing_spendings", "sum(spend)"),
    ("calls_outgoing_duration", "sum(dur)"),
    ("calls_outgoing_spendings_max", "max(spend_max)"),
    ("calls_outgoing_duration_max", "max(dur_max)"),
] + [
    row for tag, name in (("on", "onnet"), ("off", "offnet"), ("ab", "abroad")) for row in (
        (f"calls_outgoing_to_{name}_count", f"CAST(sum(n_{tag}) AS DOUBLE)"),
        (f"calls_outgoing_to_{name}_spendings", f"sum(spend_{tag})"),
        (f"calls_outgoing_to_{name}_duration", f"sum(dur_{tag})"))
] + [
    ("sms_outgoing_count", "CAST(sum(n_sms) AS DOUBLE)"),
    ("sms_outgoing_spendings", "sum(sms_spend)"),
    ("sms_outgoing_spendings_max", "max(sms_spend_max)"),
] + [
    row for tag, name in (("on", "onnet"), ("off", "offnet"), ("ab", "abroad")) for row in (
        (f"sms_outgoing_to_{name}_count", f"CAST(sum(n_sms_{tag}) AS DOUBLE)"),
        (f"sms_outgoing_to_{name}_spendings", f"sum(sms_spend_{tag})"))
] + [
    ("sms_incoming_count", "CAST(sum(n_in) AS DOUBLE)"),
    ("sms_incoming_spendings", "sum(in_spend)"),
    ("sms_incoming_from_abroad_count", "CAST(sum(n_in_ab) AS DOUBLE)"),
    ("sms_incoming_from_abroad_spendings", "sum(in_spend_ab)"),
    ("gprs_session_count", "CAST(sum(n_data) AS DOUBLE)"),
    ("gprs_usage", "sum(data_usage)"),
    ("gprs_spendings", "sum(data_spend)"),
]


# measure with inactive days -> the per-order count that says whether it occurred
_ACTIVE = {
    "calls_outgoing": "n_calls", "calls_outgoing_to_onnet": "n_on", "calls_outgoing_to_offnet": "n_off",
    "calls_outgoing_to_abroad": "n_ab", "sms_outgoing": "n_sms", "sms_outgoing_to_onnet": "n_sms_on",
    "sms_outgoing_to_offnet": "n_sms_off", "sms_outgoing_to_abroad": "n_sms_ab", "gprs": "n_data",
}

# measure over the last line items -> (value, condition) on an entry x
_LATEST = {
    "calls_outgoing_duration": ("x.l_quantity", "true"),
    "calls_outgoing_to_onnet_duration": ("x.l_quantity", "x.l_returnflag = 'N'"),
    "calls_outgoing_to_offnet_duration": ("x.l_quantity", "x.l_returnflag = 'A'"),
    "calls_outgoing_to_abroad_duration": ("x.l_quantity", "x.l_returnflag = 'R'"),
    "sms_outgoing_count": ("1D", "x.l_linestatus = 'F'"),
    "sms_outgoing_to_onnet_count": ("1D", "x.l_linestatus = 'F' AND x.l_returnflag = 'N'"),
    "sms_outgoing_to_offnet_count": ("1D", "x.l_linestatus = 'F' AND x.l_returnflag = 'A'"),
    "sms_outgoing_to_abroad_count": ("1D", "x.l_linestatus = 'F' AND x.l_returnflag = 'R'"),
    "gprs_usage": ("x.l_quantity", "x.l_quantity >= 45"),
}

# the same measures while the last line items are all of them: (monthly measure, its bit in ``missing``)
_ALL_SO_FAR = {
    "calls_outgoing_duration": 1, "calls_outgoing_to_onnet_duration": 2, "calls_outgoing_to_offnet_duration": 4,
    "calls_outgoing_to_abroad_duration": 8, "sms_outgoing_count": 0, "sms_outgoing_to_onnet_count": 0,
    "sms_outgoing_to_offnet_count": 0, "sms_outgoing_to_abroad_count": 0, "gprs_usage": 0,
}

_LINE = ["l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]


def latest_lines(orders: DataFrame, lineitem: DataFrame, last: int) -> DataFrame:
    """(account, year, month, lines): the month's last ``last`` line items by order time, order and line number."""
    per_order = latest_per_group(lineitem, ["l_orderkey"], _LINE, last, _LINE, "lines")
    timed = orders.join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    month = latest_per_group(timed, [KEY, "year", "month"], ["at", "o_orderkey"], last, ["at", "o_orderkey", "lines"], "orders")
    stamped = F.flatten(F.transform("orders", lambda o: F.transform(o["lines"], lambda x: F.struct(
        o["at"].alias("at"), o["o_orderkey"].alias("o_orderkey"), *[x[c].alias(c) for c in _LINE]))))
    return month.select(KEY, "year", "month", F.slice(F.sort_array(stamped, asc=False), 1, last).alias("lines"))


def orders_of_busy_accounts(orders: DataFrame, lineitem: DataFrame, last: int) -> DataFrame:
    """The orders (key, account, month, time) of accounts with more than ``last`` line items, stored.

    A stored table has a known size: Spark broadcasts it, below its threshold, to pick the line items.
    """
    sizes = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("_lines"))
    busy = orders.join(sizes, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(KEY).agg(
        F.sum("_lines").alias("_lines")).where(F.col("_lines") > last)
    busy = stage(busy.select(KEY), "busy_accounts")
    return stage(orders.select("o_orderkey", KEY, "year", "month", "at").join(busy, KEY, "left_semi"), "busy_orders")


def usage_panel(orders: DataFrame, lineitem: DataFrame, customer: DataFrame,
                cutoff: str = CUTOFF, last: int = 100) -> DataFrame:
    """Monthly usage panel: one row per (account, year, month) with the 62 features of ``FULL_FEATURES``.

    Months without line items keep null call/SMS/data measures (a left join),
    exactly like a month with reloads but no usage; such a month is
    inactive on all its days.
    """
    o = orders.where(F.col("o_orderdate") < _cutoff(cutoff)).selectExpr(
        "o_orderkey", f"o_custkey AS {KEY}",
        "CAST(year(o_orderdate) AS BIGINT) AS year", "CAST(month(o_orderdate) AS BIGINT) AS month",
        "CAST(o_orderdate AS DATE) AS d", "o_orderdate AS at", "o_totalprice", "o_orderstatus")
    lines = order_line_summary(lineitem)
    joined = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left")
    masks = [(f"_mask_{name}", day_mask_sql("d", f"{n} > 0")) for name, n in _ACTIVE.items()]
    monthly = joined.groupBy(KEY, "year", "month").agg(*_aggs(
        [*_MONTHLY, *masks, ("_missing", "bit_or(missing)"), ("_days", "day(last_day(max(d)))"), ("_end", "last_day(max(d))"),
         ("_active", "max(CASE WHEN n_calls > 0 THEN d END)")]))
    busy = orders_of_busy_accounts(o, lineitem, last)
    theirs = lineitem.join(busy.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    monthly = monthly.join(latest_lines(busy, theirs, last), [KEY, "year", "month"], "left")
    # windows over the months of an account: as many rows as the calendar has months
    months = Window.partitionBy(KEY).orderBy("year", "month")
    monthly = running_latest(monthly, [KEY], ["year", "month"], "lines", last, "_latest")
    so_far = months.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    monthly = monthly.withColumns({
        "_last_active": F.max("_active").over(so_far), "_first": F.row_number().over(months) == 1,
        "_lines": F.coalesce(F.sum("calls_outgoing_count").over(so_far), F.lit(0.0)),
        "_missing": F.coalesce(F.bit_or("_missing").over(so_far), F.lit(0)),
        **{f"_all_{name}": F.coalesce(F.sum(name).over(so_far), F.lit(0.0)) for name in _ALL_SO_FAR}})
    cu = customer.selectExpr(f"c_custkey AS {KEY}", "c_acctbal AS user_account_balance_last")
    panel = monthly.join(cu, KEY, "inner")

    def flag(c: str, name: str) -> str:
        return f"CASE WHEN {c} > 0 THEN 1D ELSE 0D END AS {name}"

    spent = " + ".join(f"coalesce({c}, 0D)" for c in
                       ("calls_outgoing_spendings", "sms_outgoing_spendings", "gprs_spendings"))
    made = {
        "user_has_outgoing_calls": flag("calls_outgoing_count", "user_has_outgoing_calls"),
        "user_has_outgoing_sms": flag("sms_outgoing_count", "user_has_outgoing_sms"),
        "user_use_gprs": flag("gprs_session_count", "user_use_gprs"),
        "user_does_reload": flag("last_100_reloads_count", "user_does_reload"),
        "user_lifetime": "CAST((year - 1995) * 12 + month AS DOUBLE) AS user_lifetime",
        "user_intake": "CASE WHEN _first THEN 1D ELSE 0D END AS user_intake",
        "user_spendings": f"{spent} AS user_spendings",
        "user_no_outgoing_activity_in_days":
            "CAST(datediff(_end, _last_active) AS DOUBLE) AS user_no_outgoing_activity_in_days",
    }
    made |= {f"{name}_inactive_days": f"CAST({longest_gap_sql(f'_mask_{name}', '_days')} AS DOUBLE) AS {name}_inactive_days"
             for name in _ACTIVE}
    made |= {f"last_100_{name}": f"CASE WHEN _lines > {last} THEN {sum_where('_latest', value, condition)} "
                                 f"WHEN _missing & {_ALL_SO_FAR[name]} = 0 THEN _all_{name} END AS last_100_{name}"
             for name, (value, condition) in _LATEST.items()}
    return panel.selectExpr(KEY, "year", "month", *[made.get(c, c) for c in FULL_FEATURES])


def account_label(orders: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    """(account, churn): churn = 1 when an account with orders before ``cutoff`` has none from it on."""
    ts = F.col("o_orderdate")
    per = orders.groupBy(F.col("o_custkey").alias(KEY)).agg(
        F.count_if(ts < _cutoff(cutoff)).alias("n_before"),
        F.count_if(ts >= _cutoff(cutoff)).alias("n_after"))
    return per.where(F.col("n_before") > 0).select(
        KEY, (F.col("n_after") == 0).cast("int").alias("churn"))


def scored_accounts(account_means: DataFrame) -> DataFrame:
    """Deterministic stand-in for a scored account table (probability, 0/1 prediction, drivers).

    ``score = 0.4871 + 0.0103729 (reloads_inactive_days - 14) - 0.0513713 (reloads_count - 1)``
    on the account means (null -> 0), clipped to [0, 1] and rounded to 4 decimals.
    """
    def z(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    raw = (F.lit(0.4871) + F.lit(0.0103729) * (z("reloads_inactive_days") - F.lit(14.0))
           - F.lit(0.0513713) * (z("reloads_count") - F.lit(1.0)))
    score = F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4)
    return account_means.select(
        KEY, score.alias(SCORE_COL),
        (score >= F.lit(0.5)).cast("int").alias(PREDICTION_COL),
        *[z(c).alias(c) for c in DRIVER_NAMES])
