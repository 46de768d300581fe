"""Registered queries: column profiles, distinct counts, value frequencies, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as PR
from .catalogue_explore import LINE_NUMERIC, _q, _unpivot_sql
from .inputs import Inputs, finish
from .oracle_sql import PANEL_FEATURES, r4, with_ctes
from .registry import query

_NULL_D = "cast(null as double)"


def _spark_round3(expr: str) -> str:
    """Spark's round(x, 3) (half up on the shortest decimal text) in DuckDB terms."""
    return f"cast(round(cast({expr} as decimal(38, 10)), 3) as double)"


def _missing_sql(present: str, rows: str) -> str:
    return _spark_round3(f"100.0 - {present} / cast({rows} as double) * 100.0")


def _num_profile_sql(source: str, cols: list[str], dtypes: dict[str, str]) -> str:
    long = _unpivot_sql(source, cols, include_nulls=True)
    ok = "(value is not null and not isnan(value))"
    types = "case " + _q("column") + " " + " ".join(f"when '{c}' then '{dtypes[c]}'" for c in cols) + " end"
    return (
        f"select {_q('column')}, 'num' as type, {types} as dType, "
        f"{_missing_sql(f'count(*) filter (where {ok})', 'count(*)')} as missing_data_fraction, "
        f"count(distinct value) filter (where {ok}) as distinct_values, "
        f"{_spark_round3(f'count(*) filter (where {ok} and value = 0) / cast(count(*) as double) * 100.0')} "
        f"as zeros_fraction, "
        f"avg(value) filter (where {ok}) as avg, "
        f"stddev_samp(value) filter (where {ok}) / sqrt(count(*) filter (where {ok})) as stddev_of_avg, "
        f"stddev_samp(value) filter (where {ok}) as stddev, min(value) filter (where {ok}) as min, "
        f"quantile_disc(value, 0.25) filter (where {ok}) as pc25, "
        f"quantile_disc(value, 0.5) filter (where {ok}) as pc50, "
        f"quantile_disc(value, 0.75) filter (where {ok}) as pc75, "
        f"max(value) filter (where {ok}) as max "
        f"from {long} u group by {_q('column')}")


def _cat_profile_sql(source: str, cols: list[str], dtypes: dict[str, str]) -> str:
    long = _unpivot_sql(source, cols, include_nulls=True, cast="varchar")
    ok = "(value is not null and value <> '')"
    types = "case " + _q("column") + " " + " ".join(f"when '{c}' then '{dtypes[c]}'" for c in cols) + " end"
    return (
        f"select {_q('column')}, 'cat' as type, {types} as dType, "
        f"{_missing_sql(f'count(*) filter (where {ok})', 'count(*)')} as missing_data_fraction, "
        f"count(distinct value) filter (where {ok}) as distinct_values, "
        + ", ".join(f"{_NULL_D} as {n}" for n in ("zeros_fraction", "avg", "stddev_of_avg", "stddev", "min",
                                                   "pc25", "pc50", "pc75", "max"))
        + f" from {long} u group by {_q('column')}")


def _rounded_profile(inner: str, extra: str = "") -> str:
    cols = ["missing_data_fraction", "zeros_fraction", "avg", "stddev_of_avg", "stddev", "min", "pc25", "pc50",
            "pc75", "max"]
    return (f"select {extra}{_q('column')}, type, dType, distinct_values, "
            + ", ".join(f"{r4(c)} as {c}" for c in cols) + f" from ({inner}) p")


_LINE_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
               "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double"}


@query("profile_numeric", "PR1 A4 A6 A8 A9 A10 P7 P14 (exact sketches replaced by exact aggregates)",
       sql=_rounded_profile(_num_profile_sql("lineitem", LINE_NUMERIC, _LINE_TYPES)))
def q_profile_numeric(t: Inputs):
    return finish(PR.profile(t.lineitem.select(*LINE_NUMERIC), exact=True))


@query("profile_big_keys", "PR1 A7 (distinct 64-bit keys that doubles cannot tell apart)",
       sql="select 'big_key' as \"column\", count(distinct 9007199254740992 + o_orderkey) as distinct_values "
           "from orders")
def q_profile_big_keys(t: Inputs):
    keys = t.orders.select((F.lit(1 << 53) + F.col("o_orderkey")).alias("big_key"))
    return PR.profile(keys, exact=True).select("column", "distinct_values")


_CUST_CAT = {"c_name": "string", "c_mktsegment": "string"}
_DOC_CAT = {"text": "string", "lang": "string", "source": "string"}


@query("profile_categorical", "PR1 P7 P8 (string columns of customer and documents)",
       sql=(_rounded_profile(_cat_profile_sql("customer", list(_CUST_CAT), _CUST_CAT), "'customer' as tbl, ")
            + " union all "
            + _rounded_profile(_cat_profile_sql("documents", list(_DOC_CAT), _DOC_CAT), "'documents' as tbl, ")))
def q_profile_categorical(t: Inputs):
    a = PR.profile(t.customer.select(*_CUST_CAT), exact=True).withColumn("tbl", F.lit("customer"))
    b = PR.profile(t.documents.select(*_DOC_CAT), exact=True).withColumn("tbl", F.lit("documents"))
    return finish(a.unionByName(b))


_ACCOUNT_COLS = ["user_account_id", *PANEL_FEATURES, "churn"]
_ACCOUNT_TYPES = {c: "double" for c in PANEL_FEATURES} | {"user_account_id": "bigint", "churn": "int"}


@query("profile_account_table", "PR2 (profile of the whole account table)",
       sql=with_ctes(_rounded_profile(_num_profile_sql(
           "(select user_account_id, " + ", ".join(f"{r4(c)} as {c}" for c in PANEL_FEATURES)
           + ", churn from account_table) s", _ACCOUNT_COLS, _ACCOUNT_TYPES)), "account_table"))
def q_profile_account_table(t: Inputs):
    # the table as stored at 4 decimals, so that equal means compare equal in every engine
    return finish(PR.profile(finish(t.stored("account_table")), exact=True))


@query("profile_sketch", "PR1 default mode (HLL++ distinct, GK percentiles) on every lineitem column")
def q_profile_sketch(t: Inputs):
    return finish(PR.profile(t.lineitem))


_EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("approx_distinct", "A7 (HLL++ sketch per column)")
def q_approx_distinct(t: Inputs):
    long = PR._long(t.events, _EVENT_COLS, "string")
    return long.groupBy("column").agg(F.approx_count_distinct("value").alias("approx_distinct"))


@query("exact_distinct", "A3 A7 exact counterpart (two-level aggregation)",
       sql=" union all ".join(f"select '{c}' as {_q('column')}, count(distinct {c}) as distinct_values from events"
                              for c in _EVENT_COLS))
def q_exact_distinct(t: Inputs):
    long = PR._long(t.events, _EVENT_COLS, "string").where(F.col("value").isNotNull())
    return long.select("column", "value").distinct().groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"))


_TOP = {"orders": ["o_orderstatus", "o_orderpriority", "o_custkey"], "customer": ["c_mktsegment", "c_nationkey"]}


def _top_sql(k: int = 25) -> str:
    parts = []
    for tbl, cols in _TOP.items():
        for c in cols:
            parts.append(f"select '{tbl}' as tbl, '{c}' as {_q('column')}, cast({c} as varchar) as value, "
                         f"count(*) as count from {tbl} where {c} is not null and cast({c} as varchar) <> '' "
                         f"group by {c}")
    body = " union all ".join(parts)
    return (f"select * from (select *, row_number() over (partition by tbl, {_q('column')} "
            f"order by count desc, value) as rank from ({body}) z) r where rank <= {k}")


@query("top_values", "A13 O1 (top 25 values per column, ties by value)", sql=_top_sql())
def q_top_values(t: Inputs):
    parts = [PR.top_values(t.table(tbl), cols, 25).withColumn("tbl", F.lit(tbl)) for tbl, cols in _TOP.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("tbl", "column", "value", "count", F.col("rank").cast("long").alias("rank"))


_HIST_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
              "l_tax"]


@query("histogram_adaptive", "A11 (mergeable streaming histogram, 25 bins)")
def q_histogram_adaptive(t: Inputs):
    return finish(PR.histogram_adaptive(t.lineitem, _HIST_COLS, 25))


def _equal_width_sql(n_bins: int = 10) -> str:
    nb = f"cast({n_bins} as double)"
    long = _unpivot_sql("lineitem", _HIST_COLS)
    return (f"select {_q('column')}, bucket, {r4(f'_lo + bucket * ((_hi - _lo) / {nb})')} as lo, "
            f"{r4(f'_lo + (bucket + 1) * ((_hi - _lo) / {nb})')} as hi, count from ("
            f"select u.{_q('column')}, cast(least(coalesce(floor((value - _lo) / nullif(_hi - _lo, 0) * {nb}), 0), "
            f"{n_bins - 1}) as int) as bucket, count(*) as count, min(_lo) as _lo, min(_hi) as _hi "
            f"from {long} u join (select {_q('column')}, min(value) as _lo, max(value) as _hi from {long} r "
            f"where not isnan(value) group by 1) g on u.{_q('column')} = g.{_q('column')} "
            f"where not isnan(value) group by 1, 2) z")


@query("histogram_equal_width", "A12 (equal-width bins over the rows)", sql=_equal_width_sql())
def q_histogram_equal_width(t: Inputs):
    return finish(PR.histogram_equal_width(t.lineitem, _HIST_COLS, 10))


@query("histogram_rebinned", "A11 then A12 (adaptive bins re-binned to 10 equal-width bins)")
def q_histogram_rebinned(t: Inputs):
    return finish(PR.rebin_histogram(PR.histogram_adaptive(t.lineitem, _HIST_COLS, 25), 10))
