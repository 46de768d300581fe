"""Registered queries: cleaning, ratios, describe, correlations, rates, class distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import describe as D
from ..operators.ratios import RATIO_NAMES, RATIO_RULES, ratio_features
from ..schema import EXPLORATORY_LABEL, INDICATORS, KEY, MONTHS_PRESENT
from .inputs import Inputs, finish
from .oracle_sql import PANEL_FEATURES, r4, with_ctes
from .registry import query

FEATS = list(PANEL_FEATURES)
EXPLORE_COLS = [MONTHS_PRESENT, *FEATS, EXPLORATORY_LABEL]
LINE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
INDICATOR_COLS = list(INDICATORS)


def _q(name: str) -> str:
    return f'"{name}"'


def _ratio_sql() -> dict[str, str]:
    raw: dict[str, str] = {}
    for name, num, den in RATIO_RULES:
        n = raw.get(num, num)
        d = raw.get(den, den)
        raw[name] = f"(({n}) / nullif({d}, 0))"
    return {name: f"coalesce({raw[name]}, 0.0)" for name in RATIO_NAMES}


def _unpivot_sql(source: str, cols: list[str], ids: list[str] = (), include_nulls: bool = False,
                 cast: str = "double") -> str:
    sel = ", ".join([*ids, *[f"cast({c} as {cast}) as {c}" for c in cols]])
    if include_nulls:
        return (f"(select * from (select {sel} from {source}) "
                f"unpivot include nulls (value for {_q('column')} in ({', '.join(cols)})))")
    return (f"(unpivot (select {sel} from {source}) on {', '.join(cols)} "
            f"into name {_q('column')} value value)")


# ---------------------------------------------------------------- cleaning / ratios

RATIO_SQL = _ratio_sql()


@query("ratio_features", "P11 P12",
       sql=with_ctes("select user_account_id, "
                     + ", ".join(f"{r4(e)} as {n}" for n, e in RATIO_SQL.items())
                     + " from explore", "explore"))
def q_ratio_features(t: Inputs):
    return finish(ratio_features(t.explore, KEY))


_CLEAN_FILTERS = ["o_totalprice != 0", "o_orderstatus = 'F'"]
_CLEAN_LEVELS = {"o_orderpriority": ["1-URGENT", "2-HIGH"]}


@query("clean_select", "M1 P4 P5 P9 P10 P1",
       sql=with_ctes(
           "select o_orderkey, o_custkey, l.churn, " + r4("coalesce(o_totalprice, 0)") + " as o_totalprice, "
           "case when o_orderpriority = '' then 'NULL' else o_orderpriority end as o_orderpriority, "
           "case when o_orderstatus = '' then 'NULL' else o_orderstatus end as o_orderstatus "
           "from orders left join account_label l on o_custkey = l.user_account_id "
           "where o_totalprice != 0 and o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')",
           "account_label"))
def q_clean_select(t: Inputs):
    lab = t.churn_labels.withColumnRenamed(KEY, "o_custkey")
    data = t.orders.join(lab, "o_custkey", "left")
    out = C.prepare_data(data, num_cols=["o_totalprice"], cat_cols=["o_orderpriority", "o_orderstatus"],
                         target_col="churn", key_cols=["o_orderkey", "o_custkey"],
                         filters=_CLEAN_FILTERS, membership=_CLEAN_LEVELS)
    return finish(out)


# ---------------------------------------------------------------- describe / correlations

_DESCRIBE_SQL = ("select " + _q("column") + ", count(*) as count, " + r4("avg(value)") + " as mean, "
                 + r4("stddev_samp(value)") + " as std, " + r4("min(value)") + " as min, "
                 + r4("quantile_cont(value, 0.25)") + " as p25, " + r4("quantile_cont(value, 0.5)") + " as p50, "
                 + r4("quantile_cont(value, 0.75)") + " as p75, " + r4("max(value)") + " as max "
                 + "from " + _unpivot_sql("lineitem", LINE_NUMERIC) + " u where not isnan(value) "
                 + "group by " + _q("column"))


@query("describe_table", "A14 (exact, interpolated quartiles)", sql=_DESCRIBE_SQL)
def q_describe_table(t: Inputs):
    return finish(D.describe_columns(t.lineitem, LINE_NUMERIC))


def _corr_sql(source_cte: str, cols: list[str], slices: dict[str, str]) -> str:
    def pos(alias: str) -> str:
        return (f"case {alias}.{_q('column')} "
                + " ".join(f"when '{c}' then {i}" for i, c in enumerate(cols)) + " end")

    parts = []
    for name, cond in slices.items():
        where = f"where {cond}" if cond else ""
        long = _unpivot_sql(f"(select * from {source_cte} {where})", cols, ids=[KEY])
        parts.append(
            f"select '{name}' as slice, x.{_q('column')} as a, y.{_q('column')} as b, corr(x.value, y.value) as _r "
            f"from {long} x join {long} y on x.{KEY} = y.{KEY} and {pos('x')} > {pos('y')} "
            f"group by 1, 2, 3")
    body = " union all ".join(parts)
    return f"select slice, a, b, {r4('case when isnan(_r) then null else _r end')} as r from ({body}) z"


_SLICES = {"all": "", "positive": f"{EXPLORATORY_LABEL} > 0", "negative": f"{EXPLORATORY_LABEL} = 0"}


@query("corr_all", "A16 A18 (account means, strict lower triangle)",
       sql=with_ctes(_corr_sql("explore", EXPLORE_COLS, {"all": ""}), "explore"))
def q_corr_all(t: Inputs):
    return finish(D.correlation_long(t.stored("explore"), EXPLORE_COLS, "all"))


_RATIO_BLOCK = [*RATIO_NAMES, EXPLORATORY_LABEL]
_RATIO_FRAME_SQL = ("ratio_frame as (select user_account_id, "
                    + ", ".join(f"{e} as {n}" for n, e in RATIO_SQL.items())
                    + f", {EXPLORATORY_LABEL} from explore)")


@query("corr_by_class", "A16 A17 A18 (ratio block: all / leaving / staying)",
       sql=with_ctes(_corr_sql("ratio_frame", _RATIO_BLOCK, _SLICES), "explore", extra=[_RATIO_FRAME_SQL]))
def q_corr_by_class(t: Inputs):
    from ..operators.ratios import add_ratio_features

    frame = add_ratio_features(t.stored("explore")).select(*_RATIO_BLOCK)
    return finish(D.correlation_by_class(frame, _RATIO_BLOCK, EXPLORATORY_LABEL))


@query("corr_by_class_raw", "A16 A17 A18 (raw features: all / leaving / staying)",
       sql=with_ctes(_corr_sql("explore", [*FEATS, EXPLORATORY_LABEL], _SLICES), "explore"))
def q_corr_by_class_raw(t: Inputs):
    return finish(D.correlation_by_class(t.stored("explore"), [*FEATS, EXPLORATORY_LABEL], EXPLORATORY_LABEL))


@query("rate_by_indicator", "R1 A19",
       sql=with_ctes(f"select variable, {r4('value')} as value, {r4('avg(Churn)')} as rate, count(*) as n from "
                     f"(unpivot (select Churn, {', '.join(INDICATOR_COLS)} from (select *, user_intake as user_intake_sum from explore)) on {', '.join(INDICATOR_COLS)} "
                     "into name variable value value) u group by variable, value", "explore"))
def q_rate_by_indicator(t: Inputs):
    frame = t.explore.withColumnRenamed("user_intake", "user_intake_sum")
    return finish(D.rate_by_level(frame, EXPLORATORY_LABEL, INDICATOR_COLS))


_CLASS_COLS = [MONTHS_PRESENT, *FEATS]


@query("class_quartiles", "A20 (exact quartiles per column and class)",
       sql=with_ctes(f"select {EXPLORATORY_LABEL}, {_q('column')}, "
                     + ", ".join(f"{r4(f'quantile_cont(value, {p})')} as {n}" for n, p in D.QUARTILES.items())
                     + " from " + _unpivot_sql("explore", _CLASS_COLS, ids=[EXPLORATORY_LABEL])
                     + f" u where not isnan(value) group by {EXPLORATORY_LABEL}, {_q('column')}", "explore"))
def q_class_quartiles(t: Inputs):
    return finish(D.class_quartiles(t.stored("explore"), _CLASS_COLS, EXPLORATORY_LABEL))


def _class_hist_sql(n_bins: int = 50) -> str:
    nb = f"cast({n_bins} as double)"
    long = _unpivot_sql("explore", _CLASS_COLS, ids=[EXPLORATORY_LABEL])
    return with_ctes(
        f"select {_q('column')}, {EXPLORATORY_LABEL}, bucket, {r4(f'_lo + bucket * ((_hi - _lo) / {nb})')} as lo, "
        f"{r4(f'_lo + (bucket + 1) * ((_hi - _lo) / {nb})')} as hi, count "
        f"from (select u.{_q('column')}, {EXPLORATORY_LABEL}, "
        f"cast(least(coalesce(floor((value - _lo) / nullif(_hi - _lo, 0) * {nb}), 0), {n_bins - 1}) as int) as bucket, "
        f"count(*) as count, min(_lo) as _lo, min(_hi) as _hi "
        f"from {long} u join (select {_q('column')}, min(value) as _lo, max(value) as _hi from {long} r "
        f"where not isnan(value) group by 1) g on u.{_q('column')} = g.{_q('column')} "
        f"where not isnan(value) group by 1, 2, 3) z", "explore")


@query("class_histogram", "A20 (equal-width histogram per column and class)", sql=_class_hist_sql())
def q_class_histogram(t: Inputs):
    return finish(D.class_histogram(t.stored("explore"), _CLASS_COLS, EXPLORATORY_LABEL))


def _class_density_sql(n_bins: int = 50, grid_points: int = 64) -> str:
    nb = f"cast({n_bins} as double)"
    long = _unpivot_sql("explore", _CLASS_COLS, ids=[EXPLORATORY_LABEL])
    lab = EXPLORATORY_LABEL
    col = _q("column")
    return with_ctes(
        f"select {col}, {lab}, {r4('x')} as x, {r4('density')} as density from ("
        f"select {col}, {lab}, g, min(_lo + g * (_hi - _lo) / cast({grid_points - 1} as double)) as x, "
        f"sum(coalesce(count * (exp(-0.5 * z * z) / nullif(_bw * sqrt(2 * pi()), 0)) / cast(_n as double), 0.0)) "
        f"as density from (select *, ((_lo + g * (_hi - _lo) / cast({grid_points - 1} as double)) "
        f"- (_lo + (bucket + 0.5) * ((_hi - _lo) / {nb}))) / nullif(_bw, 0) as z from ("
        f"select h.*, m._n, greatest(coalesce(m._sd, 0.0) * pow(cast(m._n as double), -0.2), "
        f"((_hi - _lo) / {nb}) / 2.0) as _bw, gg.g from (select u.{col}, {lab}, "
        f"cast(least(coalesce(floor((value - _lo) / nullif(_hi - _lo, 0) * {nb}), 0), {n_bins - 1}) as int) "
        f"as bucket, count(*) as count, min(_lo) as _lo, min(_hi) as _hi from {long} u join "
        f"(select {col}, min(value) as _lo, max(value) as _hi from {long} r where not isnan(value) group by 1) "
        f"rg on u.{col} = rg.{col} where not isnan(value) group by 1, 2, 3) h join "
        f"(select {col}, {lab}, count(*) as _n, stddev_samp(value) as _sd from {long} q where not isnan(value) "
        f"group by 1, 2) m on h.{col} = m.{col} and h.{lab} = m.{lab}, range(0, {grid_points}) gg(g)) a) b "
        f"group by {col}, {lab}, g) c", "explore")


@query("class_density", "A20 (Gaussian density on a grid, from the histogram)", sql=_class_density_sql())
def q_class_density(t: Inputs):
    return finish(D.class_density(t.stored("explore"), _CLASS_COLS, EXPLORATORY_LABEL))


@query("class_balance", "A15",
       sql=with_ctes("select churn, count(*) as count from account_label group by churn", "account_label"))
def q_class_balance(t: Inputs):
    return t.churn_labels.groupBy("churn").agg(F.count(F.lit(1)).alias("count"))
