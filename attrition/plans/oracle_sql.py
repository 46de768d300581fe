"""DuckDB SQL building blocks for the oracle side of the registered queries.

The derived attrition tables are written as CTEs over the driver's
pre-registered views, so every oracle statement is self-contained.
"""

from __future__ import annotations

from ..functions.expressions import tie_round_sql
from ..schema import DRIVER_NAMES, FULL_FEATURES

# Feature columns of the derived usage panel, in panel order.
PANEL_FEATURES = FULL_FEATURES

# (measure, condition on a line item) of the inactive days
_KINDS = [
    (f"{what}{to}", " and ".join(c for c in (cond, flag) if c))
    for what, cond in (("calls_outgoing", ""), ("sms_outgoing", "l_linestatus = 'F'"))
    for to, flag in (("", ""), ("_to_onnet", "l_returnflag = 'N'"), ("_to_offnet", "l_returnflag = 'A'"),
                     ("_to_abroad", "l_returnflag = 'R'"))
] + [("gprs", "l_quantity >= 45")]


def _gap_columns() -> str:
    """Gaps between the distinct active days of a month, its two ends included: the longest one per measure."""
    return ", ".join(f"max(gap) filter (where kind = '{name}') as {name}_inactive_days" for name, _ in _KINDS)


def _latest_columns() -> str:
    out = []
    for name, cond in _KINDS:
        if name == "gprs":
            value, label = "l_quantity", "gprs_usage"
        elif name.startswith("calls"):
            value, label = "l_quantity", f"{name}_duration"
        else:
            value, label = "cast(1 as double)", f"{name}_count"
        where = f" filter (where {cond})" if cond else ""
        out.append(f"coalesce(sum({value}){where}, cast(0 as double)) as last_100_{label}")
    return ", ".join(out)


def _active_days() -> str:
    return " union ".join(
        f"select '{name}' as kind, user_account_id, year, month, day(d) as day from o join lineitem "
        f"on l_orderkey = o_orderkey{' where ' + cond if cond else ''}" for name, cond in _KINDS)


PANEL_CTE = f"""usage_panel as (
with o as (
  select o_orderkey, o_custkey as user_account_id,
         cast(year(o_orderdate) as bigint) as year, cast(month(o_orderdate) as bigint) as month,
         cast(o_orderdate as date) as d, o_orderdate as at, o_totalprice, o_orderstatus
  from orders where o_orderdate < timestamp '2000-08-01 00:00:00'),
r as (
  select user_account_id, year, month,
         cast(day(last_day(max(d))) - day(max(d)) as double) as reloads_inactive_days,
         cast(count(*) as double) as reloads_count, sum(o_totalprice) as reloads_sum,
         cast(count(*) filter (where o_orderstatus = 'P') as double) as last_100_reloads_count,
         coalesce(sum(o_totalprice) filter (where o_orderstatus = 'P'), 0) as last_100_reloads_sum
  from o group by user_account_id, year, month),
c as (
  select user_account_id, year, month,
         cast(count(*) as double) as calls_outgoing_count,
         sum(l_extendedprice) as calls_outgoing_spendings,
         sum(l_quantity) as calls_outgoing_duration,
         max(l_extendedprice) as calls_outgoing_spendings_max,
         max(l_quantity) as calls_outgoing_duration_max,
         cast(count(*) filter (where l_returnflag = 'N') as double) as calls_outgoing_to_onnet_count,
         sum(l_extendedprice) filter (where l_returnflag = 'N') as calls_outgoing_to_onnet_spendings,
         sum(l_quantity) filter (where l_returnflag = 'N') as calls_outgoing_to_onnet_duration,
         cast(count(*) filter (where l_returnflag = 'A') as double) as calls_outgoing_to_offnet_count,
         sum(l_extendedprice) filter (where l_returnflag = 'A') as calls_outgoing_to_offnet_spendings,
         sum(l_quantity) filter (where l_returnflag = 'A') as calls_outgoing_to_offnet_duration,
         cast(count(*) filter (where l_returnflag = 'R') as double) as calls_outgoing_to_abroad_count,
         sum(l_extendedprice) filter (where l_returnflag = 'R') as calls_outgoing_to_abroad_spendings,
         sum(l_quantity) filter (where l_returnflag = 'R') as calls_outgoing_to_abroad_duration,
         cast(count(*) filter (where l_linestatus = 'F') as double) as sms_outgoing_count,
         sum(l_extendedprice * l_tax) filter (where l_linestatus = 'F') as sms_outgoing_spendings,
         max(l_extendedprice * l_tax) filter (where l_linestatus = 'F') as sms_outgoing_spendings_max,
         cast(count(*) filter (where l_linestatus = 'F' and l_returnflag = 'N') as double) as sms_outgoing_to_onnet_count,
         sum(l_extendedprice * l_tax) filter (where l_linestatus = 'F' and l_returnflag = 'N') as sms_outgoing_to_onnet_spendings,
         cast(count(*) filter (where l_linestatus = 'F' and l_returnflag = 'A') as double) as sms_outgoing_to_offnet_count,
         sum(l_extendedprice * l_tax) filter (where l_linestatus = 'F' and l_returnflag = 'A') as sms_outgoing_to_offnet_spendings,
         cast(count(*) filter (where l_linestatus = 'F' and l_returnflag = 'R') as double) as sms_outgoing_to_abroad_count,
         sum(l_extendedprice * l_tax) filter (where l_linestatus = 'F' and l_returnflag = 'R') as sms_outgoing_to_abroad_spendings,
         cast(count(*) filter (where l_linestatus = 'O') as double) as sms_incoming_count,
         sum(l_extendedprice * l_tax) filter (where l_linestatus = 'O') as sms_incoming_spendings,
         cast(count(*) filter (where l_linestatus = 'O' and l_returnflag = 'R') as double) as sms_incoming_from_abroad_count,
         sum(l_extendedprice * l_tax) filter (where l_linestatus = 'O' and l_returnflag = 'R') as sms_incoming_from_abroad_spendings,
         cast(count(*) filter (where l_quantity >= 45) as double) as gprs_session_count,
         sum(l_quantity) filter (where l_quantity >= 45) as gprs_usage,
         sum(l_extendedprice) filter (where l_quantity >= 45) as gprs_spendings
  from o join lineitem on l_orderkey = o_orderkey group by user_account_id, year, month),
cu as (select c_custkey as user_account_id, c_acctbal as user_account_balance_last from customer),
m as (select user_account_id, year, month, last_day(max(d)) as last, min(min(d)) over (partition by user_account_id) as since,
             min(d) as d from o group by user_account_id, year, month),
marks as (select kind, user_account_id, year, month, day from ({_active_days()}) z
          union select kind, user_account_id, year, month, edge from m, (select unnest([{', '.join(f"'{n}'" for n, _ in _KINDS)}]) as kind) k,
                (select unnest([0, 1]) as side) s, lateral (select case when side = 0 then 0 else day(last) + 1 end as edge) e),
gaps as (select kind, user_account_id, year, month,
                lead(day) over (partition by kind, user_account_id, year, month order by day) - day - 1 as gap from marks),
g as (select user_account_id, year, month, {_gap_columns()} from (select * replace (cast(gap as double) as gap) from gaps) z
      group by user_account_id, year, month),
past as (select m.user_account_id, m.year, m.month, m.last, o.d, l.*,
                row_number() over (partition by m.user_account_id, m.year, m.month
                                   order by o.at desc, o_orderkey desc, l_linenumber desc, l_quantity desc,
                                            l_returnflag desc, l_linestatus desc) as place
         from m join o on o.user_account_id = m.user_account_id and o.d <= m.last join lineitem l on l_orderkey = o_orderkey),
l100 as (select user_account_id, year, month, {_latest_columns()},
                cast(max(last) - max(d) as double) as user_no_outgoing_activity_in_days
         from past where place <= 100 group by user_account_id, year, month)
select * replace ({', '.join(f"coalesce({c}, 0.0) as {c}" for c in FULL_FEATURES if c.startswith('last_100_') and 'reloads' not in c)}),
       coalesce(calls_outgoing_spendings, 0.0) + coalesce(sms_outgoing_spendings, 0.0) + coalesce(gprs_spendings, 0.0) as user_spendings,
       cast(case when m.d = m.since then 1 else 0 end as double) as user_intake,
       cast(case when calls_outgoing_count > 0 then 1 else 0 end as double) as user_has_outgoing_calls,
       cast(case when sms_outgoing_count > 0 then 1 else 0 end as double) as user_has_outgoing_sms,
       cast(case when gprs_session_count > 0 then 1 else 0 end as double) as user_use_gprs,
       cast(case when last_100_reloads_count > 0 then 1 else 0 end as double) as user_does_reload,
       cast((year - 1995) * 12 + month as double) as user_lifetime
from r join cu using (user_account_id)
left join c using (user_account_id, year, month)
join m using (user_account_id, year, month)
left join g using (user_account_id, year, month)
left join l100 using (user_account_id, year, month))"""

LABEL_CTE = """account_label as (
select p.user_account_id, cast(case when f.user_account_id is null then 1 else 0 end as int) as churn
from (select distinct o_custkey as user_account_id from orders where o_orderdate < timestamp '2000-08-01 00:00:00') p
left join (select distinct o_custkey as user_account_id from orders where o_orderdate >= timestamp '2000-08-01 00:00:00') f
on p.user_account_id = f.user_account_id)"""

MEANS_CTE = ("account_means as (select user_account_id, "
             + ", ".join(f"avg({c}) as {c}" for c in PANEL_FEATURES)
             + " from usage_panel group by user_account_id)")

TABLE_CTE = ("account_table as (select m.*, l.churn from account_means m "
             "join account_label l using (user_account_id))")


def _clean(expr: str) -> str:
    """+inf -> NaN -> 0 and null -> 0, as the exploratory frame does."""
    return (f"coalesce(case when isnan({expr}) or {expr} = 'infinity'::double then null "
            f"else {expr} end, 0.0)")


EXPLORE_CTE = ("explore as (select p.user_account_id, count(p.month) as Totalmonths, "
               + ", ".join(f"{_clean(f'avg(case when isnan(p.{c}) then null else p.{c} end)')} as {c}"
                           for c in PANEL_FEATURES)
               + f", {_clean('avg(cast(l.churn as double))')} as Churn"
               + " from usage_panel p left join account_label l using (user_account_id)"
               + " where p.user_account_id is not null group by p.user_account_id)")

SCORED_CTE = f"""scored as (
select user_account_id,
  round(least(greatest(cast(0.4871 as double)
      + cast(0.0103729 as double) * (coalesce(reloads_inactive_days, 0.0) - cast(14 as double))
      - cast(0.0513713 as double) * (coalesce(reloads_count, 0.0) - cast(1 as double)), 0.0), 1.0), 4)
      as logistic_regression_probability,
  cast(round(least(greatest(cast(0.4871 as double)
      + cast(0.0103729 as double) * (coalesce(reloads_inactive_days, 0.0) - cast(14 as double))
      - cast(0.0513713 as double) * (coalesce(reloads_count, 0.0) - cast(1 as double)), 0.0), 1.0), 4) >= 0.5 as int)
      as prediction_logistic_regression,
  {', '.join(f'coalesce({c}, 0.0) as {c}' for c in DRIVER_NAMES)}
from account_means)"""

_CTES = {
    "usage_panel": (PANEL_CTE, ()),
    "account_label": (LABEL_CTE, ()),
    "account_means": (MEANS_CTE, ("usage_panel",)),
    "account_table": (TABLE_CTE, ("account_means", "account_label")),
    "explore": (EXPLORE_CTE, ("usage_panel", "account_label")),
    "scored": (SCORED_CTE, ("account_means",)),
}


def with_ctes(body: str, *names: str, extra: list[str] = ()) -> str:
    """``with <needed CTEs in dependency order>[, extra CTEs] <body>``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in _CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = [_CTES[n][0] for n in order] + list(extra)
    if not ctes:
        return body
    return "with " + ",\n".join(ctes) + "\n" + body


def r4(expr: str, digits: int = 4) -> str:
    return tie_round_sql(expr, digits)


def rounded(cols, digits: int = 4, prefix: str = "") -> str:
    """``r4(prefix.c) as c`` for every column."""
    return ", ".join(f"{r4(prefix + c, digits)} as {c}" for c in cols)
