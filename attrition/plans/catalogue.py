"""The registered query catalogue (one entry per operator family of the survey).

Each query reads the driver tables (or frames Spark derives from them) in
full; floating outputs are rounded with the tie-safe rule in both engines.
"""

from __future__ import annotations

from ..operators import panel as P
from ..schema import DRIVER_NAMES
from .inputs import Inputs, finish
from .oracle_sql import PANEL_FEATURES, r4, rounded, with_ctes
from .registry import query

FEATS = list(PANEL_FEATURES)

# ---------------------------------------------------------------- panel / ingest


@query("usage_panel", "fixture derivation: order/line-item join, monthly aggregate",
       sql=with_ctes(f"select user_account_id, year, month, {rounded(FEATS)} from usage_panel",
                     "usage_panel"))
def q_usage_panel(t: Inputs):
    return finish(t.panel)


@query("account_label", "fixture derivation: one aggregate over orders",
       sql=with_ctes("select user_account_id, churn from account_label", "account_label"))
def q_account_label(t: Inputs):
    return t.churn_labels


@query("account_means", "A1 P2 P3",
       sql=with_ctes(f"select user_account_id, {rounded(FEATS)} from account_means", "account_means"))
def q_account_means(t: Inputs):
    return finish(t.account_means)


@query("account_table", "A1 J1",
       sql=with_ctes(f"select user_account_id, {rounded(FEATS)}, churn from account_table",
                     "account_table"))
def q_account_table(t: Inputs):
    return finish(t.account_table)


@query("account_months_means", "A2 A3 P9 P10",
       sql=with_ctes(f"select user_account_id, Totalmonths, {rounded(FEATS)}, {rounded(['Churn'])} "
                     "from explore", "explore"))
def q_account_months_means(t: Inputs):
    return finish(t.explore)


_SPOT = FEATS


@query("account_spot_check", "A5 P4 (every account: panel re-averaged beside the stored table)",
       sql=with_ctes(
           "select a.user_account_id, "
           + ", ".join(f"{r4('a.avg_' + c)} as avg_{c}" for c in _SPOT)
           + ", " + rounded(_SPOT, prefix="t.") + ", ("
           + " and ".join(f"abs(coalesce(a.avg_{c} - t.{c}, 0.0)) <= 1e-9 * greatest(abs(coalesce(t.{c}, 0.0)), 1.0)" for c in _SPOT)
           + ") as matches from (select user_account_id, "
           + ", ".join(f"avg({c}) as avg_{c}" for c in _SPOT)
           + " from usage_panel group by user_account_id) a join account_table t using (user_account_id)",
           "usage_panel", "account_table"))
def q_account_spot_check(t: Inputs):
    panel = t.stored("panel")  # read twice
    return finish(P.spot_check_all(panel, P.account_table(panel, t.churn_labels), _SPOT))


@query("scored_accounts", "E10 stand-in: deterministic linear score",
       sql=with_ctes("select user_account_id, logistic_regression_probability, prediction_logistic_regression, "
                     + rounded(DRIVER_NAMES)
                     + " from scored", "scored"))
def q_scored_accounts(t: Inputs):
    return finish(t.scored)

