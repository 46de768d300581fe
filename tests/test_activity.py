"""Latest-event lists, inactive days and the 62-feature panel against brute force and DuckDB."""

import calendar
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from attrition.operators import activity as A
from attrition.plans.inputs import Inputs, finish
from attrition.plans.oracle_sql import rounded, with_ctes
from attrition.schema import FULL_FEATURES, INDICATORS
from attrition.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [1, 3, 100])
def test_latest_per_group_keeps_the_last_rows(spark, k):
    rng = random.Random(k)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([*range(40), None]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, at int, id int").repartition(7)
    got = {r.g: sorted(x.id for x in r.latest) for r in A.latest_per_group(df, ["g"], ["at", "id"], k, ["id"]).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]), reverse=True)
        want[g] = sorted(r[2] for r in mine[:k])
    assert got == want


def test_rank_limit_runs_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id")
    plan = A.latest_per_group(df, ["g"], ["id"], 5, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.rindex("Partial")


def test_running_latest_merges_periods(spark):
    rng = random.Random(2)
    rows = [(g, m, [(rng.randint(0, 99), f"{g}{m}{j}") for j in range(rng.randint(0, 6))] if rng.random() < 0.8 else None)
            for g in "xy" for m in range(8)]
    df = spark.createDataFrame(rows, "g string, m int, l array<struct<at:int,v:string>>")
    out = A.running_latest(df, ["g"], ["m"], "l", 4, "best").collect()
    for r in out:
        seen = [e for g, m, l in rows if g == r.g and m <= r.m for e in l or []]
        assert [tuple(e) for e in r.best] == sorted(seen, reverse=True)[:4]


def test_longest_gap(spark):
    rng = random.Random(3)
    rows = [(i, dt.date(2000, month, day), rng.random() < 0.3) for i, month in enumerate([1, 2, 4, 2, 1, 12])
            for day in range(1, calendar.monthrange(2000, month)[1] + 1) if rng.random() < [0.5, 0.1, 1, 0, 0.9, 0.05][i] or day == 7]
    df = spark.createDataFrame(rows, "id int, d date, hit boolean")
    out = df.groupBy("id").agg(F.expr(f"{A.day_mask_sql('d', 'hit')} AS mask"), F.expr("day(last_day(max(d))) AS days"))
    for r in out.select("id", F.expr(A.longest_gap_sql("mask", "days")).alias("gap"), "days").collect():
        active = {d.day for i, d, hit in rows if i == r.id and hit}
        runs = [len(list(g)) for hit, g in itertools.groupby(d in active for d in range(1, r.days + 1)) if not hit]
        assert r.gap == max(runs, default=0)


def test_longest_gap_reads_up_to_two_active_days_from_their_places(spark):
    """All months with up to two active days against a loop over the days, with the binary text out of reach."""
    text = "bin("
    sql = A.longest_gap_sql("mask", "days")
    assert sql.count(text) == 1
    sql = sql.replace(text, "raise_error(")
    rows = [(sum(1 << d for d in set(days)), n) for n in (28, 31) for days in itertools.product(range(n), repeat=2)]
    rows += [(0, 30), (None, 29)]
    df = spark.createDataFrame(rows, "mask int, days int")
    for r in df.select("mask", "days", F.expr(sql).alias("gap")).collect():
        quiet = "".join("1" if (r.mask or 0) >> d & 1 else "0" for d in range(r.days)).split("1")
        assert r.gap == max(map(len, quiet))


def test_kinds_of_line_items_are_found_once(spark):
    """Every kind is compared once a line item, not once a measure."""
    df = spark.createDataFrame([(1, 50.0, 2.0, 0.5, "N", "F"), (1, None, 3.0, 0.1, None, "O"), (2, 1.0, 4.0, None, "R", None)],
                               "l_orderkey bigint, l_quantity double, l_extendedprice double, l_tax double, "
                               "l_returnflag string, l_linestatus string")
    got = fixtures.order_line_summary(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("= N)") == 1 and plan.count("= F)") == 1 and plan.count(">= 45") == 1
    a, b = got.orderBy("l_orderkey").collect()
    assert (a.n_calls, a.n_on, a.n_sms, a.n_sms_on, a.sms_spend, a.n_in, a.n_data, a.data_usage, a.missing) == (2, 1, 1, 1, 1.0, 1, 1, 50.0, 1)
    assert (b.n_calls, b.n_ab, b.spend_ab, b.n_sms, b.sms_spend, b.n_in, b.n_data, b.missing) == (1, 1, 4.0, 0, None, 0, 0, 0)


def test_panel_has_all_features_and_matches_sql(spark, duck):
    t = Inputs(spark, SF)
    assert t.panel.columns == ["user_account_id", "year", "month", *FULL_FEATURES] and len(FULL_FEATURES) == 62
    assert set(INDICATORS) - set(FULL_FEATURES) == {"user_intake_sum"}
    got = sorted(map(tuple, finish(t.panel).collect()))
    want = sorted(duck.sql(with_ctes(f"select user_account_id, year, month, {rounded(FULL_FEATURES)} from usage_panel",
                                     "usage_panel")).fetchall())
    assert len(got) == len(want) and got == want


def test_last_measures_are_cut_at_the_limit(spark):
    t = Inputs(spark, SF)
    few = fixtures.usage_panel(t.table("orders"), t.table("lineitem"), t.table("customer"), last=5)
    lines = {}
    orders = {r.o_orderkey: r for r in t.table("orders").collect()}
    for r in t.table("lineitem").collect():
        o = orders[r.l_orderkey]
        lines.setdefault(o.o_custkey, []).append((o.o_orderdate, o.o_orderkey, r.l_linenumber, r.l_quantity, r.l_returnflag, r.l_linestatus))
    for r in few.where("year >= 1999").collect():
        end = dt.datetime(r.year, r.month, calendar.monthrange(r.year, r.month)[1], 23, 59, 59, 999999)
        last = sorted((x for x in lines.get(r.user_account_id, []) if x[0] <= end), reverse=True)[:5]
        assert r.last_100_calls_outgoing_duration == pytest.approx(sum(x[3] for x in last))
        assert r.last_100_calls_outgoing_to_abroad_duration == pytest.approx(sum(x[3] for x in last if x[4] == "R"))
        assert r.last_100_sms_outgoing_to_onnet_count == sum(x[4] == "N" and x[5] == "F" for x in last)
        assert r.last_100_gprs_usage == pytest.approx(sum(x[3] for x in last if x[3] >= 45))


def test_lists_are_built_for_busy_accounts_only(spark, monkeypatch):
    """Account 1 has four line items, one without a quantity; account 2 has seven: only its lists are needed at last=5."""
    day = dt.datetime(1999, 1, 5)
    orders = [(a * 10 + m, a, "F", day + dt.timedelta(days=31 * m), 1.0, "x") for a in (1, 2) for m in range(2)]
    lines = [(o, 1, 1, n, q, 1.0, 0.0, 0.0, flag, "F") for o, items in
             {10: [(1, 3.0, "N"), (2, None, "A")], 11: [(1, 50.0, "A"), (2, 2.0, None)],
              20: [(n, float(n), "N") for n in range(1, 5)], 21: [(n, 10.0 * n, "R") for n in range(1, 4)]}.items()
             for n, q, flag in items]
    o = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz, "
                                      "o_totalprice double, o_orderpriority string")
    li = spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                                      "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string")
    cu = spark.createDataFrame([(1, 0.0), (2, 0.0)], "c_custkey bigint, c_acctbal double")
    listed, lists = [], fixtures.latest_lines

    def latest(some, *rest):
        listed.extend(r[0] for r in some.select("user_account_id").distinct().collect())
        return lists(some, *rest)

    monkeypatch.setattr(fixtures, "latest_lines", latest)
    rows = fixtures.usage_panel(o, li, cu, last=5).orderBy("user_account_id", "year", "month").collect()
    assert listed == [2]
    got = [(r.last_100_calls_outgoing_duration, r.last_100_calls_outgoing_to_onnet_duration,
            r.last_100_calls_outgoing_to_offnet_duration, r.last_100_sms_outgoing_count, r.last_100_gprs_usage) for r in rows]
    assert got == [(None, 3.0, None, 2.0, 0.0), (None, 3.0, None, 4.0, 50.0),
                   (10.0, 10.0, 0.0, 4.0, 0.0), (67.0, 7.0, 0.0, 5.0, 0.0)]
