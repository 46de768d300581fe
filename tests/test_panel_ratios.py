"""Account aggregation, exploratory cleanup and ratio rules on hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from attrition.operators import panel as P
from attrition.operators.ratios import RATIO_NAMES, add_ratio_features, ratio_features

USAGE = "user_account_id long, year int, month int, a double, b double"


@pytest.fixture(scope="module")
def usage_small(spark):
    rows = [
        (1, 2013, 6, 1.0, 10.0),
        (1, 2013, 7, None, 20.0),
        (1, 2013, 8, float("nan"), 30.0),
        (2, 2013, 6, float("inf"), 5.0),
        (3, 2013, 6, -float("inf"), 1.0),
        (None, 2013, 6, 7.0, 7.0),
        (4, 2013, 6, 2.0, 2.0),
    ]
    return spark.createDataFrame(rows, USAGE)


@pytest.fixture(scope="module")
def label_small(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (3, 0), (5, 1)], "user_account_id long, churn int")


def test_account_means_is_spark_avg(usage_small):
    got = {r["user_account_id"]: r for r in P.account_means(usage_small).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert math.isnan(got[1]["a"])  # Spark avg propagates NaN (the Spark path keeps that)
    assert got[1]["b"] == 20.0
    assert "year" not in P.account_means(usage_small).columns


def test_inner_join_drops_unmatched(usage_small, label_small):
    got = {r["user_account_id"]: r["churn"] for r in P.account_table(usage_small, label_small).collect()}
    assert got == {1: 1, 2: 0, 3: 0}


def test_exploratory_rules(usage_small, label_small):
    got = {r["user_account_id"]: r for r in P.account_months_means(usage_small, label_small).collect()}
    assert None not in got  # null key dropped
    assert got[1]["Totalmonths"] == 3
    assert got[1]["a"] == 1.0  # NaN skipped by the mean, null skipped
    assert got[2]["a"] == 0.0  # +inf -> NaN -> 0
    assert got[3]["a"] == -math.inf  # -inf is left alone by the exploratory rule
    assert got[4]["Churn"] == 0.0  # no label -> mean NaN -> 0
    assert got[1]["Churn"] == 1.0


def test_spot_check_all_matches(usage_small, label_small):
    table = P.account_table(usage_small, label_small)
    rows = P.spot_check_all(usage_small.where(~F.isnan("b")), table, ["b"]).collect()
    assert rows and all(r["matches"] for r in rows)
    one = P.spot_check(usage_small, 1, ["b"]).first()[0]
    assert one == 20.0


def test_safe_ratio_rules(spark):
    from attrition.operators.ratios import INTERNAL, RATIO_RULES

    produced = {name for name, _, _ in RATIO_RULES}
    inputs = sorted({c for _, n, d in RATIO_RULES for c in (n, d)} - produced)
    row = {c: 1.0 for c in inputs}
    row.update({
        "calls_outgoing_spendings": 10.0, "calls_outgoing_count": 4.0,  # ordinary
        "calls_outgoing_spendings_max": 5.0,  # chained on a ratio: 5 / (10 / 4)
        "reloads_sum": 0.0, "reloads_count": 0.0,  # 0 / 0
        "calls_outgoing_to_onnet_spendings": -3.0, "calls_outgoing_to_onnet_count": 0.0,  # -x / 0
        "gprs_usage": None, "gprs_spendings": 2.0, "gprs_session_count": None,  # null / x, x / null
        "sms_outgoing_spendings": 6.0, "sms_outgoing_count": 3.0,
    })
    df = spark.createDataFrame([tuple(row[c] for c in inputs)], ", ".join(f"{c} double" for c in inputs))
    out = add_ratio_features(df).first()
    assert out["avg_amountpercall"] == 2.5
    assert out["exp_to_mean_amount"] == 2.0
    assert out["avg_recharge"] == 0.0
    assert out["avg_amountpercall_onnet"] == 0.0
    assert out["avg_kbpersession"] == 0.0 and out["avg_amountpersession"] == 0.0
    assert out["exp_mean_sms"] == pytest.approx(3.0)  # spend / (spend / count) = count
    assert not INTERNAL & set(add_ratio_features(df).columns)
    rf = ratio_features(df.withColumn("user_account_id", F.lit(1)), "user_account_id")
    assert rf.columns == ["user_account_id", *RATIO_NAMES] and len(RATIO_NAMES) == 20
