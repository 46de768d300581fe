"""Column profiler type branches, missing rules, frequencies and histograms."""

import datetime as dt
import decimal

import pytest

from attrition.operators import profile as PR

MIXED = ("l long, i int, s short, f float, d double, dec decimal(10,2), flag boolean, str string, "
         "bin binary, day date, arr array<int>, all_null double, all_empty string")


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (1, 1, 1, 1.0, 0.0, decimal.Decimal("1.50"), True, "x", bytearray(b"a"), dt.date(2020, 1, 1), [1],
         None, ""),
        (2, None, 2, 2.0, float("nan"), decimal.Decimal("2.50"), False, "", bytearray(b""), None, [2],
         None, ""),
        (3, 3, 3, None, 3.0, None, None, None, None, dt.date(2020, 1, 3), None, None, ""),
        (4, 4, 4, 4.0, 0.0, decimal.Decimal("0.00"), True, "x", bytearray(b"b"), dt.date(2020, 1, 4), [],
         None, ""),
    ]
    return spark.createDataFrame(rows, MIXED)


def test_every_type_branch(mixed):
    prof = {r["column"]: r for r in PR.profile(mixed, exact=True).collect()}
    assert [prof[c]["type"] for c in ("l", "i", "s", "f", "d", "dec")] == ["num"] * 6
    assert [prof[c]["type"] for c in ("flag", "str", "bin")] == ["cat"] * 3
    assert prof["day"]["type"] == "other" and prof["arr"]["type"] == "other"
    assert prof["i"]["missing_data_fraction"] == 25.0
    assert prof["d"]["missing_data_fraction"] == 25.0  # NaN counts as missing
    assert prof["d"]["zeros_fraction"] == 50.0  # zeros over all rows
    assert prof["str"]["missing_data_fraction"] == 50.0  # null and ''
    assert prof["str"]["distinct_values"] == 1
    assert prof["l"]["pc50"] == 2.0 and prof["l"]["min"] == 1.0 and prof["l"]["max"] == 4.0
    assert prof["str"]["avg"] is None  # numeric statistics stay empty for categoricals
    assert prof["day"]["missing_data_fraction"] == 25.0
    for c in ("all_null", "all_empty"):  # all-missing: only type and dType
        assert prof[c]["type"] in ("num", "cat") and prof[c]["missing_data_fraction"] is None


def test_sketch_mode_matches_exact_on_small_data(mixed):
    exact = {r["column"]: r for r in PR.profile(mixed, exact=True).collect()}
    sketch = {r["column"]: r for r in PR.profile(mixed).collect()}
    for c in ("l", "i", "d"):
        assert sketch[c]["distinct_values"] == exact[c]["distinct_values"]
        assert sketch[c]["pc50"] == exact[c]["pc50"]


def test_single_row_and_empty(spark):
    one = PR.profile(spark.createDataFrame([(5.0,)], "x double"), exact=True).first()
    assert one["stddev"] is None and one["avg"] == 5.0
    empty = PR.profile(spark.createDataFrame([], "x double, s string")).collect()
    assert len(empty) == 2 and all(r["avg"] is None for r in empty)


def test_top_values_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "aabbccd"] + [(None,), ("",)], "v string")
    top = PR.top_values(df, ["v"], k=2, buckets=3).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 2), ("b", 2)]


def test_histograms(spark):
    df = spark.createDataFrame([(float(x),) for x in range(10)], "x double")
    eq = {r["bucket"]: r["count"] for r in PR.histogram_equal_width(df, ["x"], 5).collect()}
    assert eq == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2}
    ad = PR.histogram_adaptive(df, ["x"], 3).collect()
    assert 1 <= len(ad) <= 3 and sum(r["count"] for r in ad) == 10
    rb = PR.rebin_histogram(PR.histogram_adaptive(df, ["x"], 10), 2).collect()
    assert sum(r["count"] for r in rb) == 10


def test_approx_distinct_within_tolerance_and_unpivot_count(spark):
    from pyspark.sql import functions as F

    df = spark.range(20000).select((F.col("id") % 7919).alias("a"), (F.col("id") * 7).alias("b"))
    long = PR._long(df, ["a", "b"], "double")
    assert long.count() == 20000 * 2  # unpivot: rows x columns
    approx = {r["column"]: r["distinct_values"] for r in PR.profile(df).collect()}
    exact = {r["column"]: r["distinct_values"] for r in PR.profile(df, exact=True).collect()}
    assert exact == {"a": 7919, "b": 20000}
    for c in ("a", "b"):
        assert abs(approx[c] - exact[c]) <= 3 * 0.05 * exact[c]  # default rsd 0.05
