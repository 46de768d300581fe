"""Exact quantiles by rank selection: narrowing rounds, wide brackets, types, groups."""

import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.functions import selection as S

PROBS = {"p0": 0.0, "p1": 0.01, "p25": 0.25, "p50": 0.5, "p505": 0.505, "p75": 0.75, "p100": 1.0}


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [("normal", float(x)) for x in rng.normal(size=30_000)]
    rows += [("ties", float(x)) for x in rng.integers(0, 7, 20_000)]
    rows += [("skew", float(x)) for x in np.exp(rng.normal(size=10_000) * 5)]
    rows += [("one", 3.0), (None, 1.0), (None, 2.0), ("none", None), ("none", float("nan"))]
    rows += [("edge", float("inf"))] * 3 + [("edge", float("-inf"))] * 4 + [("edge", 0.0)] * 3
    return spark.createDataFrame(rows, "g string, x double").repartition(7), rows


def _values(rows, g):
    return np.array(sorted(x for k, x in rows if k == g and x is not None and x == x))


@pytest.mark.parametrize("accuracy,max_inside", [(2000, 1_000_000), (100, 1_000_000), (100, 50), (2000, 1)])
def test_against_numpy(table, accuracy, max_inside):
    df, rows = table
    lin = {r.g: r for r in S.exact_quantiles(df, ["g"], "x", PROBS, accuracy=accuracy, max_inside=max_inside).collect()}
    disc = {r.g: r for r in S.exact_quantiles(df, ["g"], "x", PROBS, method="discrete", with_distinct=True,
                                              accuracy=accuracy, max_inside=max_inside).collect()}
    assert set(lin) == set(disc) == {"normal", "ties", "skew", "one", "edge", None}
    for g in lin:
        v = _values(rows, g)
        assert disc[g].n_distinct == len(set(v))
        for name, p in PROBS.items():
            if g != "edge":
                assert lin[g][name] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)
            assert disc[g][name] == v[max(int(np.ceil(p * len(v))) - 1, 0)]


def test_a_bad_first_bracket_is_widened(table, monkeypatch):
    df, rows = table
    tried = []
    real = S._brackets

    def off(values, keys, probs, margin, accuracy, stats):
        tried.append(margin)
        return real(values, keys, [min(1.0, p + 0.2) for p in probs] if len(tried) == 1 else probs, margin, accuracy, stats)

    monkeypatch.setattr(S, "_brackets", off)
    got = {r.g: r.m for r in S.exact_quantiles(df, ["g"], "x", {"m": 0.5}, accuracy=1000).collect()}
    assert len(tried) > 1
    for g in ("normal", "ties", "skew", "one"):
        assert got[g] == pytest.approx(np.quantile(_values(rows, g), 0.5))


def test_whole_table_stats_and_empty(spark, table):
    df, rows = table
    one = S.exact_quantiles(df.where("g = 'normal'").drop("g"), [], "x", {"m": 0.5},
                            stats={"n": F.count("_v"), "rows": F.count(F.lit(1))}).collect()
    assert [(r.n, r.rows, r.m) for r in one] == [(30_000, 30_000, pytest.approx(np.median(_values(rows, "normal"))))]
    some = {r.g: (r.n, r.rows, r.m) for r in S.exact_quantiles(
        df, ["g"], "x", {"m": 0.5}, stats={"n": F.count("_v"), "rows": F.count(F.lit(1))}).collect()}
    assert some["none"] == (0, 2, None) and some[None] == (2, 2, 1.5)
    assert S.exact_quantiles(df.where("false"), ["g"], "x", {"m": 0.5}).count() == 0


def test_types_keep_their_digits(spark):
    big = 2 ** 53
    df = spark.createDataFrame([(big + i,) for i in range(5)], "x bigint")
    got = S.exact_quantiles(df, [], "x", {"m": 0.5, "t": 1.0}, method="discrete", with_distinct=True).first()
    assert (got.m, got.t, got.n_distinct) == (big + 2, big + 4, 5)
    d = spark.createDataFrame([(decimal.Decimal(i) / 100 + 10 ** 20,) for i in range(3)], "x decimal(30,2)")
    assert S.exact_quantiles(d, [], "x", {"m": 0.5}, method="discrete").first().m == 10 ** 20 + decimal.Decimal("0.01")


def test_one_group_holds_most_rows(spark):
    df = spark.range(300_000).selectExpr("CASE WHEN id % 10 < 8 THEN 'hot' ELSE cast(id % 50 AS string) END AS g",
                                         "CASE WHEN id % 3 = 0 THEN 5D ELSE cast(xxhash64(id) AS double) END AS x")
    got = {r.g: r for r in S.exact_quantiles(df, ["g"], "x", {"m": 0.5, "t": 0.9}, max_inside=100).collect()}
    for r in df.groupBy("g").agg(F.expr("percentile(x, 0.5) AS m"), F.expr("percentile(x, 0.9) AS t")).collect():
        assert (got[r.g].m, got[r.g].t) == pytest.approx((r.m, r.t), rel=1e-12)
