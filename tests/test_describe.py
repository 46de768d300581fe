"""Describe, correlations, rates by level and per-class distributions against NumPy."""

import numpy as np
import pytest

from attrition.operators import describe as D
from attrition.operators import profile as PR


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(11)
    n = 200
    y = rng.integers(0, 2, n)
    a = rng.normal(size=n) + y
    b = 2 * a + rng.normal(size=n)
    rows = [(float(x1), float(x2), 1.0, float(t), float(t % 2 == 0 and x1 > 0)) for x1, x2, t in zip(a, b, y)]
    df = spark.createDataFrame(rows, "a double, b double, k double, y double, ind double")
    return df, a, b, y


def test_describe_matches_numpy(frame):
    df, a, _, _ = frame
    r = {x["column"]: x for x in D.describe_columns(df, ["a", "k"]).collect()}
    assert r["a"]["count"] == 200 and r["a"]["mean"] == pytest.approx(a.mean())
    assert r["a"]["std"] == pytest.approx(a.std(ddof=1))
    for name, p in D.QUARTILES.items():
        assert r["a"][name] == pytest.approx(np.quantile(a, p))
    assert r["k"]["std"] == 0.0


def test_correlation_lower_triangle_and_constant(frame):
    df, a, b, _ = frame
    long = {(x["a"], x["b"]): x["r"] for x in D.correlation_long(df, ["a", "b", "k"]).collect()}
    assert set(long) == {("b", "a"), ("k", "a"), ("k", "b")}
    assert long[("b", "a")] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert long[("k", "a")] is None  # constant column: no correlation
    by = D.correlation_by_class(df, ["a", "b", "y"], "y").collect()
    assert {x["slice"] for x in by} == {"all", "positive", "negative"}
    assert all(x["r"] is None for x in by if x["slice"] != "all" and "y" in (x["a"], x["b"]))


def test_rate_by_level_and_class_stats(frame):
    df, a, _, y = frame
    rates = {(x["variable"], x["value"]): x for x in D.rate_by_level(df, "y", ["ind"]).collect()}
    assert sum(x["n"] for x in rates.values()) == 200
    assert rates[("ind", 1.0)]["rate"] == 0.0
    q = {(x["y"], x["column"]): x for x in D.class_quartiles(df, ["a"], "y").collect()}
    assert q[(1.0, "a")]["p50"] == pytest.approx(np.median(a[y == 1]))
    hist = D.class_histogram(df, ["a"], "y", n_bins=10).collect()
    assert sum(x["count"] for x in hist) == 200
    dens = D.class_density(df, ["a"], "y", n_bins=20, grid_points=200).collect()
    for cls in (0.0, 1.0):
        pts = sorted((x["x"], x["density"]) for x in dens if x["y"] == cls)
        xs, ds = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        assert 0.8 < float(np.sum((xs[1:] - xs[:-1]) * (ds[1:] + ds[:-1]) / 2)) < 1.05


def test_profile_report_order(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    rep = PR.profile_report(PR.profile(df, exact=True), "x").collect()
    assert [r["statistic"] for r in rep] == list(PR.STAT_ORDER)


def test_correlation_over_pairwise_present_values(spark):
    import numpy as np
    import pandas as pd

    from attrition.operators import describe as D

    rng = np.random.default_rng(3)
    x = rng.normal(1e6, 3.0, size=(200, 3))
    x[:, 1] += x[:, 0]
    x[rng.random((200, 3)) < 0.2] = np.nan
    frame = pd.DataFrame(x, columns=list("abc")).assign(d=7.0)
    rows = [tuple(None if v != v else float(v) for v in r) for r in frame.to_numpy()]
    got = D.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double"), list("abcd"))
    want = frame.corr().to_numpy()
    assert np.allclose(got[:3, :3], want[:3, :3], atol=1e-9) and np.isnan(got[3]).all()
