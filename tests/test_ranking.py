"""Distributed prefix sums, exact quantiles and rank AUC against NumPy brute force."""

import numpy as np
import pytest

from attrition.functions.ranking import auc_by_rank, ranked, roc_points
from attrition.functions.selection import exact_quantiles


def _brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.integers(0, 50, 501)] + [("b", float(x)) for x in rng.normal(size=64)]
    rows += [("c", 7.0)] + [("a", None), ("b", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    lin = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    disc = {r["g"]: r for r in exact_quantiles(df, ["g"], "x", probs, method="discrete").collect()}
    for g in "abc":
        vals = np.array(sorted(x for gg, x in rows if gg == g and x is not None and x == x))
        for name, p in probs.items():
            assert lin[g][name] == pytest.approx(np.quantile(vals, p), abs=1e-12)
            k = max(int(np.ceil(p * len(vals))) - 1, 0)
            assert disc[g][name] == vals[k]


def test_auc_and_roc_match_brute_force(spark):
    rng = np.random.default_rng(2)
    scores = [float(x) for x in rng.integers(0, 20, 300)]
    labels = [int(x) for x in rng.integers(0, 2, 300)]
    df = spark.createDataFrame(list(zip(scores, labels)), "s double, y int")
    got = auc_by_rank(df, "s", "y", n_buckets=4).first()
    assert got["auc"] == pytest.approx(_brute_auc(scores, labels), abs=1e-12)
    pts = {r["threshold"]: r for r in roc_points(df, "s", "y", n_buckets=3).collect()}
    for t, r in pts.items():
        assert r["tp"] == sum(1 for s, y in zip(scores, labels) if s >= t and y == 1)
        assert r["fp"] == sum(1 for s, y in zip(scores, labels) if s >= t and y == 0)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1)], "s double, y int")
    assert auc_by_rank(df, "s", "y").first()["auc"] is None


def test_ranked_is_a_permutation(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as g", "xxhash64(id) as h")
    out = ranked(df, ["g"], "h", tiebreak=["id"], n_buckets=7).collect()
    by_g = {}
    for r in out:
        by_g.setdefault(r["g"], []).append((r["h"], r["id"], r["row_index"], r["group_size"]))
    for g, items in by_g.items():
        items.sort()
        assert [i[2] for i in items] == list(range(len(items)))
        assert all(i[3] == len(items) for i in items)


def test_hot_group_and_hot_value_through_range_path(spark):
    """One group holds a third of all rows and one value a third of that group; buckets chosen automatically."""
    from attrition.functions import ranking as R

    rng = np.random.default_rng(5)
    hot = [("hot", 0.0)] * 300 + [("hot", float(x)) for x in rng.normal(size=600)]
    cold = [(f"g{i % 9}", float(x)) for i, x in enumerate(rng.normal(size=1800))]
    rows = hot + cold
    df = spark.createDataFrame(rows, "g string, x double")
    freq = R.value_counts(df, ["g"], "x")
    ps = R.prefix_sums(freq, ["g"], "x", ["_n"], rows_per_bucket=40).collect()
    for g in {"hot", "g0"}:
        mine = sorted((r["x"], r["_n_before"], r["_n_total"]) for r in ps if r["g"] == g)
        vals = np.array(sorted(x for gg, x in rows if gg == g))
        for x, before, total in mine:
            assert before == int(np.sum(vals < x)) and total == len(vals)
    q = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "x", {"m": 0.5}).collect()}
    assert q["hot"] == pytest.approx(np.quantile([x for gg, x in rows if gg == "hot"], 0.5))


def test_null_group_is_kept_on_the_range_path(spark):
    rows = [(None, float(i)) for i in range(50)] + [("a", float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, x double")
    q = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "x", {"m": 0.5}).collect()}
    assert q == {None: 24.5, "a": 14.5}


def test_more_than_256_ranges_and_100001_groups(spark):
    """Ranges are as many as asked for and hold their share; groups have no limit."""
    from attrition.functions import ranking as R

    df = spark.range(20_000).selectExpr("cast(id as double) as x", "1L as _n")
    keyed = R.ranges(df, ["x"], 400).groupBy("_b").count().collect()
    assert len(keyed) > 256 and max(r["count"] for r in keyed) < 400
    ps = R.prefix_sums(df, [], "x", ["_n"], rows_per_bucket=50)
    assert ps.where("_n_before <> x OR _n_total <> 20000").count() == 0
    many = spark.range(300_003).selectExpr("id % 100001 as g", "cast(id div 100001 as double) as x")
    q = exact_quantiles(many, ["g"], "x", {"m": 0.5})
    assert q.count() == 100_001 and q.where("m <> 1").count() == 0
