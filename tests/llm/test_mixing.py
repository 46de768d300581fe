import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from attrition.llm import mixing as M


def test_targets_are_a_fixed_point():
    sizes, weights = [100, 5, 0, 400, 40], [1.0, 2.0, 3.0, 1.0, 2.0]
    out = M.targets(sizes, weights, 3)
    assert out[1] == 15 and out[2] == 0 and out[4] == 120
    assert out[0] == out[3] == pytest.approx((545 - 135) / 2)
    assert M.targets([], [], 3) == [] and M.targets([0, 0], [1, 2], 3) == [0, 0]


def test_tree_uses_up_the_quotas():
    quotas = np.array([1000, 1, 0, 37, 512])
    for shards in (1, 2, 7, 16):
        counts = [M.shard_counts(quotas, k, shards, 5) for k in range(shards)]
        at = np.zeros_like(quotas)
        for k, (start, count) in enumerate(counts):
            assert (start == at).all() and (count >= 0).all()
            assert count.sum() == quotas.sum() * (k + 1) // shards - quotas.sum() * k // shards
            at = at + count
        assert (at == quotas).all()


def test_tree_draws_are_hypergeometric():
    quotas = np.array([300, 100])
    draws = np.array([M.shard_counts(quotas, 3, 8, seed)[1][0] for seed in range(400)])
    assert abs(draws.mean() - 37.5) < 0.6
    assert 0.7 < draws.var() / (50 * 0.75 * 0.25 * (350 / 399)) < 1.35


def test_strides_visit_everything():
    for n in (1, 2, 3, 10, 97, 1000):
        a = M.stride(n, 17)
        assert len({k * a % n for k in range(n)}) == n


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    made = [(k, "w " * int(rng.integers(0, 60)), "en", f"s{min(3, int(rng.integers(0, 8)))}") for k in range(600)]
    return [*made, (700, None, "en", "s0"), (701, "a\tb\x0bc　d", "en", None), (702, "x", "en", None),
            (703, "twice the same", "en", "s1"), (703, "twice the same", "en", "s1"), (None, "no id", "en", "s2")]


def test_taken_words(docs_of, rows):
    p = M.Params(block_words=64, shards=5)
    out = M.taken(docs_of(rows), params=p).collect()
    size = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    assert Counter(r.size for r in out) == Counter(size[i, t] for i, t, _, _ in rows)
    total = defaultdict(int)
    for i, t, _, s in rows:
        total[s] += size[i, t]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, M.targets([total[s] for s in order], [(1.0, 2.0, 3.0)[k % 3] for k in range(len(order))], 3)))
    source = {i: s for i, _, _, s in rows}
    got = defaultdict(int)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(goal[s]) and r.taken <= 3 * r.size
        got[s] += r.taken
    for s in order:
        assert abs(got[s] - goal[s]) <= 3
    again = M.taken(docs_of(rows).repartition(7), params=p).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))


def test_mix_holds_what_was_taken(docs_of, rows):
    p = M.Params(block_words=64, shards=5)
    docs = docs_of(rows).withColumnRenamed("n_chars", "draws")
    mixed = M.mix(docs, params=p)
    assert mixed.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in mixed.collect())
    taken = defaultdict(int)
    for r in M.taken(docs, params=p).collect():
        taken[r.doc_id, r.size] += r.taken
    size = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    for (i, t), n in size.items():
        assert got[i, t] * n == taken[i, n]


def test_documents_that_do_not_fit_are_passed_over(docs_of):
    made = [(k, "w " * 50, "en", "a") for k in range(200)]  # weight 1, target 6,667 of 40,000 words
    made += [(900 + k, "w " * 6000, "en", "a") for k in range(5)]
    made += [(2000 + k, "w " * (20 + k % 7), "en", "b") for k in range(100)]
    p = M.Params(block_words=256, shards=3, weights=(1.0, 1e-9))
    docs = docs_of(made)
    out = M.taken(docs, params=p).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in made)
    miss = {}
    for s in "ab":
        of = [r for r in out if (r.doc_id >= 2000) == (s == "b")]
        miss[s] = abs(sum(r.taken for r in of) - of[0].target)
        assert all(r.taken <= 3 * r.size for r in of)
    assert max(miss.values()) <= 25  # half of the smallest document
    got = Counter(r.doc_id for r in M.mix(docs, params=p).collect())
    assert all(got[r.doc_id] * r.size == r.taken for r in out)


@pytest.mark.parametrize("seed", range(4))
def test_one_dominating_document(docs_of, seed):
    made = [(k, "w " * 50, "en", "a") for k in range(100)] + [(900, "w " * 9000, "en", "a")]
    made += [(2000 + k, "w " * 70, "en", "b") for k in range(100)]  # target of a: 10,500 of 21,000 words, less than a holds
    out = M.taken(docs_of(made), params=M.Params(block_words=256, shards=3, weights=(1.0, 1.0), seed=seed)).collect()
    of = [r for r in out if r.doc_id < 2000]
    assert abs(sum(r.taken for r in of) - of[0].target) <= 25


def test_empty_table(docs_of):
    assert M.taken(docs_of([])).count() == 0
    assert M.mix(docs_of([])).count() == 0
