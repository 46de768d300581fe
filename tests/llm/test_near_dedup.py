import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from attrition.llm import near_dedup as N
from attrition.llm import words as W
from attrition.llm.components import components


def test_words_are_those_of_a_pattern(monkeypatch):
    texts = ["Ab c  dé,ÉÉ x1", "", None, "a", "one two three four five six", "?!", "Zz " * 50, "x" * 90]
    words = [re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower()) for t in texts]
    rows, found = W.hashed_words(pa.array(texts))
    assert [int((rows == k).sum()) for k in range(len(texts))] == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(found.tolist())) == len(set(flat))
    monkeypatch.setattr(W, "SPAN_BYTES", 16)
    again = W.hashed_words(pa.array(texts))
    assert (again[0] == rows).all() and (again[1] == found).all()


def test_samples_agree_as_often_as_the_weighted_jaccard():
    rng = np.random.default_rng(1)
    for n in (6, 60, 1500):
        found = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        n = len(found)
        a, b = np.arange(n) < n * 0.9, np.arange(n) >= n * 0.2
        weight = rng.uniform(1, 9, n)
        same = N.signature(found[a], weight[a], 4000) == N.signature(found[b], weight[b], 4000)
        true = N.weighted_jaccard(found[a], weight[a], found[b], weight[b])
        assert abs(same.mean() - true) < 0.09


@pytest.mark.parametrize("repeated, times, own", [(50, 32, 200), (10, 200, 200), (10, 500, 400)])
def test_long_documents_of_repeated_lines_share_a_band(repeated, times, own):
    p, rng, hits = N.Params(), np.random.default_rng(3), 0
    for _ in range(40):
        found = rng.integers(1, 1 << 63, repeated + 2 * own).astype(np.uint64)
        bands = []
        for mine in (found[repeated:repeated + own], found[repeated + own:]):
            bag = np.concatenate([found[:repeated], mine])
            counts = np.concatenate([np.full(repeated, times), np.ones(own, int)])
            order = np.argsort(bag)
            bag, counts = bag[order], counts[order]
            bands.append(N.band_keys(N.signature(bag, 10.0 * counts, p.samples, counts), p))
        hits += bool((bands[0] == bands[1]).any())
    assert hits == 40


def test_repeated_lines_with_own_text_are_one_class(docs_of):
    rows = [(100 * g + k, " ".join([f"line{g}x{j}" for j in range(11)] * 150 + [f"own{g}x{k}x{j}" for j in range(120)]))
            for g in range(8) for k in range(2)]
    p = N.Params(buckets=1 << 16)
    docs = docs_of(rows)
    idf = N.idf_table(docs.select("text"), p)
    found = N.classes(docs, params=p).collect()
    expected = brute_classes(rows, p, idf)
    assert all(size >= 2 for _, _, size in expected)
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in found) == expected


def brute_classes(rows, p, idf):
    """Smallest id of the connected component under all links, by comparing all pairs of texts."""
    bags = [(i, *b) for (i, t), b in zip(rows, N._bags(pa.array([t for _, t in rows], pa.string()), p))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, f, n) in enumerate(bags):
        for y in range(x):
            g, m = bags[y][1:]
            if len(f) and len(g) and N.weighted_jaccard(f, N.weights(f, n, idf), g, N.weights(g, m, idf)) >= p.threshold:
                parent[find(x)] = find(y)
    groups = defaultdict(list)
    for x, (i, _, _) in enumerate(bags):
        groups[find(x)].append(i)
    return sorted((i, min(g), len(g)) for g in groups.values() for i in g)


def near_copies(seed, groups=6, size=14, length=80):
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(groups):
        base = rnd.choices(vocabulary, k=length)
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 6])):
                text[rnd.randrange(length)] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(text)))
    return rows


def test_classes_against_all_pairs(docs_of):
    p = N.Params(buckets=1 << 16)
    rows = [*near_copies(3), (900, None), (901, ""), (902, "?!"), (903, "a b"), (904, "A, b."), (905, "a b c"),
            (906, "long " * 3000), (907, "long " * 3000 + "end")]
    docs = docs_of(rows)
    idf = N.idf_table(docs.select("text"), p)
    found = N.classes(docs, params=p).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in found) == brute_classes(rows, p, idf)
    assert {r.doc_id for r in found if r.kept} == {r.class_id for r in found}


def test_changed_words_do_not_split_a_large_group_of_copies(docs_of):
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    base = rnd.choices(vocabulary, k=80)
    rows = [(k, " ".join(base[:2 * k] + ["new"] + base[2 * k + 1:])) for k in range(2, 38)]
    rows += [(-1, " ".join(base)), *((100 + k, " ".join(rnd.choices(vocabulary, k=80))) for k in range(40))]
    found = {r.doc_id: r for r in N.classes(docs_of(rows), params=N.Params(buckets=1 << 16)).collect()}
    assert {found[k].class_id for k in range(2, 38)} == {-1} and found[-1].class_size == 37
    assert all(found[100 + k].class_size == 1 for k in range(40))


def test_weights_follow_the_documents_usual_frequency():
    idf = np.zeros(16, np.float32)
    idf[:8], idf[8:] = 10, 4
    rare, common, least = np.arange(8), np.arange(8, 16), round(0.4 * 4096) / 4096
    few_common = np.concatenate([rare, common[:2]]).astype(np.uint64)
    assert (N.weights(few_common, np.array([1] * 8 + [50, 1]), idf) == [1] * 8 + [50 * least, least]).all()
    few_changed = np.concatenate([rare[:2], common]).astype(np.uint64)
    assert (N.weights(few_changed, np.ones(10, int), idf) == 1).all()  # not ten to four
    even = N.weights(np.arange(16, dtype=np.uint64), np.ones(16, int), idf)
    assert (even[:8] == 1).all() and (even[8:] == round(4 / 7 * 4096) / 4096).all()
    assert not len(N.weights(few_changed[:0], np.ones(0, int), idf))


def test_a_common_line_repeated_in_otherwise_different_documents_links_none(docs_of):
    line = " ".join(f"line{j}" for j in range(11))
    rows = [(k, " ".join([line] * 12 + [f"own{k}x{j}" for j in range(60)])) for k in range(60)]
    found = N.classes(docs_of(rows), params=N.Params(buckets=1 << 16)).collect()
    assert all(r.class_size == 1 for r in found)


def test_few_pairs_of_a_group_of_copies_are_compared(docs_of, monkeypatch):
    rnd = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(60):  # of a text that is not there; no two are similar enough
        text = list(base)
        for j in rnd.sample(range(150), 5):
            text[j] = f"new{k}x{j}"
        rows.append((k, " ".join(text)))
    p, compared, real = N.Params(buckets=1 << 16), [], N.stage

    def counted(df, name):
        out = real(df, name)
        if name == "compared":
            compared.append(out.count())
        return out

    monkeypatch.setattr(N, "stage", counted)
    docs = docs_of(rows)
    found = N.classes(docs, params=p).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in found) == brute_classes(rows, p, N.idf_table(docs.select("text"), p))
    assert sum(compared) < 300  # of 1,770


def test_drop_keeps_columns_and_one_of_each(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    df = spark.createDataFrame([(3, text, 1), (2, text.upper(), 2), (1, "something else of enough words here", 3),
                                (None, None, 4), (None, "one more text that stands alone here", 5)],
                               "doc_id int, text string, node int")
    out = N.drop_near_copies(df, params=N.Params(buckets=1 << 12))
    assert out.columns == df.columns
    assert sorted(r.node for r in out.collect()) == [2, 3, 4, 5]


def test_empty_table(docs_of):
    assert N.classes(docs_of([]), params=N.Params(buckets=1 << 12)).count() == 0
    assert N.drop_near_copies(docs_of([]), params=N.Params(buckets=1 << 12)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(25)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert out == {x: find(x) for x in parent if find(x) != x}
