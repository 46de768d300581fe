import random
import re
import zlib
from collections import Counter

import pytest

from attrition.llm import queries
from attrition.llm import variants as V


def brute_vocabulary(rows, noise_every=97, min_length=5, min_count=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if noise_every and h % noise_every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= min_length and k >= min_count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(n, near=None, ratio=2):
    near = near or {w: [v for v in n if is_near(v, w)] for w in n}
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * k else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def by_deletion(n):
    """Near words through one-deletion keys, for vocabularies too large for all pairs."""
    keys = {}
    for w in n:
        for k in range(len(w)):
            keys.setdefault((k, w[:k] + w[k + 1:]), set()).add(w)
    near = {w: set() for w in n}
    for (_, rest), same in keys.items():
        for w in same:
            near[w] |= same - {w}
            if rest in near:
                near[w].add(rest)
                near[rest].add(w)
    return near


def words_frame(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n bigint")


@pytest.mark.parametrize("max_state_words", [1, 3, 10, 50_000])
@pytest.mark.parametrize("seed", range(2))
def test_generated_vocabularies(spark, seed, max_state_words):
    rng = random.Random(seed)
    n = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 9))): rng.choice([3, 4, 8, 16, 500]) for _ in range(350)}
    n |= {"a" * k: 3 ** k for k in range(5, 12)}
    out = V.forms(words_frame(spark, n), max_state_words=max_state_words)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(brute(n), key=str)


def test_acceptor_is_minimal():
    a = V.Acceptor()
    a.add(sorted(["ing", "ings", "ping", "pings", "sing", "sings"]))
    assert len(a.arcs) == 6  # start, start behind p or s, i, n, g, behind the final s
    assert sorted(V.one_edit_pairs(["aab", "abb"], ["ab", "bb"])) == [("aab", "ab"), ("aab", "abb"), ("abb", "ab"), ("abb", "bb")]


def test_vocabulary_and_noise(spark, docs_of):
    rng = random.Random(5)
    words = ["Hello", "hello", "ÀÉîøü", "÷×ÿÿÿ", "xHELLOx", "a1b2c3", "ünder_score", "longer", "Longed", "Āabcdef"]
    rows = [(i if i % 7 else None, rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=30))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, "12 34"), (3, "Hello"), (3, "Hello"), (4, "z" * 40_000), (5, "z" * 40_000), (6, "z" * 40_000)]
    for every in (None, 2, 97):
        got = {r.word: r.n for r in V.vocabulary(docs_of(rows), noise_every=every).collect()}
        assert got == brute_vocabulary(rows, every)


def test_empty_and_clashing_columns(spark, docs_of):
    assert V.forms(V.vocabulary(docs_of([]))).count() == 0
    df = docs_of([(1, "words words words wordy")]).selectExpr("*", "1 AS word", "2 AS n", "3 AS run", "4 AS id")
    assert [tuple(r) for r in V.forms(V.vocabulary(df)).collect()] == [("words", None, "words", 3, 0, None)]


def test_registered_query(spark, duck):
    got = {tuple(r) for r in queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001").collect()}
    n = brute_vocabulary(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert got == brute(n, by_deletion(n))
    assert got == set(duck.sql(queries.ORACLE_SQL["op12_spelling_variants"]).fetchall())
