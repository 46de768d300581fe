import hashlib
import random
import re

import pytest

from attrition.llm import queries
from attrition.llm import repeats as R


def brute(rows, window=20):
    """(id, n_words, n_removed, kept) of each row; rows in the order null ids first, ids, texts' place."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            key = tuple(words[p:p + window])
            if key in seen:
                gone[p:p + window] = [True] * window
            seen.add(key)
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return out


def found(df):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()]


def some_words(rng, n):
    return [rng.choice(["a", "bé", "C", "d.", "e f", "\u0085", "g" * 70, "h"]) for _ in range(n)]


@pytest.mark.parametrize("window", [2, 3, 6, 7, 20])
def test_generated_documents(spark, docs_of, window):
    rng = random.Random(window)
    passages = [some_words(rng, n) for n in (window - 1, window, window + 1, 3 * window, 50)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += some_words(rng, rng.randint(0, 2 * window)) if rng.random() < 0.5 else rng.choice(passages)
        rows.append((i * 3 - 50, rng.choice([" ", "\n", " \t\r\x0b\x0c"]).join(words)))
    rng.shuffle(rows)
    out = R.strip_repeats(docs_of(rows).repartition(5), window=window, chunk_bytes=rng.choice([1, 700, 1 << 20]),
                          bucket_entries=rng.choice([1, 40, 10**6]))
    assert sorted(found(out)) == sorted(brute(rows, window))


def test_spans_are_maximal(spark, docs_of):
    line = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join(line)), (2, " ".join(["x", *line, "y", *line[5:28], "z"]))]
    out = {r.doc_id: r for r in R.strip_repeats(docs_of(rows)).collect()}
    assert [tuple(s) for s in out[1].spans] == []
    assert [tuple(s) for s in out[2].spans] == [(1, 31), (32, 55)]
    assert out[2].kept == "x y z"


def test_defined_results(spark, docs_of):
    text = " ".join(f"v{k}" for k in range(25))
    rows = [(None, text), (None, None), (3, ""), (3, text), (4, " \n\t"), (5, "one"), (6, text), (6, text), (7, "t " * 60)]
    df = docs_of(rows).selectExpr("*", "1 AS chunk", "2 AS ids", "3 AS n_words", "4 AS kept")
    assert sorted(found(R.strip_repeats(df)), key=str) == sorted(brute(rows), key=str)
    assert found(R.strip_repeats(docs_of([]))) == []


def test_a_very_long_text_and_a_hot_line(spark, docs_of):
    rng = random.Random(1)
    hot = " ".join(f"h{k}" for k in range(21))
    long = " ".join(str(rng.randint(0, 10**6)) for _ in range(300_000))
    rows = [(0, long), (1, long[len(long) // 2:]), *((k, f"{k} {hot} {k}") for k in range(2, 400))]
    out = R.strip_repeats(docs_of(rows).repartition(8), chunk_bytes=1 << 16, bucket_entries=50_000)
    assert sorted(found(out)) == sorted(brute(rows))


def test_registered_query(spark, duck):
    got = {tuple(r) for r in queries.QUERIES["op11_substring_dedup"](spark, "/root/testdata/sf0.001").collect()}
    want = brute(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    assert got == {(i, n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in want}
    assert got == set(duck.sql(queries.ORACLE_SQL["op11_substring_dedup"]).fetchall())
