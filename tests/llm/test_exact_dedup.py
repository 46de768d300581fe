import hashlib
from collections import Counter, defaultdict

import pytest

from attrition.llm import exact_dedup as X

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (None, "a"), (6, "c"), (6, "c"), (None, "only"), (9, "A")]


def test_misra_gries_keeps_what_is_frequent():
    counts = {bytes([k]): n for k, n in enumerate([50, 40, 3, 2, 1, 1])}
    left = X.shrink(counts, 2)
    assert left == {b"\x00": 47, b"\x01": 37}
    assert X.shrink(left, 2) is left


@pytest.mark.parametrize("capacity", [1, 3, 1024])
def test_groups_against_brute_force(docs_of, capacity):
    out = [r.asDict() for r in X.assign(docs_of(ROWS), capacity=capacity).collect()]
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, keep[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
                   for i, t in ROWS)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == want
    kept = Counter(r["text_sha256"] for r in out if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_drop_copies_keeps_columns_and_one_row(spark):
    df = spark.createDataFrame([(1, "x", 7, "p"), (2, "x", 8, "q"), (2, "x", 8, "q"), (3, None, 9, "r"), (4, "", 1, "s")],
                               "doc_id int, text string, digest int, `row` string")
    out = X.drop_copies(df, capacity=2)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(2, "x", 8, "q"), (4, "", 1, "s")]


def test_empty_table(docs_of):
    assert X.assign(docs_of([])).count() == 0
    assert X.drop_copies(docs_of([])).count() == 0
