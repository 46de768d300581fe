import tracemalloc

import numpy as np
import pyarrow as pa

from attrition.llm import near_dedup as N


def batch(n):
    return pa.RecordBatch.from_pydict({"text": [f"w{i} x{i} y{i} z{i} u{i} a b c d e f" for i in range(n)]})


def test_counting_shingles_holds_one_table():
    p = N.Params()
    rows = batch(600)
    list(N._count_table(N.Params(buckets=1 << 8))([rows]))  # what is loaded on first use
    tracemalloc.start()
    parts = list(N._count_table(p)([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 4 * p.buckets
    counts = np.concatenate([np.frombuffer(b.column(2)[0].as_py(), f"<u{b.column(1)[0].as_py()}") for b in parts])
    expected = np.zeros(p.buckets, np.int64)
    for found, _ in N._bags(batch(600).column(0), p):
        expected[(found & np.uint64(p.buckets - 1)).astype(np.int64)] += 1
    assert np.array_equal(counts, expected)


def test_bags_leave_in_slices():
    class Value:
        def __init__(self, value):
            self.value = value

    asked = []
    rows = pa.RecordBatch.from_pydict({"at": pa.array(range(600), pa.int64()), "text": batch(600).column(0)})
    real, N._bags = N._bags, lambda texts, p: (asked.append(1) or b for b in real(texts, p))
    try:
        first = next(N._bag_rows(N.Params(), Value(np.ones(1 << 22, np.float32)), Value(np.full(1 << 21, 255, np.uint8)))([rows]))
    finally:
        N._bags = real
    assert first.num_rows == len(asked) == N._SLICE
