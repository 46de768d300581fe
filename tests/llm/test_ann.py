import numpy as np
import pytest
from pyspark.sql import functions as F

from attrition.llm import ann as A


def brute(ids, x, q, k):
    norm = np.sqrt((x * x).sum(axis=1))
    at = ids.index(q)
    cos = x @ x[at] / (norm * norm[at])
    order = sorted((-round(float(c), 12), i) for c, i in zip(cos, ids) if i != q)
    return order[:k]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")


def test_recall_over_several_shards(vectors):
    p = A.Params(shard_rows=120)
    got = A.search(vectors, F.col("id") % 5 == 0, params=p).collect()
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    ids, x = list(rows), np.stack(list(rows.values()))
    hits = total = 0
    for q in (i for i in ids if i % 5 == 0):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5]
        for _, v, s in mine:
            assert s == pytest.approx(float(A.cosines(rows[q], rows[v])), abs=1e-12)
        hits += len({v for _, v, _ in mine} & {i for _, i in brute(ids, x, q, 5)})
        total += 5
    assert hits / total >= 0.95


def test_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    same = [1.0, 2.0, 3.0, 4.0]
    rows = [(k, same, 0) for k in range(100, 140)] + [(k, rng.normal(size=4).tolist(), 0) for k in range(1, 40)]
    odd = [(200, None, 0), (201, [], 0), (202, [0.0] * 4, 0), (203, [1.0, None, 1.0, 1.0], 0),
           (204, [1.0, float("nan"), 1.0, 1.0], 0), (205, [float("inf"), 1.0, 1.0, 1.0], 0), (206, [1.0, 2.0], 0),
           (None, same, 0), (100, same, 0)]
    got = A.search(frame(spark, rows + odd), F.col("id") % 10 == 0, params=A.Params(shard_rows=30)).collect()
    by = {q: sorted((r.rank, r.vec_id) for r in got if r.query_id == q) for q in {r.query_id for r in got}}
    assert set(by) == {10, 20, 30, 100, 110, 120, 130}
    assert [v for _, v in by[100]] == [101, 102, 103, 104, 105]
    assert [v for _, v in by[130]] == [100, 101, 102, 103, 104]
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).astype(float)
    for q in (10, 20, 30):
        assert [v for _, v in by[q]] == [i for _, i in brute(ids, x, q, 5)]


def test_fewer_candidates_than_asked_and_empty_table(spark):
    two = frame(spark, [(50, [1.0, 0.0], 0), (51, [0.5, 0.5], 0)])
    assert [(r.query_id, r.vec_id) for r in A.search(two, F.col("id") % 50 == 0).collect()] == [(50, 51)]
    assert A.search(frame(spark, []), F.col("id") % 50 == 0).count() == 0


def test_all_of_the_beam_is_compared_in_double_precision():
    rng, noise = np.random.default_rng(7), 1e-3
    centre = rng.normal(size=64)
    x = centre + noise * np.abs(centre).mean() * rng.normal(size=(300, 64))
    p = A.Params()
    graph, start = A.build_graph(A._unit(x), p)
    index = {"vectors": x.tobytes(), "dims": 64, "graph": graph.astype(np.int32).tobytes(), "start": start,
             "members": [[k] for k in range(300)]}
    asked = np.arange(0, 300, 10)
    got = A._search(index, asked, x[asked], 5, p)
    hits = 0
    for q in asked:
        cos = A.cosines(x, x[q])
        cos[q] = -1
        hits += len(set(got["vec_id"][got["query_id"] == q]) & set(np.argsort(-cos)[:5].tolist()))
    assert hits / (5 * len(asked)) >= 0.95


def test_pruning_keeps_diverse_edges():
    angle = np.array([0.0, 0.1, 0.11, -0.12, 1.0])
    points = np.column_stack([np.cos(angle), np.sin(angle)])
    kept = A.robust_prune(points, np.array([0]), np.array([[1, 2, 3, 4, 0, -1]]), 4, 1.2)[0]
    assert kept[:2].tolist() == [1, 3] and 2 not in kept
