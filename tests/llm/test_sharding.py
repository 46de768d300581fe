import hashlib
from collections import Counter, defaultdict

import pytest

from attrition.llm import sharding as S
from attrition.llm.storage import scratch_path


def bits(doc_id):
    text = "null" if doc_id is None else str(doc_id)
    return format(int(hashlib.md5(text.encode()).hexdigest()[:15], 16), "060b")


def brute(rows, limit):
    """Split oversized prefixes bit by bit."""
    out, todo = {}, {"": [(i, len((t or "").encode())) for i, t in rows]}
    while todo:
        prefix, docs = todo.popitem()
        if sum(n for _, n in docs) <= limit or len(docs) == 1:
            out.update({i: prefix for i, _ in docs})
            continue
        for bit in "01":
            part = [d for d in docs if bits(d[0]).startswith(prefix + bit)]
            if part:
                todo[prefix + bit] = part
    return out


@pytest.mark.parametrize("limit", [40, 300, 1 << 20])
def test_against_splitting_one_by_one(docs_of, limit):
    rows = [(k, "x" * (k * 7 % 50)) for k in range(200)] + [(900, None), (901, ""), (None, "é"), (902, "y" * 400)]
    found = S.assign(docs_of(rows), max_bytes=limit).collect()
    assert {r.doc_id: r.shard for r in found} == brute(rows, limit)
    size = Counter()
    for r in found:
        size[r.shard] += r.doc_bytes
    assert all(r.shard_bytes == size[r.shard] for r in found)
    assert all(r.shard_bytes <= limit or r.shard_docs == 1 for r in found)


def test_rows_of_one_id_are_parted(docs_of):
    found = S.assign(docs_of([(5, "abcd")] * 40 + [(6, "z")]), max_bytes=10).collect()
    assert len(found) == 41 and all(r.shard_bytes <= 10 for r in found)


def test_no_shard_is_inside_another(docs_of):
    found = S.assign(docs_of([(k, "x" * 9) for k in range(100)]), max_bytes=50).collect()
    shards = sorted({r.shard for r in found})
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))


def test_written_shards(spark, docs_of):
    rows = [(k, "x" * 20) for k in range(60)]
    path = scratch_path(spark, "shards")
    S.write_shards(docs_of(rows), path, max_bytes=200, partitions=4)
    got = defaultdict(list)
    for r in spark.read.parquet(path).collect():
        got[r.shard].append(r.doc_id)
    assert sorted(i for ids in got.values() for i in ids) == list(range(60))
    assert all(len(ids) * 20 <= 200 for ids in got.values())


def test_empty_table(docs_of):
    assert S.assign(docs_of([])).count() == 0
