"""Each stage of the corpus pipeline against a brute-force version, on the smallest data set."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken

import corpus_pipeline
from attrition.llm import bpe, mixing, near_dedup, queries, toxicity

from .test_near_dedup import brute_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents and the output of each stage, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns_stay(stages):
    for name in ("toxicity", "exact_dedup", "near_dedup", "mixing"):
        assert stages[name][0].__fields__ == stages["documents"][0].__fields__


def test_toxicity(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.score(docs, queries.toxicity_chain(spark, docs, SF)).collect()
    assert ids(stages["toxicity"]) == sorted(r.doc_id for r in scored if r.p_toxic < 0.5)
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert len(clean - set(ids(stages["toxicity"]))) <= 1


def test_exact_dedup(stages):
    largest = {}
    for r in stages["toxicity"]:
        largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", -1))
    assert ids(stages["exact_dedup"]) == sorted(largest.values())


def test_near_dedup(spark, stages):
    p = near_dedup.Params()
    rows = [(r.doc_id, r.text) for r in stages["exact_dedup"]]
    idf = near_dedup.idf_table(spark.createDataFrame([(t,) for _, t in rows], "text string"), p)
    assert ids(stages["near_dedup"]) == sorted({c for _, c, _ in brute_classes(rows, p, idf)})


def test_mixing(spark, stages):
    docs = spark.createDataFrame(stages["near_dedup"])
    taken = mixing.taken(docs).collect()
    drawn = Counter(r.doc_id for r in stages["mixing"])
    assert all(drawn[r.doc_id] * r.size == r.taken for r in taken)
    total, goal = defaultdict(int), {}
    source = {r.doc_id: r.source for r in stages["near_dedup"]}
    for r in taken:
        total[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    assert sum(abs(total[s] - goal[s]) for s in goal) < 0.1 * sum(goal.values())


def test_bpe(stages):
    path, pattern = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for r in stages["mixing"]:
        tokens = np.array(own.encode_ordinary(r.text or ""), "<u4")
        want[r.doc_id, len(tokens), hashlib.sha256(tokens.tobytes()).hexdigest(),
             hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, stages["bpe"])) == want


def test_run_is_the_stages_in_turn(spark, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, stages["bpe"]))
