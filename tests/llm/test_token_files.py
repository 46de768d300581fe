import zlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attrition.llm import token_files as K
from attrition.llm.storage import scratch_path

PATH, PATTERN = vocabularies.path("byte_bpe_50k.json"), vocabularies.PATTERN


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(steps)
    ef = K.EliasFano.encode(values)
    assert ef.decode().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    ef = K.EliasFano.encode(np.cumsum(np.full(10_000, 700)))
    assert (len(ef.low) + len(ef.high) + len(ef.samples)) * 8 < 13 * 10_000
    with pytest.raises(IndexError):
        ef.select(10_000)


def want(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def write(spark, docs, **more):
    path = scratch_path(spark, "test-tokens")
    K.write_tokens(docs, path, lambda: K.text_encoder(PATH, PATTERN), **more)
    return path


@pytest.mark.parametrize("block_ids", [1, 7, 500_000])
def test_files_against_the_library(spark, docs_of, block_ids):
    rows = [(9, "hello  world"), (2, None), (5, ""), (-3, "the the <|endoftext|>"), (7, "word " * 300), (8, " \n"), (None, "x")]
    path = write(spark, docs_of(rows), block_ids=block_ids)
    found = sorted(map(tuple, K.read_index(spark, path).collect()), key=lambda r: r[1])
    assert found == want(rows)


def test_single_documents(spark, small_docs):
    path = write(spark, small_docs, block_ids=3000)
    t = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    some = [0, 7, 199]
    got = {r.doc_id: r.ids for r in K.read_documents(spark, path, some).collect()}
    assert got == {i: [*t.encode(texts[i], add_special_tokens=False).ids, 0] for i in some}


def test_empty_table(spark, docs_of):
    assert K.read_index(spark, write(spark, docs_of([]))).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.text(st.sampled_from("ab 's.\n\té1  \x1c\x85\u3000<|>"), max_size=12),
                          st.sampled_from(["hello", "World,", "don't", "<|endoftext|>", "\U0001f600", "x" * 90])), max_size=12),
       st.sampled_from([3, 1000]))
def test_texts_against_the_library(parts, capacity):
    text = " ".join(parts)
    encode = ENCODERS.setdefault(capacity, K.UnitEncoder(K.text_encoder(PATH, PATTERN).encode_piece, PATTERN, capacity))
    want = np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encode(text) == want == encode(text)


ENCODERS = {}
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def test_repeated_ids_have_a_defined_order(spark, docs_of):
    rows = [(1, t) for t in ("b", "a", "c", "a")] + [(0, "z")]
    one = [tuple(r) for r in K.read_index(spark, write(spark, docs_of(rows))).orderBy("start").collect()]
    two = [tuple(r) for r in K.read_index(spark, write(spark, docs_of(rows[::-1]).repartition(3))).orderBy("start").collect()]
    assert one == two and len(one) == 5
