import hashlib

import numpy as np
import public_tokenizers as vocabularies
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from attrition.llm import bpe

PATH, PATTERN = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
TEXTS = ["", " ", "\n\n x\t\ty  ", "a  b", "don't we'll  'S", "aaaaaaaaaaaaaaa" * 20, " " * 900, "x" * 2000,
         "日本語 \U0001f389\U0001f389 éÉ", "1234567 89ab12!?..", "  a　b\x1c c", "the, quick. brown\nfox"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def ids_of(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_known_texts(codec, reference, text):
    ids = ids_of(codec, text)
    assert ids == reference.encode_ordinary(text)
    assert "".join(codec.decode([ids[k:k + 3] for k in range(0, len(ids), 3)])) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeth ingéü.,!\n1日'", max_size=60))
def test_any_text(text):
    c = bpe.codec(PATH, PATTERN)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={}) \
        if not hasattr(test_any_text, "own") else test_any_text.own
    test_any_text.own = own
    assert ids_of(c, text) == own.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50255), max_size=30), st.integers(1, 7))
def test_stream_decoder_like_replace(ids, chunk):
    c = bpe.codec(PATH, PATTERN)
    got = "".join(c.decode([ids[k:k + chunk] for k in range(0, len(ids), chunk)]))
    assert got == b"".join(c.spelling[i] for i in ids).decode("utf-8", "replace")


def test_results_do_not_depend_on_bounds(reference):
    small = bpe.MergeTransducer(bpe.load_ranks(PATH), max_arcs=50)
    for piece in (" international", "abcdefghijklmnopqrstuvwxyz" * 10, " th"):
        assert small.encode(piece.encode()) == reference.encode_ordinary(piece)


def test_round_trip_rows(docs_of, reference):
    rows = list(enumerate([*TEXTS, None, TEXTS[3]]))
    out = {r.doc_id: r for r in bpe.round_trip(docs_of(rows), PATH, PATTERN, chunk=5).collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_columns_and_empty_table(docs_of):
    df = bpe.decode_texts(bpe.encode_texts(docs_of([(1, "ab cd"), (2, None)]), PATH, PATTERN), PATH, PATTERN, out="back")
    assert [r.back for r in df.orderBy("doc_id").collect()] == ["ab cd", ""]
    assert bpe.round_trip(docs_of([]), PATH, PATTERN).count() == 0


def test_remembered_states_are_packed_numbers(reference):
    """A remembered state takes 12 bytes a boundary; tuples of numbers took ten times that."""
    t = bpe.MergeTransducer(bpe.load_ranks(PATH))
    for word in (" international", " counterrevolutionaries", "日本語", " 1234567 misunderstandings"):
        assert t.encode(word.encode()) == reference.encode_ordinary(word) or word.startswith(" 1")
    assert len(t.states) > 20 and all(isinstance(s, bytes) and len(s) % 12 == 0 for s in t.states)


def test_worker_forgets_arcs_beyond_its_bound(reference):
    c = bpe.Codec(PATH, PATTERN, capacity=100, max_arcs=200)
    for i in range(400):
        text = f"word{i * 7919} un{i}known {chr(0x3042 + i % 60)}x"
        assert ids_of(c, text) == reference.encode_ordinary(text)
        assert len(c.transducer.arcs) <= 400


def test_freed_memory_is_returned():
    """Numbers of many sizes, of which a few stay, leave holes in the heap that only a trim gives back."""
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 // 2 ** 20

    arrays = [np.ones(2000 + k % 500) for k in range(8000)]
    kept, full = arrays[::400], resident()
    del arrays
    bpe.give_back()
    assert len(kept) == 20 and resident() < full - 80


def test_releasing_round_trip_gives_the_same_rows(docs_of):
    rows = docs_of(list(enumerate(TEXTS)))
    plain = sorted(map(tuple, bpe.round_trip(rows, PATH, PATTERN).collect()))
    assert sorted(map(tuple, bpe.round_trip(rows, PATH, PATTERN, capacity=50, release=True, max_arcs=100).collect())) == plain
