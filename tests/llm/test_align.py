import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as vocabularies
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attrition.llm import align as L
from attrition.llm import queries

A, B = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")
WHERE = (A, vocabularies.PATTERN, B)


def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute_groups(text, a, b):
    """[(A ids, B ids)] of each group by sets of end offsets, tokens by the libraries over the whole text."""
    if not text:
        return []
    whole = (" " + text).encode()
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in own} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in own)}
    sides = []
    for ids, spell in ((a.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(letters[c] for c in a.id_to_token(i))),
                       (b.encode(text), lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i)
                        else b.id_to_piece(i).replace("▁", " ").encode())):
        spelled = [spell(i) for i in ids]
        if b"".join(spelled) != whole:
            return []
        sides.append((ids, np.cumsum([len(s) for s in spelled]).tolist()))
    cuts = sorted(set(sides[0][1]) & set(sides[1][1]))
    out, before = [], 0
    for cut in cuts:
        out.append(tuple([i for i, e in zip(*side) if before < e <= cut] for side in sides))
        before = cut
    return out


def brute(rows):
    a, b = libraries()
    found = [(i, brute_groups(t, a, b)) for i, t in rows]
    count = Counter((x[-1], y[-1]) for _, g in found for x, y in g)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for i, g in found:
        links = [(x[-1], y[-1]) for x, y in g]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links),
                    sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.data())
def test_run_skipping(lengths, data):
    total = sum(lengths)
    ends_a = np.cumsum(lengths)
    inner = data.draw(st.sets(st.one_of(st.sampled_from(ends_a.tolist()), st.integers(1, total)), max_size=60))
    ends_b = np.array(sorted(inner | {total}))
    upto_a, upto_b = L.group_ends(ends_a, ends_b)
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    assert [int(ends_a[k - 1]) for k in upto_a] == cuts == [int(ends_b[k - 1]) for k in upto_b]


TEXT = st.one_of(st.text(max_size=40), st.text(st.sampled_from("ab 's.\n\té1  ▁　\x1c\x85 ﬁ"), max_size=30),
                 st.lists(st.sampled_from(["hello", "World,", "don't", "</s>", "<|endoftext|>", "été", "\U0001f600", "<0x41>", "  "]),
                          max_size=8).map(" ".join))


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_texts_against_the_libraries(text):
    one = L.align_text(text, L.byte_level(A, vocabularies.PATTERN), L.sentence_pieces(B))
    names = [str(i) for i in range(60_000)]
    want = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in brute_groups(text, *LIBRARIES))
    assert one.groups(names, names) == want


LIBRARIES = libraries()

ROWS = [(1, "hello world"), (2, None), (2, ""), (None, "hello world"), (3, "a▁b hello"), (4, " \n\n x"), (5, "worlds, the hello"),
        (5, "worlds, the hello"), (6, "été </s> <|endoftext|> \U0001f600"), (7, "x" * 5000), (8, " "), (9, "thntblere of then. " * 400)]


@pytest.mark.parametrize("chunk_tokens", [1, 30, 10**6])
def test_statistics_against_brute_force(spark, docs_of, chunk_tokens):
    docs = docs_of(ROWS).selectExpr("*", "1 AS id", "2 AS chunk", "3 AS n_a").repartition(3)
    out = L.link_statistics(docs, *WHERE, chunk_tokens=chunk_tokens)
    assert sorted(map(tuple, out.collect()), key=str) == brute(ROWS)


def test_groups_and_empty_table(spark, docs_of):
    got = {r.doc_id: r.groups for r in L.groups(docs_of(ROWS[:2]), *WHERE).collect()}
    assert got[2] == "" and got[1].count(";") == 1
    assert L.link_statistics(docs_of([]), *WHERE).count() == 0


def test_registered_query(spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_group_text_is_put_together_from_arrays():
    """No Python step per group: the work of a text is arrays, with ids of different width side by side."""
    one = L.Aligned(np.array([7, 12345, 3]), np.array([10, 9, 200, 1]), np.array([2, 3]), np.array([1, 4]))
    names = L.Tokenizer(None, [b"x"] * 12346).names
    assert isinstance(names, np.ndarray)
    assert one.groups(names, names) == "7,12345|10;3|9,200,1"
    assert one.links.tolist() == [12345 << 32 | 10, 3 << 32 | 1]
    assert L.NOTHING.groups(names, names) == "" and not len(L.NOTHING.links)
