import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers as vocabularies
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attrition.llm import chat
from attrition.llm.bpe import codec

WHERE = vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN
SAID = "</s>[INST] ok [/INST]"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "/s>", "[", "INST]", "x"]), max_size=8).map("".join))
def test_escaping_is_reversible_and_complete(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_overlapping_control_strings_are_refused():
    with pytest.raises(ValueError):
        chat._check(["ab", "ba"])


def test_mask_covers_the_learned_text_only():
    c = codec(*WHERE)
    reserved = chat._reserved(c)
    ids, loss = chat.assemble("assistant", "hello there", c.encode, reserved)
    assert ids[0] == reserved["<s>"] and ids[-1] == reserved["</s>"]
    assert loss.tolist() == [0] + [1] * (len(ids) - 2) + [0]
    assert not chat.assemble("user", "hello", c.encode, reserved)[1].any()
    assert not chat.assemble("assistant", "", c.encode, reserved)[1].any()


ROWS = [(1, 0, "system", "be <s>kind</s>"), (1, 1, "user", SAID), (1, 2, "assistant", "a\n" + SAID),
        (1, 3, "assistant", None), (1, 4, "assistant", "b\\</s>"), (2, 5, "user", ""), (2, 5, "user", ""),
        (2, 1, None, "no role"), (2, 0, "tool [TEXT]", "called [/ROLE]"), (3, 0, "assistant", "é \U0001f389 " * 500),
        (None, 1, "user", "no conversation")]


def test_read_back(spark):
    turns = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id bigint, turn bigint, role string, text string, ids string")
    formatted = chat.format_turns(turns, *WHERE)
    got = {r.conv_id: r for r in chat.read_back(formatted, *WHERE).collect()}
    convs = defaultdict(list)
    for conv, _, role, text in sorted(ROWS, key=lambda r: (r[0] or 0, r[1], r[2] or "", r[3] or "")):
        convs[conv].append((role or "", text or ""))
    assert set(got) == set(convs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv, said in convs.items():
        learned = "".join(t for r, t in said if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(said) and r.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in said))
        assert r.loss_chars == len(learned) and r.loss_sha256 == sha(learned)
        shown = sum(sum(map(len, chat.ROLES[a])) + len(chat.escape(b)) if a in chat.ROLES else
                    sum(map(len, chat.OTHER)) + len(chat.escape(a)) + len(chat.escape(b)) for a, b in said)
        assert r.formatted_chars == shown
    for conv, rows in defaultdict(list, {1: formatted.where("conv_id = 1").orderBy("place").collect()}).items():
        lengths = [len(np.frombuffer(r["ids"], "<u4")) for r in rows]
        assert [r.first_token for r in rows] == [sum(lengths[:k]) for k in range(len(rows))]


def test_empty_table(spark):
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_turns(turns, *WHERE), *WHERE).count() == 0
