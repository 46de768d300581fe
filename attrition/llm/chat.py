"""Chat formatting by token-level assembly.

Each turn becomes tokens on its own: its segments (a role's name, a text) are
encoded separately, reserved ids that no text can produce are spliced between
them, and the loss mask follows from prefix sums over the segments' lengths.
Inside texts the template's control strings get a backslash behind their first
character, which is taken away again when reading; so the rendered text holds
control strings only where the template put them.

A conversation is a sequence of rows, one per turn, with the token offset of
each; no conversation is gathered in memory.  Reading streams the rows in order.

Defined results: a null text or role is the empty string; rows are ordered by
turn, then role, then text, so repeated turns keep their place; an empty table
gives an empty result; extra columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec

#: What opens and closes the turns of a role.
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
#: Any other role's turn: its name stands between the first two.
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
CONTROL = [*(x for pair in ROLES.values() for x in pair), *OTHER]
#: Turns that are learned.
LEARNED = "assistant"


def _check(control: list[str]) -> None:
    """Escaping is reversible if no control string begins inside another or within its end."""
    for a in control:
        for b in control:
            if any(b.startswith(a[k:]) for k in range(1, len(a))) or (a != b and b in a):
                raise ValueError(f"{a!r} and {b!r} overlap")


_check(CONTROL)
_PLAIN = re.compile("|".join(rf"(?<={re.escape(c[0])})(?=\\*{re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(c[0])})\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    """``text`` without any control string: a backslash goes behind the first character of each."""
    return _PLAIN.sub(r"\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def assemble(role: str, text: str, encode, reserved: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one turn."""
    content = np.frombuffer(encode(escape(text)), "<u4")
    if role in ROLES:
        opening, closing = ROLES[role]
        segments = [[reserved[opening]], content, [reserved[closing]]]
    else:
        name = np.frombuffer(encode(escape(role)), "<u4")
        segments = [[reserved[OTHER[0]]], name, [reserved[OTHER[1]]], content, [reserved[OTHER[2]]]]
    ends = np.cumsum([len(s) for s in segments])
    steps = np.zeros(int(ends[-1]) + 1, np.int8)
    if role == LEARNED:
        at = len(segments) - 2
        steps[ends[at] - len(content)] += 1
        steps[ends[at]] -= 1
    return np.concatenate([np.asarray(s, "<u4") for s in segments]), np.cumsum(steps[:-1], dtype=np.int8)


def _reserved(codec_) -> dict[str, int]:
    """Control string -> an id behind the vocabulary."""
    first = max(codec_.spelling) + 1
    return {c: first + k for k, c in enumerate(CONTROL)}


def format_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """The formatted conversations: conv_id, place, ids (binary, 32-bit), loss (binary, a byte per id), first_token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        reserved = _reserved(c)
        for batch in batches:
            made = [assemble(r, t, c.encode, reserved)
                    for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("place"), pa.array([i.tobytes() for i, _ in made], pa.binary()),
                 pa.array([m.tobytes() for _, m in made], pa.binary())], ["conv_id", "place", "ids", "loss"])

    conv = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("place", F.row_number().over(conv.orderBy("turn", "role", "text")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    made = rows.select("conv_id", "place", "role", "text").mapInArrow(
        run, f"conv_id {kind}, place int, ids binary, loss binary")
    before = conv.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("first_token", F.coalesce(F.sum(F.expr("length(ids) DIV 4")).over(before), F.lit(0)))


class _Conversation:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.text, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.text.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """What the formatted conversations say: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        reserved = _reserved(c)
        control = {i: s for s, i in reserved.items()}
        first = min(control)
        role_of = {reserved[opening]: role for role, (opening, _) in ROLES.items()}

        def plain(ids: np.ndarray) -> str:
            return "".join(c.decode([ids.tolist()]))

        def read(conv: _Conversation, ids: np.ndarray, loss: np.ndarray) -> None:
            marks = np.flatnonzero(ids >= first)
            parts = [plain(ids[a + 1:b]) for a, b in zip(marks[:-1], marks[1:])]
            conv.chars += sum(len(control[int(ids[m])]) for m in marks) + sum(map(len, parts))
            role = role_of.get(int(ids[0]))
            role, text = (unescape(parts[0]), parts[1]) if role is None else (role, parts[0])
            conv.turns += 1
            conv.text.update(f"{role}\n{unescape(text)}\n".encode())
            edges = np.flatnonzero(np.diff(np.concatenate([[0], loss, [0]])))
            for a, b in zip(edges[::2], edges[1::2]):
                learned = unescape(plain(ids[a:b]))
                conv.loss_chars += len(learned)
                conv.loss.update(learned.encode())

        def out(found: list[_Conversation]) -> pa.RecordBatch:
            columns = list(zip(*[x.row() for x in found])) or [[]] * 6
            kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)],
                                              ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                                               "formatted_chars"])

        now, key_type = None, pa.int64()
        for batch in batches:
            key_type, done = batch.schema.field("conv_id").type, []
            for conv_id, ids, loss in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "ids", "loss")]):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now)
                    now = _Conversation(conv_id)
                read(now, np.frombuffer(ids, "<u4"), np.frombuffer(loss, np.int8))
            yield out(done)
        if now is not None:
            yield out([now])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "ids", "loss")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                "loss_sha256 string, formatted_chars bigint")
