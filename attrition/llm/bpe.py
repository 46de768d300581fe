"""Byte-level BPE as a finite-state transducer, and a streaming decoder.

Encoding.  For a vocabulary of ranks, a token sequence is the BPE encoding of
its bytes exactly if every adjacent pair of tokens is the encoding of its own
two-token string.  So after each byte there is one valid last token, and the
encoder is a transducer over bytes: a state holds the token boundaries that can
still matter (those from which the bytes read so far spell a prefix of some
token) with the token that ends at each, as a tree.  When all of them descend
from one boundary, the tokens up to it are emitted; the lookahead is bounded by
the longest token.  The deterministic states and their arcs are built when they
are first needed and remembered up to a bound.

Decoding.  Token bytes run through a UTF-8 state machine that keeps its state
between calls, so ids may arrive in any chunks; a broken sequence gives U+FFFD
by the usual maximal-subpart rule.

Defined results: a null or empty text has no ids and decodes to the empty
string; repeated rows give repeated results; other columns are never read.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceEncoder

#: Bound on remembered arcs of the lazily built transducer (per worker process).
MAX_ARCS = 1_000_000

_NO_TOKEN = -1
_DEAD = -1


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a rank file (base64 token, space, rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


_BOUNDARY = struct.Struct("3i")


class MergeTransducer:
    """Lazily determinised transducer from bytes to BPE token ids."""

    def __init__(self, ranks: dict[bytes, int], max_arcs: int = MAX_ARCS):
        self.ranks, self.max_arcs = ranks, max_arcs
        self.spelling = {i: t for t, i in ranks.items()}
        # the prefix tree of all tokens: (node << 8 | byte) -> node, and the token at a node
        self.child: dict[int, int] = {}
        self.token_at: list[int] = [_NO_TOKEN]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                node = self.child.setdefault(node << 8 | byte, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(_NO_TOKEN)
            self.token_at[node] = rank
        self.pairs: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        start = _BOUNDARY.pack(-1, _NO_TOKEN, 0)
        self.states = [start]
        self.number = {start: 0}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short string: merge the adjacent pair of lowest rank, leftmost first."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether (left, right) is the encoding of its own bytes."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.max_arcs:
                self.pairs.clear()
            known = self.merge(self.spelling[left] + self.spelling[right]) == [left, right]
            self.pairs[key] = known
        return known

    # A state is a row of boundaries (parent boundary, last token, tree node), oldest first, kept as packed numbers; the
    # node of a boundary is where the bytes behind it lead in the prefix tree, or _DEAD. Boundary 0 is
    # the one up to which all tokens have been emitted; the last boundary is at the current byte.

    def _step(self, packed: bytes, byte: int) -> tuple[bytes, tuple[int, ...]]:
        state = list(_BOUNDARY.iter_unpack(packed))
        nodes, new = [], None
        for k, (_, last, node) in enumerate(state):
            node = self.child.get(node << 8 | byte, _DEAD) if node != _DEAD else _DEAD
            nodes.append(node)
            if new is None and node != _DEAD and (token := self.token_at[node]) != _NO_TOKEN \
                    and (last == _NO_TOKEN or self.compatible(last, token)):
                new = (k, token, 0)
        if new is None:
            raise ValueError("the vocabulary lacks single bytes")
        entries = [(p, t, n) for (p, t, _), n in zip(state, nodes)] + [new]
        children = [0] * len(entries)
        for p, _, _ in entries[1:]:
            children[p] += 1
        keep = [True] * len(entries)
        for k in range(len(entries) - 1, 0, -1):
            if entries[k][2] == _DEAD and not children[k]:
                keep[k] = False
                children[entries[k][0]] -= 1
        root, emitted = 0, []
        while entries[root][2] == _DEAD and children[root] == 1:
            root = next(k for k in range(root + 1, len(entries)) if keep[k] and entries[k][0] == root)
            emitted.append(entries[root][1])
        place, out = {root: 0}, array("i")
        for k in range(root, len(entries)):
            p, t, n = entries[k]
            if k == root or keep[k] and p in place:
                place[k] = len(out) // 3
                # the token before a dead boundary can no longer decide anything
                out.extend((place[p] if k != root else -1, t if n != _DEAD or k != root else _NO_TOKEN, n))
        return out.tobytes(), tuple(emitted)

    def _arc(self, number: int, byte: int) -> tuple[int, tuple[int, ...]]:
        state, emitted = self._step(self.states[number], byte)
        target = self.number.get(state)
        if target is None:
            target = self.number[state] = len(self.states)
            self.states.append(state)
        self.arcs[number << 8 | byte] = arc = (target, emitted)
        return arc

    def _end(self, number: int) -> tuple[int, ...]:
        state, path = list(_BOUNDARY.iter_unpack(self.states[number])), []
        k = len(state) - 1
        while k > 0:
            path.append(state[k][1])
            k = state[k][0]
        self.ends[number] = out = tuple(reversed(path))
        return out

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one piece of text, of any length."""
        if len(self.arcs) >= self.max_arcs:
            self._forget()
        number, out, arcs = 0, [], self.arcs
        for i, byte in enumerate(data):
            arc = arcs.get(number << 8 | byte)
            if arc is None:
                if len(arcs) >= 2 * self.max_arcs:  # within one long piece: keep the state, drop the arcs
                    state = self.states[number]
                    self._forget()
                    arcs = self.arcs
                    number = self.number.setdefault(state, len(self.states))
                    if number == len(self.states):
                        self.states.append(state)
                arc = self._arc(number, byte)
            number, emitted = arc
            if emitted:
                out += emitted
        end = self.ends.get(number)
        out += self._end(number) if end is None else end
        return out


def _ranges() -> list[dict[int, int]]:
    """The UTF-8 machine by rule: for each state the bytes it accepts and the state they lead to.

    State 0: between characters; 1, 2, 3: so many continuation bytes to come;
    4 to 7: the second byte after E0, ED, F0, F4, whose range is narrower.
    """
    def span(lo: int, hi: int, to: int) -> dict[int, int]:
        return dict.fromkeys(range(lo, hi + 1), to)

    first = (span(0x00, 0x7F, 0) | span(0xC2, 0xDF, 1) | span(0xE1, 0xEF, 2) | span(0xF1, 0xF3, 3)
             | {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7})
    return [first, span(0x80, 0xBF, 0), span(0x80, 0xBF, 1), span(0x80, 0xBF, 2),
            span(0xA0, 0xBF, 1), span(0x80, 0x9F, 1), span(0x90, 0xBF, 2), span(0x80, 0x8F, 2)]


class StreamDecoder:
    """Token ids, in chunks of any size, to text; keeps an unfinished character for the next chunk."""

    _MACHINE = _ranges()

    def __init__(self, spelling: dict[int, bytes], whole: dict[int, str] | None = None):
        self.spelling, self.state, self.held = spelling, 0, b""
        #: tokens that are whole characters by themselves: the machine passes them from state 0 to 0
        self.whole = whole if whole is not None else self.whole_tokens(spelling)

    @classmethod
    def whole_tokens(cls, spelling: dict[int, bytes]) -> dict[int, str]:
        out = {}
        for i, data in spelling.items():
            state = 0
            for byte in data:
                state = cls._MACHINE[state].get(byte, -1)
                if state < 0:
                    break
            if state == 0:
                out[i] = data.decode("utf-8")
        return out

    def _bytes(self, data: bytes) -> str:
        out = []
        for byte in data:
            to = self._MACHINE[self.state].get(byte, -1)
            if to < 0 and self.state:  # the unfinished character is broken; the byte may begin another
                out.append("�")
                self.state, self.held = 0, b""
                to = self._MACHINE[0].get(byte, -1)
            if to < 0:
                out.append("�")
                continue
            self.state, self.held = to, self.held + bytes([byte])
            if to == 0:
                out.append(self.held.decode("utf-8"))
                self.held = b""
        return "".join(out)

    def feed(self, ids: list[int]) -> str:
        if not self.state:
            found = list(map(self.whole.get, ids))
            if None not in found:
                return "".join(found)
        out = []
        for i in ids:
            text = self.whole.get(i) if not self.state else None
            out.append(self._bytes(self.spelling[i]) if text is None else text)
        return "".join(out)

    def close(self) -> str:
        """What remains at the end of the stream."""
        rest, self.state, self.held = ("�" if self.state else ""), 0, b""
        return rest


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, capacity: int = 300_000, max_arcs: int = MAX_ARCS):
        self.transducer = MergeTransducer(load_ranks(path), max_arcs)
        self.spelling = self.transducer.spelling
        self.whole = StreamDecoder.whole_tokens(self.spelling)
        self.encode = PieceEncoder(self._piece, pattern, capacity)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.transducer.encode(piece.encode("utf-8")), "<u4").tobytes()

    def decode(self, chunks: Iterable[list[int]]) -> Iterator[str]:
        stream = StreamDecoder(self.spelling, self.whole)
        for ids in chunks:
            yield stream.feed(ids)
        yield stream.close()


@cache
def codec(path: str, pattern: str, capacity: int = 300_000, max_arcs: int = MAX_ARCS) -> Codec:
    """The worker process's codec; built once, its states and memo (of ``capacity`` units) carry over to later tasks."""
    return Codec(path, pattern, capacity, max_arcs)


def give_back() -> None:
    """Return memory that this process has freed, but still holds, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def encode_texts(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a binary column of token ids (little-endian, unsigned 32 bits) of the whole text."""
    @F.pandas_udf("binary")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = codec(path, pattern).encode
        for t in texts:
            yield pd.Series([enc(x) if x else b"" for x in t], dtype=object)

    encode.__name__ = "encode"
    return docs.withColumn(out, encode(F.col(text_col)))


def decode_texts(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "text",
                 chunk: int = 4096) -> DataFrame:
    """``tokens`` with the text of a binary column of token ids, decoded as a stream of ``chunk`` ids."""
    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = codec(path, pattern).decode
        for b in ids:
            yield pd.Series(["".join(run(_chunks(x, chunk))) for x in b], dtype=object)

    return tokens.withColumn(out, decode(F.col(ids_col)))


def _chunks(data: bytes | None, size: int) -> Iterator[list[int]]:
    ids = np.frombuffer(data or b"", "<u4")
    for k in range(0, len(ids), size):
        yield ids[k:k + size].tolist()


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               chunk: int = 4096, capacity: int = 300_000, release: bool = False, max_arcs: int = MAX_ARCS) -> DataFrame:
    """Encode every whole text, decode its ids, and return digests of both: id, n_tokens, ids_sha256, decoded_sha256.

    ``capacity``: units the worker's memo holds, ``max_arcs``: arcs its transducer remembers. ``release``: a task
    first returns what earlier stages left in the worker, and gives the codec's memory back when it ends.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if release:
            give_back()
        c = codec(path, pattern, capacity, max_arcs)
        for batch in batches:
            n, ids_hex, text_hex = [], [], []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                digest = hashlib.sha256()
                for part in c.decode(_chunks(ids, chunk)):
                    digest.update(part.encode("utf-8"))
                text_hex.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()),
                 pa.array(text_hex, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        if release:
            codec.cache_clear()
            c = None
            give_back()

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, "
                                "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
