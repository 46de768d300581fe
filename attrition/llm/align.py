"""Alignment of two tokenizers over the same bytes by diagonal run skipping.

The token bytes of tokenizer A (a byte-level file of the tokenizers library, on
space + text) and of tokenizer B (a sentencepiece model, which adds the space
itself) spell the same text; the places where tokens of both end cut it into
groups.  Most groups are one token of each: there the end arrays agree at a
constant index shift.  From a common end on, stretches of 1, 2, 4, ... ends are
compared at the current shift as long as they agree, the rest of the last
stretch one by one; the irregular group behind it is resolved by
stepping the side that is behind, which gives the next shift.

A link is the pair of tokens that end at a group's end.  Links are counted over
all documents by an ordinary aggregate of (A id, B id) with one row per chunk
of documents and pair, and each chunk gets the counts of its pairs back.

Defined results
- null and empty texts, and texts whose joined token bytes of A or B are not space + text, have no tokens;
- strings of special tokens inside texts are ordinary text;
- rows are independent: null and repeated ids, and repeated rows, give a row each, and their links count each time;
- an empty table gives an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage
from .token_files import _byte_letters, _plain

#: A chunk is closed by the document that fills it to so many tokens of A.
CHUNK_TOKENS = 1_000_000


class Tokenizer:
    """Ids of whole texts (with the space before them), and each id's bytes."""

    def __init__(self, encode: Callable[[str], list[int]], spelled: list[bytes]):
        self.encode, self.spelled = encode, spelled
        self.lengths = np.array([len(b) for b in spelled], np.int64)
        self.names = np.array([str(i) for i in range(len(spelled))], "S")


@cache
def byte_level(path: str, pattern: str) -> Tokenizer:
    """Tokenizer A of a worker process: ids of space + text.

    A byte-level file whose ids follow the order of its merges says the same
    as a table of ranks, which the tiktoken library encodes faster; any other
    file goes through the tokenizers library.
    """
    import tiktoken
    import tokenizers

    with open(path, encoding="utf-8") as f:
        form = json.load(f)
    vocab = form["model"]["vocab"]
    letters = {c: b for b, c in _byte_letters().items()}
    spelled = [b""] * (1 + max(vocab.values()))
    ranks = {}
    special = {t["content"] for t in form.get("added_tokens", ())}
    for token, i in vocab.items():
        spelled[i] = bytes(letters[c] for c in token)
        if token not in special:
            ranks[spelled[i]] = i
    merges = [m if isinstance(m, list) else m.split(" ") for m in form["model"]["merges"]]
    made = [vocab["".join(m)] for m in merges]
    if _plain(form) and made == list(range(256, 256 + len(made))) and sorted(ranks.values()) == list(range(len(ranks))):
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return Tokenizer(lambda text: encode(" " + text), spelled)
    library = tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return Tokenizer(lambda text: library.encode(" " + text, add_special_tokens=False).ids, spelled)


@cache
def sentence_pieces(path: str) -> Tokenizer:
    """Tokenizer B of a worker process: ids of the text, before which the model puts a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    spelled = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode("utf-8")
               for i, p in enumerate(pieces)]
    return Tokenizer(lambda text: model.encode(text, num_threads=1), spelled)


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of A and of B up to the end of each group; the last ends of both are equal."""
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    n_a, n_b = len(a), len(b)
    i = j = 0
    first_a, first_b, runs = [], [], []  # stretches of one-to-one groups, or a single group of any kind
    while i < n_a:
        if a[i] == b[j]:
            run, step = 1, 1
            while True:
                step = min(step, n_a - i - run, n_b - j - run)
                x, y = 8 * (i + run), 8 * (j + run)
                if step and raw_a[x:x + 8 * step] == raw_b[y:y + 8 * step]:
                    run += step
                    step *= 2
                else:
                    break
            if step > 1:
                while a[i + run] == b[j + run]:
                    run += 1
            first_a.append(i + 1)
            first_b.append(j + 1)
            runs.append(run)
            i += run
            j += run
            if i == n_a:
                break
        at_a, at_b = a[i], b[j]
        while at_a != at_b:
            if at_a < at_b:
                i += 1
                at_a = a[i]
            else:
                j += 1
                at_b = b[j]
        i += 1
        j += 1
        first_a.append(i)
        first_b.append(j)
        runs.append(1)
    lengths = np.array(runs, np.int64)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return (np.repeat(np.array(first_a, np.int64), lengths) + within,
            np.repeat(np.array(first_b, np.int64), lengths) + within)


class Aligned:
    """One text's ids, the token counts up to each group's end, and its links (A id << 32 | B id)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, upto_a: np.ndarray, upto_b: np.ndarray):
        self.a, self.b, self.upto_a, self.upto_b = a, b, upto_a, upto_b
        self.links = a[upto_a - 1].astype(np.uint64) << np.uint64(32) | b[upto_b - 1].astype(np.uint64)

    def groups(self, names_a: Sequence[str] | np.ndarray, names_b: Sequence[str] | np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the decimal ids of each group, put in place as bytes of equal width."""
        if not len(self.a):
            return ""
        a, b = (n if isinstance(n, np.ndarray) else np.array(n, "S") for n in (names_a, names_b))
        wide = max(a.itemsize, b.itemsize)
        # an id goes behind its side's ids before it and the other side's ids of the groups before it (for B: and of its own)
        size_a, size_b = np.diff(self.upto_a, prepend=0), np.diff(self.upto_b, prepend=0)
        to_a = np.arange(len(self.a)) + np.repeat(self.upto_b - size_b, size_a)
        to_b = np.arange(len(self.b)) + np.repeat(self.upto_a, size_b)
        name, mark = np.empty(len(self.a) + len(self.b), f"S{wide}"), np.full(len(self.a) + len(self.b), b",", "S1")
        name[to_a], name[to_b] = a[self.a], b[self.b]
        mark[to_a[self.upto_a - 1]], mark[to_b[self.upto_b - 1]] = b"|", b";"
        rows = np.column_stack([name.view(np.uint8).reshape(-1, wide), mark.view(np.uint8)])
        return rows.tobytes().translate(None, b"\0")[:-1].decode("ascii")


NOTHING = Aligned(*[np.zeros(0, np.int64)] * 4)


def align_text(text: str | None, a: Tokenizer, b: Tokenizer) -> Aligned:
    if not text:
        return NOTHING
    ids_a, ids_b = a.encode(text), b.encode(text)
    whole = (" " + text).encode("utf-8")
    for t, ids in ((a, ids_a), (b, ids_b)):
        if b"".join(map(t.spelled.__getitem__, ids)) != whole:
            return NOTHING
    ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    return Aligned(ids_a, ids_b, *group_ends(np.cumsum(a.lengths[ids_a]), np.cumsum(b.lengths[ids_b])))


def groups(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(id, groups): the alignment of each document in text form; '' without tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path, pattern), sentence_pieces(b_path)
        for batch in batches:
            out = [align_text(t.as_py(), a, b).groups(a.names, b.names) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "groups"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` bigint, groups string")


_CHUNK = ("chunk bigint, ids array<bigint>, n_a binary, n_b binary, n_links binary, sha array<string>, "
          "pairs binary, counts binary, slots binary, n_slots bigint")


def _aligned_chunks(a_path: str, pattern: str, b_path: str, chunk_tokens: int):
    def row(number: int, ids: list, found: list[tuple]) -> pa.RecordBatch:
        links = np.concatenate([f[2] for f in found])
        slots, pairs = pd.factorize(links)
        counts = np.bincount(slots, minlength=len(pairs))
        packed = slots.astype("<u4").tobytes()
        return pa.RecordBatch.from_pydict({
            "chunk": pa.array([number], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
            "n_a": pa.array([np.array([f[0] for f in found], "<i8").tobytes()], pa.binary()),
            "n_b": pa.array([np.array([f[1] for f in found], "<i8").tobytes()], pa.binary()),
            "n_links": pa.array([np.array([len(f[2]) for f in found], "<i8").tobytes()], pa.binary()),
            "sha": pa.array([[f[3] for f in found]], pa.list_(pa.string())),
            "pairs": pa.array([pairs.astype("<u8").tobytes()], pa.binary()),
            "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary()),
            "slots": pa.array([pa.compress(packed, codec="zstd", asbytes=True)], pa.binary()),
            "n_slots": pa.array([len(slots)], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path, pattern), sentence_pieces(b_path)
        number, ids, found, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                one = align_text(text.as_py(), a, b)
                sha = hashlib.sha256(one.groups(a.names, b.names).encode()).hexdigest() if len(one.a) else ""
                ids.append(i)
                found.append((len(one.a), len(one.b), one.links, sha))
                held += len(one.a)
                if held >= chunk_tokens:
                    yield row(number, ids, found)
                    number, ids, found, held = number + 1, [], [], 0
        if ids:
            yield row(number, ids, found)

    return run


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, pairs, counts in zip(*[c.to_pylist() for c in batch.columns]):
            pairs = np.frombuffer(pairs, "<u8")
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array(np.full(len(pairs), number), pa.int64()),
                "slot": pa.array(np.arange(len(pairs)), pa.int32()),
                "a": pa.array(pairs >> np.uint64(32), pa.int32()),
                "b": pa.array(pairs & np.uint64(0xFFFFFFFF), pa.int32()),
                "n": pa.array(np.frombuffer(counts, "<i8"), pa.int64())})


def link_counts(pair_rows: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links hold the pair, and whether no other pair of the same b has more."""
    counts = stage(pair_rows.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def _finish(id_col: str):
    def run(chunk: pa.Table, slots: pa.Table) -> pa.Table:
        get = lambda name: chunk[name][0].as_py()
        n = np.frombuffer(get("n_links"), "<i8")
        size = len(get("pairs")) // 8
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = slots["slot"].to_numpy()
        count[at] = slots["count"].to_numpy()
        best[at] = slots["best"].to_numpy()
        packed = pa.decompress(get("slots"), decompressed_size=4 * get("n_slots"), codec="zstd", asbytes=True)
        of_link = np.frombuffer(packed, "<u4")
        edge = np.concatenate([[0], np.cumsum(n)])
        sums = [np.concatenate([[0], np.cumsum(x[of_link])]) for x in (best, count)]
        per_doc = [s[edge[1:]] - s[edge[:-1]] for s in sums]
        return pa.table({
            id_col: pa.array(get("ids"), pa.int64()), "n_a": pa.array(np.frombuffer(get("n_a"), "<i8")),
            "n_b": pa.array(np.frombuffer(get("n_b"), "<i8")), "n_groups": pa.array(n), "n_links": pa.array(n),
            "n_best": pa.array(per_doc[0], pa.int64()), "count_sum": pa.array(per_doc[1], pa.int64()),
            "groups_sha256": pa.array(get("sha"), pa.string())})

    return run


def link_statistics(docs: DataFrame, a_path: str, pattern: str, b_path: str, id_col: str = "doc_id",
                    text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``n_best``: links whose pair is the most frequent one of its B id in the
    corpus; ``count_sum``: the corpus counts of its links, added up.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chunks = stage(rows.mapInArrow(_aligned_chunks(a_path, pattern, b_path, chunk_tokens), _CHUNK), "aligned")
    pairs = chunks.select("chunk", "pairs", "counts").mapInArrow(
        _pair_rows, "chunk bigint, slot int, a int, b int, n bigint")
    known = pairs.drop("n").join(link_counts(pairs), ["a", "b"]).select("chunk", "slot", "count", "best")
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        _finish(id_col), f"`{id_col}` bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
        "count_sum bigint, groups_sha256 string")
