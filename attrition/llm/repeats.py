"""Repeated word sequences across documents, found by fixed-block anchors.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return, unchanged.  A window is ``window``
consecutive words of one document.  A window is a repeat if the same words also
start earlier: in a document before it, or before it in its own.

1. *Index.*  Every document is cut into non-overlapping blocks of
   ``(window + 1) // 2`` words; whatever window of it is taken, one block lies
   inside.  The blocks' hashes are the index.
2. *Probe.*  Every rolling run of that many words is a probe.  Index entries and
   probes are dealt by hash; a chunk of documents sends each hash once, so a
   block that a third of all documents share costs one entry a chunk.  A hash
   that holds a block and occurs more than once is a hit.
3. *Extend.*  A window around a hit is told by the two runs that cover it from
   both ends (96 bits).  Windows around hits are dealt by the first run, and
   all but the earliest of equal ones are repeats: the earliest one extends
   every hit of its group at once, no pair of occurrences is ever formed.
   Overlapping repeats join to maximal spans.

Between the steps only bit masks travel back to the chunks.

Defined results
- null and empty texts have no words; a text of fewer than ``window`` words has no window;
- documents are ordered by id, null ids first, rows that repeat an id by the hash of their texts; of rows
  that agree in both, one counts as earlier;
- an empty table gives an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .storage import stage
from .words import mix, seeded

#: Entries that a bucket of the index holds on average.
BUCKET_ENTRIES = 2_000_000
#: Bytes that are hashed at a time.
_SPAN = 1 << 21

_U = np.uint64
_KEY_BITS, _FIRST_BUCKET_BIT = _U((1 << 38) - 1), _U(38)
_BYTE = seeded(21, 256)
_PLACE = seeded(22, 64) | _U(1)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Words:
    """The words of a chunk: byte spans, first word of each document, hashes."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def words_of(chunk: chunks.Chunk) -> Words:
    blank = _BLANK[chunk.data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]  # the last byte is a line feed, so every word ends
    first = np.concatenate([np.searchsorted(starts, chunk.starts), [len(starts)]])
    hashes = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + _SPAN, "right")))
        lo, hi = starts[at], ends[stop - 1]
        inside = np.flatnonzero(~blank[lo:hi])
        lengths = ends[at:stop] - starts[at:stop]
        begin = np.cumsum(lengths) - lengths
        place = np.arange(len(inside)) - np.repeat(begin, lengths)
        values = mix(_BYTE[chunk.data[lo:hi][inside]] + (place >> 6).astype(_U)) * _PLACE[place & 63]
        hashes[at:stop] = mix(np.add.reduceat(values, begin) + lengths.astype(_U))
        at = stop
    return Words(starts, ends, first, hashes)


def runs_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of every run of ``size`` words inside a document."""
    n = len(words.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    factors = seeded(23, size) | _U(1)
    total = np.zeros(n, _U)
    for k in range(size):
        total += words.hashes[k:k + n] * factors[k]
    document = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    places = np.flatnonzero(document[:n] == document[size - 1:])
    return places, mix(total[places])


@dataclass(frozen=True)
class Probes:
    """All runs of a chunk, and its distinct hashes in the order (bucket, hash) in which they are sent."""

    words: Words
    places: np.ndarray
    hashes: np.ndarray
    order: np.ndarray
    group: np.ndarray
    keys: np.ndarray
    buckets: np.ndarray


def probes_of(chunk: chunks.Chunk, block: int, n_buckets: int) -> Probes:
    words = words_of(chunk)
    places, hashes = runs_of(words, block)
    bucket = (hashes >> _FIRST_BUCKET_BIT) % _U(n_buckets)
    key = hashes & _KEY_BITS
    order = np.lexsort((key, bucket))
    sorted_key, sorted_bucket = key[order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | (sorted_bucket[1:] != sorted_bucket[:-1])
    begin = np.flatnonzero(new)
    document = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    aligned = (places - words.first[document[places]]) % block == 0
    flags = np.zeros(len(begin), _U)
    if len(begin):
        flags = np.logical_or.reduceat(aligned[order], begin).astype(_U)
        flags |= (np.diff(np.append(begin, len(order))) > 1).astype(_U) << _U(1)
    return Probes(words, places, hashes, order, np.cumsum(new) - 1, sorted_key[begin] << _U(2) | flags,
                  sorted_bucket[begin].astype(np.int64))


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of each stretch of a sorted array."""
    if len(buckets):
        cut = np.flatnonzero(np.diff(buckets)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(buckets)]):
            yield int(buckets[a]), a, b


def _bits(rows: list[tuple[int, bytes]], buckets: np.ndarray) -> np.ndarray:
    """The bit masks that came back for a chunk's entries, by entry; no mask means no bit."""
    mask = np.zeros(len(buckets), bool)
    come = dict(rows)
    for bucket, a, b in _by_bucket(buckets):
        if bucket in come:
            mask[a:b] = np.unpackbits(np.frombuffer(come[bucket], np.uint8), count=b - a)
    return mask


def _open(table: pa.Table) -> chunks.Chunk:
    return chunks.Chunk(table["sizes"][0].as_py(), table["raw"][0].as_py(), table["block"][0].as_py())


@dataclass(frozen=True)
class Windows:
    """The windows of a chunk that hold a hit: start words, and the distinct ones in sending order."""

    starts: np.ndarray
    order: np.ndarray
    group: np.ndarray
    is_first: np.ndarray
    a: np.ndarray
    b: np.ndarray
    buckets: np.ndarray


def windows_of(probes: Probes, hit: np.ndarray, window: int, block: int, n_buckets: int) -> Windows:
    n = len(probes.words.hashes)
    run_at = np.full(n + 1, -1, np.int64)
    run_at[probes.places] = np.arange(len(probes.places))
    is_hit = np.zeros(n + block + 1, np.int64)
    of_run = np.empty(len(probes.order), bool)
    of_run[probes.order] = hit[probes.group]
    is_hit[probes.places] = of_run
    before = np.concatenate([[0], np.cumsum(is_hit)])
    starts = probes.places[probes.places + window <= n]
    last = run_at[starts + window - block]
    near = before[starts + block] - before[starts] > 0
    document = np.repeat(np.arange(len(probes.words.first) - 1), np.diff(probes.words.first))
    whole = near & (last >= 0) & (document[starts] == document[starts + window - 1])
    starts, last = starts[whole], last[whole]
    a, b = probes.hashes[run_at[starts]], probes.hashes[last] >> _U(32)
    bucket = (a >> _FIRST_BUCKET_BIT) % _U(n_buckets)
    order = np.lexsort((starts, b, a, bucket))
    a, b, bucket = a[order], b[order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return Windows(starts, order, np.cumsum(new) - 1, new, a[new], b[new], bucket[new].astype(np.int64))


def _send_probes(block: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                p = probes_of(_open(row), block, n_buckets)
                number, out = row["chunk"][0].as_py(), list(_by_bucket(p.buckets))
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([k for k, _, _ in out], pa.int64()),
                    "chunk": pa.array([number] * len(out), pa.int64()),
                    "low": pa.array([p.keys[a:b].astype("<u4").tobytes() for _, a, b in out], pa.binary()),
                    "high": pa.array([(p.keys[a:b] >> _U(32)).astype(np.uint8).tobytes() for _, a, b in out],
                                     pa.binary())})

    return run


def _masks(table: pa.Table, lengths: np.ndarray, member: np.ndarray) -> pa.Table:
    """One bit mask per sent row that has a bit."""
    ends = np.cumsum(lengths)
    rows = [(c, k, np.packbits(member[e - n:e]).tobytes())
            for c, k, n, e in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), lengths.tolist(), ends.tolist())
            if member[e - n:e].any()]
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()),
                     "bucket": pa.array([r[1] for r in rows], pa.int64()),
                     "mask": pa.array([r[2] for r in rows], pa.binary())})


def _find_hits(table: pa.Table) -> pa.Table:
    low = [np.frombuffer(x, "<u4") for x in table["low"].to_pylist()]
    high = np.frombuffer(b"".join(table["high"].to_pylist()), np.uint8)
    keys = np.concatenate(low).astype(_U) | high.astype(_U) << _U(32)
    order = np.argsort(keys >> _U(2), kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] >> _U(2) != keys[:-1] >> _U(2)]))
    count = np.diff(np.append(begin, len(keys)))
    flags = np.bitwise_or.reduceat(keys & _U(3), begin)
    hit = (flags & _U(1) != 0) & ((count > 1) | (flags & _U(2) != 0))
    member = np.empty(len(keys), bool)
    member[order] = np.repeat(hit, count)
    return _masks(table, np.array([len(x) for x in low]), member)


def _send_windows(window: int, block: int, n_buckets: int):
    def run(chunk: pa.Table, hits: pa.Table) -> pa.Table:
        rows = []
        if chunk.num_rows and hits.num_rows:
            number = chunk["chunk"][0].as_py()
            w = _windows(chunk, _mask_rows(hits), window, block, n_buckets)[1]
            rows = [(number, k, w.a[i:j].tobytes(), w.b[i:j].astype("<u4").tobytes())
                    for k, i, j in _by_bucket(w.buckets)]
        return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()),
                         "bucket": pa.array([r[1] for r in rows], pa.int64()),
                         "a": pa.array([r[2] for r in rows], pa.binary()),
                         "b": pa.array([r[3] for r in rows], pa.binary())})

    return run


def _mask_rows(table: pa.Table) -> list[tuple[int, bytes]]:
    return list(zip(table["bucket"].to_pylist(), table["mask"].to_pylist()))


def _windows(chunk: pa.Table, hits: list[tuple[int, bytes]], window: int, block: int,
             n_buckets: int) -> tuple[Probes, Windows]:
    p = probes_of(_open(chunk), block, n_buckets)
    return p, windows_of(p, _bits(hits, p.buckets), window, block, n_buckets)


def _find_later(table: pa.Table) -> pa.Table:
    """Marks every window but the one of the earliest chunk of each group of equal ones."""
    a = [np.frombuffer(x, _U) for x in table["a"].to_pylist()]
    b = np.frombuffer(b"".join(table["b"].to_pylist()), "<u4")
    lengths = np.array([len(x) for x in a])
    chunk = np.repeat(table["chunk"].to_numpy(), lengths)
    a = np.concatenate(a)
    order = np.lexsort((chunk, b, a))
    a, b = a[order], b[order]
    later = np.zeros(len(a), bool)
    later[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    member = np.empty(len(a), bool)
    member[order] = later
    return _masks(table, lengths, member)


def _covered(w: Windows, later: np.ndarray, n: int, window: int) -> np.ndarray:
    """For each word, whether a repeated window covers it."""
    repeated = np.empty(len(w.order), bool)
    repeated[w.order] = later[w.group] | ~w.is_first
    edge = np.zeros(n + 1, np.int64)
    starts = w.starts[repeated]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def _strip(window: int, block: int, n_buckets: int, id_col: str):
    def run(chunk: pa.Table, masks: pa.Table) -> pa.Table:
        step = np.array(masks["step"].to_pylist(), np.int64)
        hits, later = (_mask_rows(masks.filter(pa.array(step == k))) if len(step) else [] for k in (1, 2))
        opened = _open(chunk)
        p, w = _windows(chunk, hits, window, block, n_buckets)
        words, n = p.words, len(p.words.hashes)
        covered = _covered(w, _bits(later, w.buckets), n, window)
        # the bytes of kept words and the one blank behind each
        edge = np.zeros(len(opened.data) + 1, np.int8)
        edge[words.starts[~covered]] = 1
        np.add.at(edge, words.ends[~covered] + 1, -1)
        keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
        data = opened.data.copy()
        data[words.ends] = 0x20
        kept_bytes = np.concatenate([[0], np.cumsum(keep)])
        out = data[keep].tobytes()
        at = kept_bytes[np.append(opened.starts, len(data))].tolist()
        texts = [out[a:b - 1] if b > a else b"" for a, b in zip(at, at[1:])]
        total = np.concatenate([[0], np.cumsum(covered)])
        # maximal spans of covered words; a span ends where its document does
        first = words.first
        inside = np.zeros(n + 1, bool)
        inside[first[:-1]] = True
        begins = np.flatnonzero(covered & (inside[:n] | ~np.concatenate([[False], covered])[:n]))
        ends = np.flatnonzero(covered & (np.concatenate([inside[1:n], [True]]) | ~np.concatenate([covered[1:], [False]]))
                              ) + 1 if n else begins
        of = np.searchsorted(first, begins, "right") - 1
        counts = np.bincount(of, minlength=len(first) - 1)
        offset = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offset), pa.StructArray.from_arrays(
            [pa.array(begins - first[of], pa.int64()), pa.array(ends - first[of], pa.int64())], ["begin", "end"]))
        return pa.table({
            id_col: chunk["ids"].chunk(0).flatten(),
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(total[first[1:]] - total[first[:-1]], pa.int64()),
            "spans": spans,
            "kept": pa.array([t.decode("utf-8") for t in texts], pa.string())})

    return run


def strip_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20,
                  chunk_bytes: int = chunks.CHUNK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (begin and end word of each maximal repeat), kept text.

    A word goes if a repeated window covers it; windows are judged on the
    input, not on what is left.  Kept words are joined by single spaces.
    """
    if window < 2:
        raise ValueError("a window needs two words or more")
    block = (window + 1) // 2
    packed = stage(chunks.pack(docs, id_col, text_col, chunk_bytes), "chunks")
    size = packed.agg(F.sum("raw")).first()[0] or 0
    # a word has two bytes at least with its blank, some six as a rule; only the load of a bucket depends on it
    n_buckets = 1 + size // (6 * bucket_entries)

    probes = packed.mapInArrow(_send_probes(block, n_buckets), "bucket bigint, chunk bigint, low binary, high binary")
    mask = "chunk bigint, bucket bigint, mask binary"
    hits = stage(probes.groupBy("bucket").applyInArrow(_find_hits, mask), "hits")
    windows = packed.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(
        _send_windows(window, block, n_buckets), "chunk bigint, bucket bigint, a binary, b binary")
    later = windows.groupBy("bucket").applyInArrow(_find_later, mask)
    masks = hits.withColumn("step", F.lit(1)).unionByName(later.withColumn("step", F.lit(2)))
    return packed.groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(
        _strip(window, block, n_buckets, id_col),
        f"`{id_col}` bigint, n_words bigint, n_removed bigint, spans array<struct<begin:bigint,end:bigint>>, kept string")
