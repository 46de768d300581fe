"""Words of text columns as 64-bit hashes, computed over whole Arrow buffers.

A word is a run of ASCII letters and digits and of non-ASCII characters, in
lower case; anything else separates.  The hash of a word depends on its bytes
alone, so it is the same in every task and session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at a time; a longer text is cut at a space near each multiple.
SPAN_BYTES = 1 << 21

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + mix(np.array([seed], _U)))


_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BYTE = seeded(11, 256)
_PLACE = seeded(12, 64) | _U(1)


def _span_words(data: np.ndarray, edges: np.ndarray, beginnings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words in ``data``; no word crosses one of ``edges``.

    Row 0 of the hashes has whole words, each further row the words' first
    so many bytes (0 where a word is not longer than that).
    """
    letter = _LETTERS[data]
    edges = edges[(edges >= 0) & (edges <= len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    before[edges[edges < len(data)]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = letter[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(letter & ~before)
    ends = np.flatnonzero(letter & ~after) + 1
    if not len(starts):
        return starts, np.zeros((1 + len(beginnings), 0), _U)
    inside = np.flatnonzero(letter)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    values = mix(_BYTE[data[inside]] + (place // 64).astype(_U)) * _PLACE[place % 64]
    hashes = [mix(np.add.reduceat(values, first) + lengths.astype(_U))]
    for k in beginnings:
        some = np.add.reduceat(np.where(place < k, values, _U(0)), first)
        hashes.append(np.where(lengths > k, mix(some + _U(k << 32)), _U(0)))
    return starts, np.stack(hashes)


def _spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SPAN_BYTES that end at a text's end or, within a long text, behind a space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + SPAN_BYTES, end)
        if stop < end:
            k = int(np.searchsorted(offsets, stop, "right")) - 1
            if offsets[k] > at:
                stop = int(offsets[k])
            else:
                text_end = int(offsets[k + 1])
                while stop < text_end:
                    blank = np.flatnonzero(data[stop:min(stop + SPAN_BYTES, text_end)] == 0x20)
                    if len(blank):
                        stop += int(blank[0]) + 1
                        break
                    stop = min(stop + SPAN_BYTES, text_end)
        yield at, stop
        at = stop


def hashed_words(texts: pa.Array, beginnings: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, hash of each word), in text order; null texts have no words.

    With ``beginnings`` the hashes are a matrix: whole words, then their first
    so many bytes.
    """
    texts = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros((1 + len(beginnings), 0), _U)]
    for lo, hi in _spans(data, offsets) if len(texts) else ():
        starts, h = _span_words(data[lo:hi], offsets - lo, beginnings)
        rows.append(np.searchsorted(offsets, starts + lo, "right") - 1)
        hashes.append(h)
    found = np.concatenate(hashes, axis=1)
    return np.concatenate(rows), found if beginnings else found[0]


def shingles(rows: np.ndarray, words: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each run of ``size`` words; a text of fewer words is one run."""
    if not len(words):
        return rows, words
    factors = seeded(13, size) | _U(1)
    n = len(words)
    total = np.zeros(n, _U)
    count = np.zeros(n, _U)
    for k in range(min(size, n)):
        same = rows[k:] == rows[:n - k]
        total[:n - k] += np.where(same, words[k:] * factors[k], _U(0))
        count[:n - k] += same.astype(_U)
    first = np.ones(n, bool)
    first[1:] = rows[1:] != rows[:-1]
    keep = (count == size) | first
    return rows[keep], mix(total + count)[keep]
