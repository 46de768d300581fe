"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1.  The vector of three
letters in a row is the product of their vectors, the first rotated by two
places and the second by one; a text's profile is the sum over its trigrams, a
language's prototype the sum of the unit profiles of its training texts.  A text
goes to the prototype of largest cosine.

Runs of characters other than letters count as one space, which takes part in
trigrams; texts are in lower case.

Defined results: ``und`` with score 0 for a null text or one without letters,
and for all texts if nothing can be learned; ties go to the first language in
code-point order; a text longer than ``SPAN`` characters is profiled span by
span; repeated rows get equal results; a null id counts as the empty text in
the split and is held out; extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, seeded

#: Components of a vector.
SIZE = 1024
#: Characters of a text that are turned into trigrams at a time.
SPAN = 1 << 20
#: Trigram vectors that a worker keeps.
KEPT = 40_000

_U = np.uint64
_SPACE = 0x20


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct trigrams, counts); a trigram is three code points of 21 bits. Empty if there is no letter."""
    codes = []
    for at in range(0, len(text), SPAN):
        points = np.frombuffer(text[at:at + SPAN].lower().encode("utf-32-le", "replace"), "<u4")
        letter = _is_letter()[points]
        if not letter.any():
            continue
        points = np.concatenate([[_SPACE], np.where(letter, points, _SPACE), [_SPACE]]).astype(_U)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != _SPACE) | (points[:-1] != _SPACE)
        points = points[keep]
        codes.append(points[:-2] << _U(42) | points[1:-1] << _U(21) | points[2:])
    return np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, _U), np.zeros(0, np.int64))


class Vectors:
    """Trigram vectors, made when first needed; a bounded number is kept."""

    def __init__(self, size: int = SIZE, kept: int = KEPT):
        self.size, self.kept = size, kept
        self.factors = seeded(31, size // 64) | _U(1)
        self.place: dict[int, int] = {}
        self.rows = np.zeros((0, size), np.int8)

    def letters(self, points: np.ndarray) -> np.ndarray:
        bits = mix(mix(points[:, None] + _U(1)) * self.factors[None, :])
        return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) << 1) - 1

    def make(self, codes: np.ndarray) -> np.ndarray:
        part = _U((1 << 21) - 1)
        first, second, third = (self.letters(codes >> _U(s) & part) for s in (42, 21, 0))
        return np.roll(first, 2, axis=1) * np.roll(second, 1, axis=1) * third

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) > self.kept:
            return self.make(codes)
        new = [c for c in codes.tolist() if c not in self.place]
        if len(self.place) + len(new) > self.kept:
            self.place, self.rows, new = {}, self.rows[:0], codes.tolist()
        if new:
            start = len(self.place)
            if start + len(new) > len(self.rows):
                grown = np.zeros((min(self.kept, max(2 * len(self.rows), start + len(new))), self.size), np.int8)
                grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start:start + len(new)] = self.make(np.array(new, _U))
            self.place.update(zip(new, range(start, start + len(new))))
        return self.rows[[self.place[c] for c in codes.tolist()]]


@cache
def _vectors() -> Vectors:
    return Vectors()


def profile(text: str | None) -> np.ndarray | None:
    """The unit profile of a text; None without letters."""
    codes, counts = trigrams(text or "")
    if not len(codes):
        return None
    vectors, total = _vectors(), np.zeros(SIZE)
    for at in range(0, len(codes), 4096):
        total += counts[at:at + 4096].astype(np.float32) @ vectors(codes[at:at + 4096]).astype(np.float32)
    norm = np.sqrt(total @ total)
    return total / norm if norm else None


def held_out(id_col: str) -> F.Column:
    """One fifth of the documents, by id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sum_profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            found = profile(text.as_py())
            if found is not None:
                lang = lang.as_py()
                sums[lang] = sums[lang] + found if lang in sums else found
    yield _sums(sums)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            vector = np.frombuffer(vector)
            sums[lang] = sums[lang] + vector if lang in sums else vector
    yield _sums(sums)


def _sums(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()),
                                       pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "vector"])


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages in order, their unit prototypes), learned from all rows with a language.

    What is shuffled and what reaches the driver is one vector per language (and task).
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    partial = known.mapInArrow(_sum_profiles, "lang string, vector binary")
    found = partial.repartition("lang").mapInArrow(_add, "lang string, vector binary").collect()
    found = sorted((r["lang"], np.frombuffer(r["vector"])) for r in found) if found else []
    matrix = np.array([v / max(np.sqrt(v @ v), 1e-300) for _, v in found]).reshape(len(found), SIZE)
    return [lang for lang, _ in found], matrix


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of every row; only the text decides."""
    model = docs.sparkSession.sparkContext.broadcast((languages, matrix))  # a vector per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = model.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(2):
                found = profile(text.as_py()) if names else None
                if found is None:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cosines = rows @ found
                best = int(cosines.argmax())
                langs.append(names[best])
                scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             [id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, held_out boolean, "
                                "lang_pred string, score double")
