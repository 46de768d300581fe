"""Mergeable co-moments (count, mean, centred products) by fold and class, in one pass over the rows.

Every task reduces its rows to one small record per (fold, class): count, mean
and the matrix of products around the mean.  Records of two disjoint sets of
rows merge without looking at the rows again, so

* one job serves a whole cross-validation: the training set of a fold is the
  merge of all other folds' records, the final fit the merge of all;
* nothing is subtracted, so a fold's fit equals the fit on its own rows up to
  rounding, also where means are large against the spread.

What travels is d x d numbers per task and group, merged one after the other;
the driver gets one record per group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CoMoments:
    """``n`` and ``mean`` per feature; ``products``: centred sums of squares (d) or of all products (d x d)."""

    n: np.ndarray
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, pairs: bool) -> CoMoments:
        """Moments of the rows of ``x``.  Pairs: of rows without a missing value; else feature by feature."""
        there = ~np.isnan(x)
        if pairs:
            x = x[there.all(axis=1)]
            n = np.full(x.shape[1], float(len(x)))
            mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
            y = x - mean
            return cls(n, mean, y.T @ y)
        n = there.sum(axis=0).astype(float)
        mean = np.where(there, x, 0.0).sum(axis=0) / np.maximum(n, 1.0)
        y = np.where(there, x - mean, 0.0)
        return cls(n, mean, (y * y).sum(axis=0))

    def merge(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        safe = np.maximum(n, 1.0)
        gap = other.mean - self.mean
        mean = self.mean + gap * (other.n / safe)
        weight = self.n * other.n / safe
        cross = np.outer(gap, gap) * weight if self.products.ndim == 2 else gap * gap * weight
        return CoMoments(n, mean, self.products + other.products + cross)


def merged(parts: Iterable[CoMoments]) -> CoMoments:
    return reduce(CoMoments.merge, parts)


def _record(sums: dict[tuple, CoMoments]) -> pa.RecordBatch:
    keys, values = list(sums), list(sums.values())
    return pa.RecordBatch.from_pydict({
        "fold": pa.array([k[0] for k in keys], pa.int32()), "class": pa.array([k[1] for k in keys], pa.float64()),
        "n": pa.array([v.n.tobytes() for v in values], pa.binary()),
        "mean": pa.array([v.mean.tobytes() for v in values], pa.binary()),
        "products": pa.array([v.products.tobytes() for v in values], pa.binary())})


def _put(sums: dict[tuple, CoMoments], key: tuple, new: CoMoments) -> None:
    sums[key] = sums[key].merge(new) if key in sums else new


def co_moments(df: DataFrame, exprs: list[str], label: str, fold: str | None = None,
               pairs: bool = True) -> dict[tuple[int, float], CoMoments]:
    """(fold, class) -> moments of the SQL expressions ``exprs``; fold is 0 without a fold column.

    Rows with a null label or fold take no part.
    """
    d = len(exprs)
    shape = (d, d) if pairs else (d,)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, CoMoments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            fold_of, class_of = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = np.column_stack([batch.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
            for f in np.unique(fold_of):
                for c in np.unique(class_of[fold_of == f]):
                    _put(sums, (int(f), float(c)), CoMoments.of(x[(fold_of == f) & (class_of == c)], pairs))
        yield _record(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, CoMoments] = {}
        for batch in batches:
            for r in batch.to_pylist():
                _put(sums, (r["fold"], r["class"]), _parse(r, shape))
        yield _record(sums)

    schema = "fold int, class double, n binary, mean binary, products binary"
    columns = [F.expr(f"CAST({e} AS DOUBLE)").alias(f"x{i}") for i, e in enumerate(exprs)]
    rows = df.select((F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"),
                     F.col(label).cast("double").alias("class"), *columns).where("fold IS NOT NULL AND class IS NOT NULL")
    found = rows.mapInArrow(of_rows, schema).repartition("fold", "class").mapInArrow(add, schema)
    return {(r["fold"], r["class"]): _parse(r, shape) for r in found.collect()}  # a row per fold and class


def _parse(r, shape: tuple[int, ...]) -> CoMoments:
    return CoMoments(np.frombuffer(bytes(r["n"])), np.frombuffer(bytes(r["mean"])),
                     np.frombuffer(bytes(r["products"])).reshape(shape))


def by_class(found: dict[tuple[int, float], CoMoments], without: int | None = None) -> dict[float, CoMoments]:
    """class -> moments over all folds, or over all but one."""
    classes = sorted({c for f, c in found if f != without})
    return {c: merged(m for (f, k), m in sorted(found.items()) if k == c and f != without) for c in classes}
