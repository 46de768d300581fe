"""Deep trees and forests: the top grown from histograms of all rows, small nodes finished in tasks.

Spark ML keeps every node of every tree with its statistics in the driver and makes a pass (or several) over the
rows for each level.  Without a practical depth limit the nodes grow with the rows.  Here

1. rows are stored once as bin numbers (32 bins a feature, thresholds by Spark ML's rule);
2. a level of all trees is one job: tasks fill histograms of the open nodes, which are added up by node in a
   shuffle; only the chosen splits reach the driver;
3. a node of at most ``task_rows`` rows leaves the top: its rows meet in one group, which grows the whole subtree.

The driver holds the tops alone, about rows / ``task_rows`` nodes a tree; subtrees are a stored table.  Splits are
those of Spark ML (Gini gain, first of equals, no gain or one class ends a node, leaves that agree are pruned), and
the features tried at a node depend on seed, tree and node only, so ``task_rows`` changes no result.

A row is scored by its path through each top; rows that reach a subtree meet it by (tree, node).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .persistence import Persisted

# the functions below travel with the tasks: the executors need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
#: Rows the thresholds are taken from, as in Spark ML.
_THRESHOLD_ROWS = 10_000
#: Histogram cells, and rows, that are worked on together.
_CELLS, _ROWS = 1 << 21, 1 << 14
_EPSILON = np.finfo(float).eps
#: Kinds of nodes that are no inner nodes, in place of a feature.
LEAF, TASK, OPEN = -1, -2, -3

_U = np.uint64
_TREE_FIELDS = {"feature": np.int16, "bin": np.uint8, "left": np.int32, "n0": np.float64, "n1": np.float64}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _key(*parts: int) -> np.uint64:
    out = np.zeros(1, _U)
    for part in parts:
        out = _mix(out * _U(0x9E3779B97F4A7C15) + _U(part + 1))
    return out[0]


def thresholds(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Spark ML's split candidates of a continuous feature, from its sampled values."""
    distinct, counts = np.unique(values, return_counts=True)
    middles = (distinct[:-1] + distinct[1:]) / 2.0
    if len(middles) <= bins - 1:
        return middles
    stride = len(values) / bins
    out, current, target = [], counts[0], stride
    for middle, count in zip(middles, counts[1:]):
        previous, current = current, current + count
        if abs(previous - target) < abs(current - target):
            out.append(middle)
            target += stride
    return np.array(out)


def tried_features(seed: int, tree: int, ids: np.ndarray, d: int, k: int) -> np.ndarray:
    """Per node (by its heap number) the k features tried, ascending."""
    if k >= d:
        return np.tile(np.arange(d), (len(ids), 1))
    draws = _mix((ids.astype(_U) * _U(0x9E3779B97F4A7C15) ^ _key(seed, tree))[:, None] + _key(seed, 7) * np.arange(1, d + 1, dtype=_U))
    return np.sort(np.argpartition(_mix(draws), k - 1, axis=1)[:, :k], axis=1)


_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


def bootstrap_weights(seed: int, tree: int, rows: np.ndarray) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample: Poisson draws of mean 1."""
    unit = (_mix(_mix(rows.astype(_U) + _U(1)) ^ _key(seed, tree, 3)) >> _U(11)).astype(float) * 2.0 ** -53
    return np.searchsorted(_POISSON, unit, "right").astype(float)


def add_histograms(hist: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, tried: np.ndarray) -> None:
    """Add rows to ``hist`` (node, tried feature, bin, class); ``node`` is each row's number in it."""
    k, size = tried.shape[1], hist.size
    for at in range(0, len(x), _ROWS):
        here = node[at:at + _ROWS]
        value = np.take_along_axis(x[at:at + _ROWS], tried[here], axis=1).astype(np.int64)
        cell = (((here[:, None] * k + np.arange(k)) * BINS + value) * 2 + y[at:at + _ROWS, None]).ravel()
        if size > 4 * len(cell):
            np.add.at(hist.reshape(-1), cell, np.repeat(w[at:at + _ROWS], k))
        else:
            hist += np.bincount(cell, np.repeat(w[at:at + _ROWS], k), size).reshape(hist.shape)


def _gini(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    n = n0 + n1
    a, b = n0 / n, n1 / n
    return 1.0 - a * a - b * b


def best_splits(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per node (number of the tried feature, bin, gain); the left side has the bins up to it.  No gain: 0 or less."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist[:, :1].sum(axis=2, keepdims=True)
    right = total - left
    n_left, n_right = left.sum(axis=3), right.sum(axis=3)
    n = total.sum(axis=3)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (_gini(total[..., 0], total[..., 1]) - n_left / n * _gini(left[..., 0], left[..., 1])
                - n_right / n * _gini(right[..., 0], right[..., 1]))
    gain = np.where((n_left >= 1) & (n_right >= 1), gain, -np.inf).reshape(len(hist), -1)
    best = gain.argmax(axis=1)
    return best // (BINS - 1), best % (BINS - 1), gain[np.arange(len(hist)), best]


def _empty_tree() -> dict[str, list]:
    return {name: [] for name in _TREE_FIELDS}


def _ends(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.abs(_gini(n0, n1)) < _EPSILON


def prune(tree: dict[str, np.ndarray], levels: list[tuple[int, int]]) -> None:
    """Inner nodes whose children are leaves of one prediction become leaves, from the last level up."""
    one = tree["n1"] > tree["n0"]
    for lo, hi in reversed(levels):
        inner = lo + np.flatnonzero(tree["feature"][lo:hi] >= 0)
        a = tree["left"][inner]
        both = (tree["feature"][a] == LEAF) & (tree["feature"][a + 1] == LEAF) & (one[a] == one[a + 1])
        tree["feature"][inner[both]] = LEAF


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, root: int, tree: int, seed: int, tried: int, max_depth: int) -> dict:
    """The whole subtree of the node ``root`` (heap number) over its rows, in level order."""
    made, levels, offset = _empty_tree(), [], 0
    ids, node, depth = np.array([root], np.int64), np.zeros(len(x), np.int64), int(root).bit_length() - 1
    while len(ids):
        n = np.bincount(node * 2 + y, w, 2 * len(ids)).reshape(-1, 2)
        feature, split = np.full(len(ids), LEAF, np.int16), np.zeros(len(ids), np.uint8)
        if depth < max_depth:
            going = np.flatnonzero(~_ends(n[:, 0], n[:, 1]))
            number = np.full(len(ids), -1)
            number[going] = np.arange(len(going))
            rows = np.flatnonzero(number[node] >= 0)
            rows = rows[np.argsort(number[node[rows]], kind="stable")]
            sorted_nodes = number[node[rows]]
            step = max(1, _CELLS // (tried * BINS * 2))
            for at in range(0, len(going), step):
                some = going[at:at + step]
                lo, hi = np.searchsorted(sorted_nodes, [at, at + len(some)])
                mine = rows[lo:hi]
                features = tried_features(seed, tree, ids[some], x.shape[1], tried)
                hist = np.zeros((len(some), tried, BINS, 2))
                add_histograms(hist, x[mine], y[mine], w[mine], sorted_nodes[lo:hi] - at, features)
                k, b, gain = best_splits(hist)
                splits = gain > 0
                feature[some[splits]] = features[np.arange(len(some)), k][splits]
                split[some[splits]] = b[splits]
        parents = np.flatnonzero(feature >= 0)
        left = np.zeros(len(ids), np.int32)
        left[parents] = offset + len(ids) + 2 * np.arange(len(parents))
        for name, column in zip(made, (feature, split, left, n[:, 0], n[:, 1])):
            made[name].append(column)
        levels.append((offset, offset + len(ids)))
        go = np.flatnonzero(feature[node] >= 0)
        x, y, w, node = x[go], y[go], w[go], node[go]
        node = left[node] - offset - len(ids) + (x[np.arange(len(x)), feature[node]] > split[node])
        offset += len(ids)
        ids = np.repeat(2 * ids[parents], 2) + np.tile([0, 1], len(parents))
        depth += 1
    out = {name: np.concatenate(parts).astype(_TREE_FIELDS[name]) for name, parts in made.items()}
    prune(out, levels)
    return out


def descend(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The place in ``tree`` where each row's path ends."""
    at = np.zeros(len(x), np.int64)
    going = np.arange(len(x))
    while len(going):
        feature = tree["feature"][at[going]]
        going, feature = going[feature >= 0], feature[feature >= 0]
        here = at[going]
        at[going] = tree["left"][here] + (x[going, feature] > tree["bin"][here])
    return at


def _share(tree: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    return tree["n1"][at] / (tree["n0"][at] + tree["n1"][at])


def _binned(features: pa.Array, cuts: list[np.ndarray]) -> np.ndarray:
    rows = features.flatten().to_numpy(zero_copy_only=False).reshape(len(features), len(cuts))
    return np.column_stack([np.searchsorted(c, rows[:, j]) for j, c in enumerate(cuts)]).astype(np.uint8)


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, d)


class DeepForestModel(Model, Persisted):
    """``score`` is the mean share of class 1 in the leaves a row reaches, ``prediction`` the likelier class.

    ``tops`` has a tree per entry of ``trees`` (numbers in the table ``subtrees``), in the fields of ``_TREE_FIELDS``
    and with the heap numbers of the nodes.
    """

    has_arrays = True
    table_names = ("subtrees",)

    def __init__(self, features_col: str, task_rows: int, cuts: list[np.ndarray], trees: list[int],
                 tops: list[dict[str, np.ndarray]], subtrees: DataFrame):
        super().__init__()
        self.features_col, self.task_rows, self.cuts = features_col, task_rows, cuts
        self.trees, self.tops, self.subtrees = list(trees), tops, subtrees

    def settings(self) -> dict:
        return {"features_col": self.features_col, "task_rows": self.task_rows, "trees": self.trees}

    def arrays(self) -> dict[str, np.ndarray]:
        return ({f"cuts_{j}": c for j, c in enumerate(self.cuts)}
                | {f"{name}_{i}": a for i, top in enumerate(self.tops) for name, a in top.items()})

    def tables(self) -> dict[str, DataFrame]:
        numbers = [int(t) for t in self.trees]
        return {"subtrees": self.subtrees.where(F.col("tree").isin(numbers))}

    @classmethod
    def restored(cls, settings: dict, arrays: dict[str, np.ndarray], parts: dict) -> DeepForestModel:
        cuts = [arrays[f"cuts_{j}"] for j in range(sum(name.startswith("cuts_") for name in arrays))]
        kinds = _TREE_FIELDS | {"id": np.int64}
        tops = [{name: arrays[f"{name}_{i}"].astype(kind) for name, kind in kinds.items()} for i in range(len(settings["trees"]))]
        return cls(cuts=cuts, tops=tops, **settings, **parts)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.score_by_fold(df, {0: self}, None)

    @staticmethod
    def score_by_fold(df: DataFrame, models: dict[int, DeepForestModel], fold_col: str | None) -> DataFrame:
        """Every row scored by its fold's model."""
        one = next(iter(models.values()))
        d, limit = len(one.cuts), 10 * one.task_rows
        owned = {f: (m.cuts, list(zip(m.trees, m.tops))) for f, m in models.items()}
        subtrees = one.subtrees
        for m in models.values():
            subtrees = subtrees if m.subtrees is one.subtrees else subtrees.unionByName(m.subtrees)
        # the row numbers are read several times: they are stored with the rows
        rows = stage(df.withColumn("_row", F.monotonically_increasing_id()), "scored_rows")
        fold = F.col(fold_col).cast("int") if fold_col else F.lit(0)
        given = rows.select("_row", fold.alias("fold"), vector_to_array(one.features_col).alias("x"))

        def paths(batch: pa.RecordBatch):
            """(rows of the batch, their bins, tree, top, where their paths end in it)"""
            folds = batch.column(1).to_numpy(zero_copy_only=False)
            for f, (cuts, trees) in owned.items():
                mine = np.flatnonzero(folds == f)
                if len(mine):
                    x = _binned(batch.column(2).take(pa.array(mine)), cuts)
                    for tree, top in trees:
                        yield mine, x, tree, top, descend(top, x)

        def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total = np.zeros(batch.num_rows)
                for mine, _, _, top, at in paths(batch):
                    leaf = top["feature"][at] == LEAF
                    total[mine[leaf]] += _share(top, at[leaf])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], ["row", "value"])

        def further(with_bins: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    number = batch.column(0).to_numpy()
                    for mine, x, tree, top, at in paths(batch):
                        on = top["feature"][at] == TASK
                        if on.any():
                            columns = [pa.array(np.full(on.sum(), tree, np.int32)), pa.array(top["id"][at[on]])]
                            names = ["tree", "node"]
                            if with_bins:
                                columns += [pa.array(number[mine[on]]), _bytes(x[on])]
                                names += ["row", "x"]
                            yield pa.RecordBatch.from_arrays(columns, names)
            return run

        def follow(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table({"row": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
            tree = {name: np.frombuffer(right.column(name)[0].as_py(), kind) for name, kind in _TREE_FIELDS.items()}
            return pa.table({"row": left.column("row"), "value": _share(tree, descend(tree, _matrix(left.column("x"), d)))})

        # many rows at one node go on in parts
        parts = stage(given.mapInArrow(further(False), "tree int, node long").groupBy("tree", "node").agg(
            F.expr(f"cast((count(1) - 1) div {limit} + 1 as int)").alias("parts")), "node_parts")
        on = (given.mapInArrow(further(True), "tree int, node long, row long, x binary").join(parts, ["tree", "node"])
              .withColumn("part", F.expr("cast(pmod(xxhash64(row), parts) as int)")).drop("parts"))
        there = subtrees.join(parts, ["tree", "node"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = ["tree", "node", "part"]
        found = on.groupBy(*key).cogroup(there.groupBy(*key)).applyInArrow(follow, "row long, value double")
        total = given.mapInArrow(ended, "row long, value double").unionByName(found).groupBy("row").agg(
            (F.sum("value") / F.lit(float(len(one.trees)))).alias("score"))
        out = rows.join(total, F.col("_row") == F.col("row"))
        return (out.withColumn("prediction", (F.round("score", 12) > 0.5).cast("double"))
                .select(*df.columns, "prediction", "score"))


class DeepForest(Estimator, Persisted):
    """Trees over a vector column for labels 0 and 1; ``tried`` features a node: "all" or "sqrt".

    ``fit_folds`` grows the trees of all folds and of the final model side by side.
    """

    def __init__(self, trees: int = 20, max_depth: int = 30, bootstrap: bool = True, tried: str = "sqrt", seed: int = 46,
                 label: str = "label", features_col: str = "features", task_rows: int = 50_000):
        super().__init__()
        self._settings = {"trees": trees, "max_depth": max_depth, "bootstrap": bootstrap, "tried": tried, "seed": seed,
                          "label": label, "features_col": features_col, "task_rows": task_rows}

    def settings(self) -> dict:
        return self._settings

    def _cuts(self, df: DataFrame) -> list[np.ndarray]:
        """Thresholds by feature, from a bounded number of rows as in Spark ML; every row is used for the trees."""
        some = df.select(vector_to_array(self._settings["features_col"]).alias("x"))
        rows = np.array(some.orderBy(F.xxhash64("x")).limit(_THRESHOLD_ROWS).toArrow().column("x").to_pylist(), float)
        return [thresholds(rows[:, j]) for j in range(rows.shape[1])]

    def _train(self, df: DataFrame, fold_col: str | None, folds: list[int]) -> list[DeepForestModel]:
        s = self._settings
        count, seed, max_depth, bootstrap, limit = s["trees"], s["seed"], s["max_depth"], s["bootstrap"], s["task_rows"]
        fold = F.col(fold_col).cast("int") if fold_col else F.lit(-1)
        # a model's thresholds, as its trees, come from the rows outside its fold
        cuts = [self._cuts(df.where(~fold.eqNullSafe(F.lit(f)))) for f in folds]
        d = len(cuts[0])
        tried = d if s["tried"] == "all" else int(np.ceil(np.sqrt(d)))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = batch.column(2).to_numpy(zero_copy_only=False)
                if not np.isin(y, (0.0, 1.0)).all():
                    raise ValueError("labels must be 0 or 1")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(y.astype(np.int8)),
                                                  _bytes(np.column_stack([_binned(batch.column(3), c) for c in cuts]))],
                                                 ["row", "fold", "y", "x"])

        rows = stage(df.select(F.monotonically_increasing_id().alias("row"), fold.alias("fold"), F.col(s["label"]).cast("double").alias("y"),
                               vector_to_array(s["features_col"]).alias("x")).mapInArrow(pack, "row long, fold int, y byte, x binary"),
                     "binned_rows")
        n = rows.count()
        # a tree's number: place of its model in ``folds`` and its number there
        tops = [{"feature": [OPEN if n > limit else TASK], "bin": [0], "left": [0], "n0": [float(n)], "n1": [0.0], "id": [1]}
                for _ in range(count * len(folds))]
        kinds = _TREE_FIELDS | {"id": np.int64}

        def numpy_tops() -> list[dict[str, np.ndarray]]:
            return [{name: np.array(top[name], kind) for name, kind in kinds.items()} for top in tops]

        def used(batch: pa.RecordBatch, now: list[dict], state: int):
            """(tree, rows in a node of that state, their classes, weights, bins, nodes)"""
            number, of, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            bins = _matrix(batch.column(3), d * len(folds))
            for tree, top in enumerate(now):
                if not (top["feature"] == state).any():
                    continue
                x = bins[:, tree // count * d:(tree // count + 1) * d]
                w = bootstrap_weights(seed, tree % count, number) if bootstrap else np.ones(len(x))
                keep = np.flatnonzero((w > 0) & (of != folds[tree // count]))
                at = descend(top, x[keep])
                on = top["feature"][at] == state
                yield tree, y[keep[on]].astype(np.int64), w[keep[on]], x[keep[on]], at[on]

        def level(now: list[dict]):
            start, numbers = 0, []
            for top in now:
                number = np.full(len(top["feature"]), -1)
                is_open = np.flatnonzero(top["feature"] == OPEN)
                number[is_open] = np.arange(len(is_open))
                numbers.append((start, number, tried_features(seed, len(numbers) % count, top["id"][is_open], d, tried)))
                start += len(is_open)

            def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                hist = {}
                for batch in batches:
                    for tree, y, w, x, at in used(batch, now, OPEN):
                        _, number, features = numbers[tree]
                        if tree not in hist:
                            hist[tree] = np.zeros((len(features), tried, BINS, 2))
                        add_histograms(hist[tree], x, y, w, number[at], features)
                for tree, found in hist.items():
                    for k, h in enumerate(found):
                        if h.any():
                            yield pa.RecordBatch.from_pydict({"place": pa.array([numbers[tree][0] + k], pa.int32()),
                                                              "hist": pa.array([h.tobytes()], pa.binary())})

            def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    for place, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        h = np.frombuffer(h).reshape(tried, BINS, 2)
                        total[place] = total[place] + h if place in total else h
                for place, h in total.items():
                    (k,), (b,), (gain,) = best_splits(h[None])
                    left, both = h[k, :b + 1].sum(axis=0), h[k].sum(axis=0)
                    columns = {"place": pa.array([place], pa.int32()), "k": pa.array([k], pa.int32()), "bin": pa.array([b], pa.int32()),
                               "gain": pa.array([gain])}
                    numbers_ = dict(zip(("l0", "l1", "n0", "n1"), (pa.array([float(v)]) for v in (*left, *both))))
                    yield pa.RecordBatch.from_pydict(columns | numbers_)

            # a row per open node: at most rows / task_rows a tree
            found = (rows.mapInArrow(fill, "place int, hist binary").repartition("place")
                     .mapInArrow(choose, "place int, k int, bin int, gain double, l0 double, l1 double, n0 double, n1 double").collect())
            return {r["place"]: r for r in found}, numbers

        def state_of(n0: float, n1: float, heap: int) -> int:
            if not n0 or not n1 or heap.bit_length() - 1 >= max_depth:
                return LEAF
            return OPEN if n0 + n1 > limit else TASK

        while any(OPEN in top["feature"] for top in tops):
            found, numbers = level(numpy_tops())
            for top, (start, number, features) in zip(tops, numbers):
                for i in np.flatnonzero(number >= 0).tolist():
                    r = found.get(start + int(number[i]))
                    top["feature"][i] = LEAF
                    if r is None:  # no rows: all are of the left-out fold
                        continue
                    top["n0"][i], top["n1"][i] = r["n0"], r["n1"]
                    if r["gain"] > 0:
                        top["feature"][i], top["bin"][i] = int(features[number[i], r["k"]]), r["bin"]
                        top["left"][i] = len(top["feature"])
                        for side, (n0, n1) in enumerate(((r["l0"], r["l1"]), (r["n0"] - r["l0"], r["n1"] - r["l1"]))):
                            heap = 2 * top["id"][i] + side
                            for name, value in zip(kinds, (state_of(n0, n1, heap), 0, 0, n0, n1, heap)):
                                top[name].append(value)
        now = numpy_tops()

        def hand_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for tree, y, w, x, at in used(batch, now, TASK):
                    if len(x):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(x), tree, np.int32)), pa.array(now[tree]["id"][at]), pa.array(y.astype(np.int8)),
                             pa.array(w.astype(np.float32)), _bytes(x)], ["tree", "node", "y", "w", "x"])

        def finish(group: pa.Table) -> pa.Table:
            tree, root = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
            made = grow(_matrix(group.column("x"), d), group.column("y").to_numpy().astype(np.int64),
                        group.column("w").to_numpy().astype(float), root, tree % count, seed, tried, max_depth)
            head = {"tree": pa.array([tree], pa.int32()), "node": pa.array([root], pa.int64()), "leaf": pa.array([bool(made["feature"][0] == LEAF)]),
                    "c0": pa.array([float(made["n0"][0])]), "c1": pa.array([float(made["n1"][0])])}
            return pa.table(head | {name: pa.array([made[name].tobytes()], pa.binary()) for name in _TREE_FIELDS})

        schema = "tree int, node long, leaf boolean, c0 double, c1 double, " + ", ".join(f"{name} binary" for name in _TREE_FIELDS)
        subtrees = stage(rows.mapInArrow(hand_over, "tree int, node long, y byte, w float, x binary")
                         .groupBy("tree", "node").applyInArrow(finish, schema), "subtrees")
        places = [{int(heap): i for i, heap in enumerate(top["id"])} for top in now]
        for r in subtrees.where("leaf").select("tree", "node", "c0", "c1").toLocalIterator():
            top, i = now[r["tree"]], places[r["tree"]][r["node"]]
            top["feature"][i], top["n0"][i], top["n1"][i] = LEAF, r["c0"], r["c1"]
        for top in now:
            prune(top, [(i, i + 1) for i in range(len(top["feature"]))])
        subtrees = subtrees.where("NOT leaf")
        return [DeepForestModel(s["features_col"], limit, cuts[m], list(range(m * count, (m + 1) * count)),
                                now[m * count:(m + 1) * count], subtrees) for m in range(len(folds))]

    def _fit(self, df: DataFrame) -> DeepForestModel:
        return self._train(df, None, [-2])[0]

    def fit_folds(self, df: DataFrame, fold_col: str = "fold"):
        from .models import FoldModels

        folds = [r[0] for r in df.select(F.col(fold_col).cast("int")).distinct().orderBy(fold_col).collect()]
        *by_fold, full = self._train(df, fold_col, [*folds, -2])
        return FoldModels(dict(zip(folds, by_fold)), full)
