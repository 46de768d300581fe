"""Classifiers with one ``fit(df) -> model``, ``model.transform(df)`` surface.

Spark ML estimators are used where Spark has the algorithm. The others are
written as distributed moment aggregates plus a small driver-side solve
(d x d at most, d = number of features), scored with column expressions:

* ``LinearDiscriminant`` – class means and pooled covariance from co-moments, one pass;
* ``GaussianNaiveBayes`` – per-class mean / variance from co-moments, log-likelihood argmax;
* ``SGDLogistic`` – mini-batch descent inside the tasks, models averaged after every epoch;
* ``NearestNeighbours`` – all training rows, broadcast if they are few, else stored in blocks (``neighbours``);
* ``RandomFeatureSVM`` – random Fourier features (RBF kernel) + ``LinearSVC``.

Custom models take SQL feature expressions (column names or e.g.
``element_at(embedding, 3)``) and add ``score`` (probability of class 1 for
binary labels) and ``prediction``. They are Spark ML estimators and models:
they can be stages of a ``Pipeline``, and be saved and loaded (``persistence``).
The first three and ``trees.DeepForest`` also have
``fit_folds(df, fold) -> FoldModels``: all fits of a cross-validation and the
final one from the same passes over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import dlit
from ..sources.staging import stage
from . import neighbours
from .moments import CoMoments, by_class, co_moments, merged
from .persistence import Persisted
from .trees import DeepForest

FEATURES = "features"


def _expr_list(features) -> list[str]:
    return [f if any(ch in f for ch in "()` ") else f"`{f}`" for f in features]


def _dot(exprs: list[str], w, b: float = 0.0) -> str:
    terms = [f"{dlit(float(wi))} * CAST({e} AS DOUBLE)" for e, wi in zip(exprs, w)]
    return "(" + " + ".join([dlit(b), *terms]) + ")"


# ---------------------------------------------------------------- Spark ML natives


#: Trees up to this depth, whose nodes have a bound, are Spark ML's; deeper ones are ``trees.DeepForest``.
SPARK_TREE_DEPTH = 10


def extra_trees(num_trees: int = 20, max_depth: int = 30, seed: int = 46, label: str = "label"):
    """Randomised trees without bootstrap on random feature subsets (split thresholds are not random)."""
    if max_depth > SPARK_TREE_DEPTH:
        return DeepForest(num_trees, max_depth, bootstrap=False, seed=seed, label=label, features_col=FEATURES)
    return RandomForestClassifier(numTrees=num_trees, bootstrap=False, featureSubsetStrategy="sqrt",
                                  maxDepth=max_depth, seed=seed, labelCol=label, featuresCol=FEATURES)


def random_forest(num_trees: int = 20, max_depth: int = 30, seed: int = 46, label: str = "label"):
    if max_depth > SPARK_TREE_DEPTH:
        return DeepForest(num_trees, max_depth, seed=seed, label=label, features_col=FEATURES)
    return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed, labelCol=label,
                                  featuresCol=FEATURES)


def gradient_boosting(max_iter: int = 100, max_depth: int = 3, step: float = 0.1, seed: int = 46,
                      label: str = "label"):
    return GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step, seed=seed, labelCol=label,
                         featuresCol=FEATURES)


def decision_tree(max_depth: int = 30, seed: int = 46, label: str = "label"):
    if max_depth > SPARK_TREE_DEPTH:
        return DeepForest(1, max_depth, bootstrap=False, tried="all", seed=seed, label=label, features_col=FEATURES)
    return DecisionTreeClassifier(maxDepth=max_depth, seed=seed, labelCol=label, featuresCol=FEATURES)


def logistic_regression(max_iter: int = 20, reg: float = 0.0, elastic_net: float = 0.0, label: str = "label"):
    """``elastic_net=1`` with ``reg > 0`` gives the sparse (L1) weights of a lasso fit."""
    return LogisticRegression(maxIter=max_iter, regParam=reg, elasticNetParam=elastic_net, labelCol=label,
                              featuresCol=FEATURES)


def naive_bayes_native(label: str = "label"):
    return NaiveBayes(modelType="gaussian", labelCol=label, featuresCol=FEATURES)


# ---------------------------------------------------------------- all folds at once


class FoldModels:
    """The models of a cross-validation and the one of all rows (``full``)."""

    def __init__(self, by_fold: dict[int, object], full):
        self.by_fold, self.full = by_fold, full

    def transform(self, df: DataFrame, fold_col: str = "fold") -> DataFrame:
        """Every row scored by the model that has not seen its fold; one pass, no union of folds."""
        return type(self.full).score_by_fold(df, self.by_fold, fold_col)


def _logistic_columns(df: DataFrame, z: str) -> DataFrame:
    out = df.withColumn("_z", F.expr(z)).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))))
    return out.withColumn("prediction", (F.col("_z") > 0).cast("double")).drop("_z")


class _Trainer(Estimator, Persisted):
    """An estimator whose constructor arguments are its settings."""

    def __init__(self, **settings):
        super().__init__()
        self._settings = settings

    def settings(self) -> dict:
        return self._settings


class LinearScoreModel(Model, Persisted):
    """``score = 1 / (1 + exp(-(w x + b)))``, class 1 where it is above one half."""

    has_arrays = True

    def __init__(self, exprs: list[str], w: np.ndarray, b: float):
        super().__init__()
        self.exprs, self.w, self.b = list(exprs), np.asarray(w, float), float(b)

    def settings(self) -> dict:
        return {"exprs": self.exprs}

    def arrays(self) -> dict[str, np.ndarray]:
        return {"w": self.w, "b": np.array(self.b)}

    def decision_sql(self) -> str:
        return _dot(self.exprs, self.w, self.b)

    def _transform(self, df: DataFrame) -> DataFrame:
        return _logistic_columns(df, self.decision_sql())

    @staticmethod
    def score_by_fold(df: DataFrame, models: dict[int, LinearScoreModel], fold_col: str) -> DataFrame:
        cases = " ".join(f"WHEN {i} THEN {m.decision_sql()}" for i, m in models.items())
        return _logistic_columns(df, f"CASE `{fold_col}` {cases} END")


# ---------------------------------------------------------------- linear discriminant


class LinearDiscriminantModel(LinearScoreModel):
    pass


class LinearDiscriminant(_Trainer):
    """Two-class LDA: shared covariance (pooled, divided by n - 2), priors from class sizes.

    Rows with a missing feature or label are not used. Directions in which the
    standardised features do not vary (relative eigenvalue below ``tol``, as
    with collinear features) get no weight.
    """

    def __init__(self, features, label: str = "label", tol: float = 1e-9):
        super().__init__(features=list(features), label=label, tol=tol)
        self.exprs = _expr_list(features)
        self.label, self.tol = label, tol

    def _solve(self, moments: dict[float, CoMoments]) -> LinearDiscriminantModel:
        if set(moments) != {0.0, 1.0}:
            raise ValueError(f"two classes 0/1 are needed, got {sorted(moments)}")
        low, high = moments[0.0], moments[1.0]
        n0, n1 = float(low.n[0]), float(high.n[0])
        cov = (low.products + high.products) / max(n0 + n1 - 2, 1)
        std = np.sqrt(np.diag(cov))
        scale = np.where(std > 0, 1.0 / np.where(std > 0, std, 1.0), 0.0)
        inverse = np.linalg.pinv(cov * np.outer(scale, scale), rcond=self.tol, hermitian=True)
        w = scale * (inverse @ (scale * (high.mean - low.mean)))
        b = float(-0.5 * (high.mean + low.mean) @ w + math.log(n1 / n0))
        return LinearDiscriminantModel(self.exprs, w, b)

    def _fit(self, df: DataFrame) -> LinearDiscriminantModel:
        return self._solve(by_class(co_moments(df, self.exprs, self.label)))

    def fit_folds(self, df: DataFrame, fold_col: str = "fold") -> FoldModels:
        found = co_moments(df, self.exprs, self.label, fold_col)
        folds = sorted({f for f, _ in found})
        return FoldModels({f: self._solve(by_class(found, without=f)) for f in folds}, self._solve(by_class(found)))


# ---------------------------------------------------------------- Gaussian naive Bayes


class GaussianNaiveBayesModel(Model, Persisted):
    has_arrays = True

    def __init__(self, exprs: list[str], classes: list, priors, means, variances):
        super().__init__()
        self.exprs, self.classes = list(exprs), [float(c) for c in classes]
        self.priors, self.means, self.vars = (np.asarray(v, float) for v in (priors, means, variances))

    def settings(self) -> dict:
        return {"exprs": self.exprs, "classes": self.classes}

    def arrays(self) -> dict[str, np.ndarray]:
        return {"priors": self.priors, "means": self.means, "variances": self.vars}

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.score_by_fold(df, {0: self}, None)

    @staticmethod
    def score_by_fold(df: DataFrame, models: dict[int, GaussianNaiveBayesModel], fold_col: str | None) -> DataFrame:
        """Log-likelihoods of Arrow batches as matrix products, whatever the number of features and classes.

        With z the feature standardised by a class, its terms are -z^2 / 2. A missing feature gives no prediction.
        """
        one = next(iter(models.values()))
        exprs = one.exprs

        @F.arrow_udf("struct<prediction:double,score:double>")
        def judge(fold: pa.Array, *columns: pa.Array) -> pa.Array:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
            of = fold.to_numpy(zero_copy_only=False)
            best, score = np.full(len(x), np.nan), np.full(len(x), np.nan)
            for i, m in models.items():
                mine = np.flatnonzero(of == i)
                if not len(mine):
                    continue
                ll = np.stack([math.log(p) - 0.5 * np.log(2 * math.pi * v).sum() - 0.5 * ((x[mine] - mu) ** 2 / v).sum(axis=1)
                               for p, mu, v in zip(m.priors, m.means, m.vars)], axis=1)
                classes = np.array([float(c) for c in m.classes])
                known = ~np.isnan(ll).any(axis=1)
                best[mine[known]] = classes[np.argmax(ll[known], axis=1)]
                if len(classes) == 2:
                    with np.errstate(over="ignore"):
                        score[mine] = 1.0 / (1.0 + np.exp(ll[:, 0] - ll[:, 1]))
            return pa.StructArray.from_arrays([pa.array(best, from_pandas=True), pa.array(score, from_pandas=True)],
                                              ["prediction", "score"])

        fold = F.col(fold_col).cast("int") if fold_col else F.lit(0)
        out = df.withColumn("_nb", judge(fold, *[F.expr(f"CAST({e} AS DOUBLE)") for e in exprs]))
        out = out.withColumn("prediction", F.col("_nb.prediction"))
        if len(one.classes) == 2:
            out = out.withColumn("score", F.col("_nb.score"))
        return out.drop("_nb")


class GaussianNaiveBayes(_Trainer):
    """Per-class means and (population) variances; variances get ``var_smoothing`` x the largest variance.

    Missing features are left out feature by feature.
    """

    def __init__(self, features, label: str = "label", var_smoothing: float = 1e-9):
        super().__init__(features=list(features), label=label, var_smoothing=var_smoothing)
        self.exprs = _expr_list(features)
        self.label = label
        self.var_smoothing = var_smoothing

    def class_stats(self, df: DataFrame) -> DataFrame:
        """(label, n, then mean_i / var_i per feature): one aggregate, one row per class."""
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, e in enumerate(self.exprs):
            aggs += [F.expr(f"avg(CAST({e} AS DOUBLE)) AS mean_{i}"),
                     F.expr(f"var_pop(CAST({e} AS DOUBLE)) AS var_{i}")]
        return df.groupBy(self.label).agg(*aggs)

    def _solve(self, moments: dict[float, CoMoments]) -> GaussianNaiveBayesModel:
        parts = list(moments.values())
        n = np.array([p.n.max() for p in parts])
        everything = merged(parts)
        eps = self.var_smoothing * float(np.max(everything.products / np.maximum(everything.n, 1.0)))
        return GaussianNaiveBayesModel(self.exprs, list(moments), n / n.sum(), np.stack([p.mean for p in parts]),
                                       np.stack([p.products / np.maximum(p.n, 1.0) for p in parts]) + eps)

    def _fit(self, df: DataFrame) -> GaussianNaiveBayesModel:
        return self._solve(by_class(co_moments(df, self.exprs, self.label, pairs=False)))

    def fit_folds(self, df: DataFrame, fold_col: str = "fold") -> FoldModels:
        found = co_moments(df, self.exprs, self.label, fold_col, pairs=False)
        folds = sorted({f for f, _ in found})
        return FoldModels({f: self._solve(by_class(found, without=f)) for f in folds}, self._solve(by_class(found)))


# ---------------------------------------------------------------- SGD logistic


class SGDLogistic(_Trainer):
    """Logistic loss by mini-batch stochastic descent inside the tasks.

    In an epoch every task runs through its rows once, in mini-batches, from
    the common weights; the tasks' models are then averaged, weighted by their
    rows, in one aggregate. Mini-batch t moves against the gradient by
    ``eta0 / t^power_t``; ``alpha`` is the L2 penalty. Inputs should be
    standardised. Rows with a missing feature or label are not used.

    The rows are stored once as blocks of numbers, which every epoch reads.
    ``fit_folds`` trains the models of all folds and the final one side by
    side: a row counts for all models but its fold's.
    """

    def __init__(self, features, label: str = "label", epochs: int = 10, eta0: float = 0.1,
                 power_t: float = 0.25, alpha: float = 1e-4, batch: int = 32, seed: int = 46):
        super().__init__(features=list(features), label=label, epochs=epochs, eta0=eta0, power_t=power_t, alpha=alpha,
                         batch=batch, seed=seed)
        self.exprs = _expr_list(features)
        self.label, self.epochs, self.eta0, self.power_t, self.alpha = label, epochs, eta0, power_t, alpha
        self.batch, self.seed = batch, seed
        self.losses: list[float] = []

    def _blocks(self, df: DataFrame, fold_col: str | None) -> DataFrame:
        d = len(self.exprs)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]
                rows = np.column_stack(columns)
                rows = rows[~np.isnan(rows).any(axis=1)]
                if len(rows):
                    yield pa.RecordBatch.from_pydict({"rows": pa.array([rows.tobytes()], pa.binary())})

        fold = F.col(fold_col).cast("double") if fold_col else F.lit(-1.0)
        columns = [F.expr(f"CAST({e} AS DOUBLE)").alias(f"x{i}") for i, e in enumerate(self.exprs)]
        wide = df.select(fold.alias("fold"), F.col(self.label).cast("double").alias("y"), *columns)
        assert len(wide.columns) == d + 2
        return stage(wide.mapInArrow(pack, "rows binary"), "sgd")

    def _train(self, blocks: DataFrame, folds: list[int]) -> np.ndarray:
        """Weights (models x (d + 1), the constant last): a model per entry of ``folds``, which leaves that fold out."""
        d, batch, alpha, eta0, power_t, seed = len(self.exprs), self.batch, self.alpha, self.eta0, self.power_t, self.seed
        left_out = np.array(folds, float)
        penalty = np.append(np.full(d, alpha), 0.0)
        weights, steps = np.zeros((len(folds), d + 1)), 0.0
        schema = "w binary, n double, loss double, steps double, tasks double"

        def record(w: np.ndarray, *sums: float, tasks: float = 1.0) -> pa.RecordBatch:
            columns = [pa.array([w.tobytes()], pa.binary()), *[pa.array([v], pa.float64()) for v in (*sums, tasks)]]
            return pa.RecordBatch.from_arrays(columns, names=["w", "n", "loss", "steps", "tasks"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, sums = None, np.zeros(4)
            for part in batches:
                for r in part.to_pylist():
                    w = np.frombuffer(r["w"])
                    total = w if total is None else total + w
                    sums += [r["n"], r["loss"], r["steps"], r["tasks"]]
            if total is not None:
                yield record(total, *sums[:3].tolist(), tasks=float(sums[3]))

        for epoch in range(self.epochs):
            start, before = weights, steps

            def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                w, t, n, loss = start.copy(), before, 0, 0.0
                for part in batches:
                    for block in part.column(0).to_pylist():
                        rows = np.frombuffer(block).reshape(-1, d + 2)
                        order = np.random.default_rng(seed + epoch).permutation(len(rows))
                        for at in range(0, len(rows), batch):
                            some = rows[order[at:at + batch]]
                            x = np.column_stack([some[:, 2:], np.ones(len(some))])
                            y, uses = some[:, 1:2], some[:, :1] != left_out
                            z = np.clip(x @ w.T, -500, 500)
                            p = 1.0 / (1.0 + np.exp(-z))
                            error = np.where(uses, p - y, 0.0)
                            t += 1.0
                            rate = eta0 / t ** power_t
                            w -= rate * (error.T @ x / np.maximum(uses.sum(axis=0), 1)[:, None] + penalty * w)
                            loss += float(np.log1p(np.exp(np.where(y[:, 0] > 0, -z[:, -1], z[:, -1]))).sum())
                        n += len(rows)
                if n:
                    yield record(n * w, float(n), loss, t - before)

            # one small record per task, added up one after the other
            row = blocks.mapInArrow(descend, schema).repartition(1).mapInArrow(add, schema).first()
            if row is None:
                break
            weights = np.frombuffer(bytes(row["w"])).reshape(weights.shape) / row["n"]
            steps += row["steps"] / row["tasks"]
            self.losses.append(row["loss"] / row["n"])
        return weights

    def _model(self, w: np.ndarray) -> LinearScoreModel:
        return LinearScoreModel(self.exprs, w[:-1], w[-1])

    def _fit(self, df: DataFrame) -> LinearScoreModel:
        return self._model(self._train(self._blocks(df, None), [-2])[0])

    def fit_folds(self, df: DataFrame, fold_col: str = "fold") -> FoldModels:
        folds = [r[0] for r in df.select(F.col(fold_col).cast("int")).distinct().orderBy(fold_col).collect()]
        weights = self._train(self._blocks(df, fold_col), [*folds, -1])
        return FoldModels({f: self._model(w) for f, w in zip(folds, weights)}, self._model(weights[-1]))


# ---------------------------------------------------------------- RBF SVM via random features


class RandomFeatureSVMModel(Model, Persisted):
    has_arrays = True
    part_names = ("svc",)

    def __init__(self, exprs: list[str], w: np.ndarray, b: np.ndarray, svc=None):
        super().__init__()
        self.exprs, self.w, self.b, self.svc = list(exprs), np.asarray(w, float), np.asarray(b, float), svc

    def settings(self) -> dict:
        return {"exprs": self.exprs}

    def arrays(self) -> dict[str, np.ndarray]:
        return {"w": self.w, "b": self.b}

    def parts(self) -> dict:
        return {"svc": self.svc}

    def featurise(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        w, b, scale = self.w, self.b, math.sqrt(2.0 / len(self.b))

        @F.arrow_udf("array<double>")
        def features(*columns: pa.Array) -> pa.Array:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
            z = scale * np.cos(x @ w.T + b)
            return pa.ListArray.from_arrays(np.arange(0, z.size + 1, len(b), dtype=np.int32), pa.array(z.ravel()))

        columns = [F.expr(f"CAST({e} AS DOUBLE)") for e in self.exprs]
        return df.withColumn("_rffv", array_to_vector(features(*columns)))

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.svc.transform(self.featurise(df))
        margin = vector_to_array(F.col("rawPrediction"))[1]
        return out.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))).drop("_rffv", "rawPrediction")


class RandomFeatureSVM(_Trainer):
    """Approximate RBF-kernel SVM: ``z(x) = sqrt(2/D) cos(W x + b)`` then a linear SVM.

    ``gamma`` defaults to ``1 / d`` (inputs standardised). W and b are drawn on
    the driver (D x d numbers) and applied to Arrow batches.
    """

    def __init__(self, features, label: str = "label", n_components: int = 100, gamma: float | None = None,
                 reg: float = 0.01, max_iter: int = 50, seed: int = 46):
        super().__init__(features=list(features), label=label, n_components=n_components, gamma=gamma, reg=reg,
                         max_iter=max_iter, seed=seed)
        self.exprs = _expr_list(features)
        self.label, self.n, self.gamma, self.reg, self.max_iter, self.seed = (
            label, n_components, gamma, reg, max_iter, seed)

    def _fit(self, df: DataFrame) -> RandomFeatureSVMModel:
        d = len(self.exprs)
        gamma = self.gamma or 1.0 / d
        rng = np.random.default_rng(self.seed)
        model = RandomFeatureSVMModel(self.exprs, rng.normal(0.0, math.sqrt(2 * gamma), size=(self.n, d)),
                                      rng.uniform(0, 2 * math.pi, size=self.n))
        svc = LinearSVC(featuresCol="_rffv", labelCol=self.label, regParam=self.reg, maxIter=self.max_iter)
        # every solver iteration is a pass: evaluate the cosine features once
        train = model.featurise(df).select("_rffv", self.label).persist()
        try:
            model.svc = svc.fit(train)
        finally:
            train.unpersist()
        return model


# ---------------------------------------------------------------- k nearest neighbours


class NearestNeighboursModel(Model, Persisted):
    """Share of class 1 among the ``k`` nearest training rows (Euclidean; ties to the smaller id)."""

    has_arrays = True

    def __init__(self, exprs: list[str], points: np.ndarray, labels: np.ndarray, k: int):
        super().__init__()
        self.exprs, self.points, self.labels, self.k = list(exprs), points, labels, k

    def settings(self) -> dict:
        return {"exprs": self.exprs, "k": self.k}

    def arrays(self) -> dict[str, np.ndarray]:
        return {"points": self.points, "labels": self.labels}

    def _transform(self, df: DataFrame) -> DataFrame:
        k = min(self.k, len(self.points))
        model = df.sparkSession.sparkContext.broadcast((self.points, self.labels, (self.points ** 2).sum(axis=1)))

        @F.pandas_udf("double")
        def share(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
            points, labels, squares = model.value
            for rows in frames:
                x = np.stack(rows.to_list()).astype(np.float64) if len(rows) else np.zeros((0, points.shape[1]))
                out = np.full(len(x), np.nan)
                for at in range(0, len(x) if k else 0, 256):
                    part = x[at:at + 256]
                    d = np.round((part ** 2).sum(axis=1)[:, None] + squares - 2.0 * part @ points.T, 9)
                    last = np.partition(d, k - 1, axis=1)[:, k - 1:k]
                    nearer, equal = d < last, d == last
                    take = nearer | (equal & (np.cumsum(equal, axis=1) <= k - nearer.sum(axis=1, keepdims=True)))
                    out[at:at + 256] = take @ labels / k
                yield pd.Series(out)

        vector = F.expr("array(" + ", ".join(f"CAST({e} AS DOUBLE)" for e in self.exprs) + ")")
        return (df.withColumn("score", share(vector))
                .withColumn("prediction", (F.col("score") > 0.5).cast("double")))


class StoredNeighboursModel(Model, Persisted):
    """The same over training rows that stay in a stored table of blocks."""

    table_names = ("blocks",)

    def __init__(self, exprs: list[str], k: int, blocks: DataFrame):
        super().__init__()
        self.exprs, self.k, self.blocks = list(exprs), k, blocks

    def settings(self) -> dict:
        return {"exprs": self.exprs, "k": self.k}

    def tables(self) -> dict[str, DataFrame]:
        return {"blocks": self.blocks}

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = neighbours.score(df, self.blocks, self.exprs, self.k)
        return scored.withColumn("prediction", (F.col("score") > 0.5).cast("double"))


class NearestNeighbours(_Trainer):
    """k nearest neighbours over all training rows, or over the ``max_rows`` of smallest id hash if that is given.

    Up to ``LOCAL_ROWS`` rows are collected and broadcast, more stay in a stored
    table that every scored row is compared with, block by block; the results are
    the same. Rows with a null feature or label are not used for training.
    """

    LOCAL_ROWS = 20_000

    def __init__(self, features, k: int = 10, max_rows: int | None = None, id_col: str = "id", label: str = "label"):
        super().__init__(features=list(features), k=k, max_rows=max_rows, id_col=id_col, label=label)
        self.exprs, self.k, self.max_rows, self.id_col, self.label = _expr_list(features), k, max_rows, id_col, label

    def _fit(self, df: DataFrame) -> NearestNeighboursModel | StoredNeighboursModel:
        vector = F.expr("array(" + ", ".join(f"CAST({e} AS DOUBLE)" for e in self.exprs) + ")")
        rows = df.select(F.col(self.id_col).alias("id"), vector.alias("x"), F.col(self.label).cast("double").alias("y"))
        rows = rows.where(F.col("y").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
        if self.max_rows is not None:
            rows = rows.orderBy(F.xxhash64("id"), "id").limit(self.max_rows)
        elif rows.limit(self.LOCAL_ROWS + 1).count() > self.LOCAL_ROWS:
            return StoredNeighboursModel(self.exprs, self.k, neighbours.training_blocks(df, self.id_col, self.label, self.exprs))
        kept = rows.toArrow().sort_by("id")
        points = np.array(kept.column("x").to_pylist(), np.float64).reshape(kept.num_rows, len(self.exprs))
        return NearestNeighboursModel(self.exprs, points, kept.column("y").to_numpy(), self.k)
