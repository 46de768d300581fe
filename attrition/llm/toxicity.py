"""Toxicity by a classifier chain over hashed word features.

A document's features are the words it holds and the words' first bytes, as
64-bit hashes (presence, not counts).  The chain predicts the categories one
after the other with logistic models; each later model also sees the
probabilities of the earlier ones.  In training these are out-of-fold
predictions, so that a later model meets them as they will be on new texts.

The chain is fitted on a bounded sample of labelled documents (``Params.max_rows``
rows of smallest id hash).  Features are kept if their chi-square statistic with
some category is beyond chance for the number of features tried.  The fits run in
executor tasks; what reaches the driver is ``Params.max_features`` hashes and
weights.  Scoring is one pass over all whole texts.

Defined results: null, empty and wordless texts get the chain's scores without
any feature; a label row with a null id or null in all categories is not used,
one with some null categories is used where it has values; repeated label rows
count once (largest values); without usable labels nothing is toxic; repeated
documents get equal scores; extra columns are not read by ``score`` and
returned unchanged by ``drop_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stage
from .words import hashed_words

_U = np.uint64


@dataclass(frozen=True)
class Params:
    """Bounds of the training sample and the features, folds, ridge penalty, lengths of words' beginnings, threshold."""

    max_rows: int = 20_000
    max_features: int = 20_000
    folds: int = 5
    ridge: float = 1e-5
    beginnings: tuple[int, ...] = (4, 5)
    threshold: float = 0.5


_SLICE = 512


def document_features(texts: pa.Array, beginnings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of all words and beginnings in ``texts``; repeats included."""
    rows, found = hashed_words(texts, beginnings)
    rows, found = np.tile(rows, len(found)), found.ravel()
    some = found != 0
    return rows[some], found[some]


# --- logistic models on presence features

@dataclass
class Linear:
    """A logistic model: weights of the features, of the earlier categories' logits, and an intercept."""

    weights: np.ndarray
    earlier: np.ndarray
    intercept: float

    def logit(self, rows: np.ndarray, cols: np.ndarray, before: np.ndarray) -> np.ndarray:
        """``rows`` and ``cols`` are the places of ones; ``before`` has a column per earlier category."""
        return (np.bincount(rows, self.weights[cols], minlength=len(before)) + before @ self.earlier
                + self.intercept)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def fit_linear(rows: np.ndarray, cols: np.ndarray, before: np.ndarray, y: np.ndarray, n_features: int,
               ridge: float, newton_steps: int = 20, cg_steps: int = 30) -> Linear:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients."""
    n, k = before.shape
    if not n or y.min() == y.max():
        rate = float(y.mean()) if n else 0.0
        return Linear(np.zeros(n_features), np.zeros(k), 12.0 if rate == 1.0 else -12.0)
    d = n_features + k + 1

    def forward(v):
        return np.bincount(rows, v[cols], minlength=n) + before @ v[n_features:-1] + v[-1]

    def back(u):
        return np.concatenate([np.bincount(cols, u[rows], minlength=n_features), before.T @ u, [u.sum()]])

    penalty = np.full(d, ridge * n)
    penalty[-1] = 0.0
    w = np.zeros(d)
    w[-1] = np.log(y.mean() / (1 - y.mean()))

    def loss(v):
        z = forward(v)
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (v * v)

    now = loss(w)
    for _ in range(newton_steps):
        p = sigmoid(forward(w))
        gradient = back(p - y) + penalty * w
        if np.abs(gradient).max() < 1e-6 * n:
            break
        s = np.maximum(p * (1 - p), 1e-9)
        scale = 1.0 / (np.concatenate([np.bincount(cols, s[rows], minlength=n_features), (before * before).T @ s,
                                       [s.sum()]]) + penalty + 1e-9)
        x, r = np.zeros(d), -gradient
        z = scale * r
        q, rz = z.copy(), r @ z
        for _ in range(cg_steps):
            hq = back(s * forward(q)) + penalty * q
            a = rz / (q @ hq)
            x, r = x + a * q, r - a * hq
            z = scale * r
            new = r @ z
            if new < 1e-8 * abs(gradient @ (scale * gradient)):
                break
            q, rz = z + new / rz * q, new
        step = 1.0
        while step > 1e-4 and loss(w + step * x) > now:
            step /= 2
        w = w + step * x
        before_loss, now = now, loss(w)
        if before_loss - now < 1e-9 * n:
            break
    return Linear(w[:n_features], w[n_features:-1], float(w[-1]))


@dataclass
class Chain:
    """Fitted chain: the features in ascending order of their hash, and one model per category, in order."""

    categories: list[str]
    features: np.ndarray
    models: list[Linear] = field(default_factory=list)

    def places(self, rows: np.ndarray, found: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature number) among (row, hash); ``maybe`` marks the low bits of known features."""
        some = maybe[(found & _U(len(maybe) - 1)).astype(np.int64)]
        rows, found = rows[some], found[some]
        at = np.minimum(np.searchsorted(self.features, found), max(len(self.features) - 1, 0))
        hit = self.features[at] == found if len(self.features) else np.zeros(0, bool)
        one = np.unique(rows[hit] * max(len(self.features), 1) + at[hit])
        return np.divmod(one, max(len(self.features), 1))

    def marks(self) -> np.ndarray:
        maybe = np.zeros(1 << 20, bool)
        maybe[(self.features & _U(len(maybe) - 1)).astype(np.int64)] = True
        return maybe

    def logits(self, n: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """One column per category; each model sees those before it."""
        out = np.zeros((n, len(self.models)))
        for k, model in enumerate(self.models):
            out[:, k] = model.logit(rows, cols, sigmoid(out[:, :k]))
        return out


# --- Spark jobs

def _extract(p: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                rows, found = document_features(part.column("text"), p.beginnings)
                order = np.argsort(rows, kind="stable")
                rows, found = rows[order], found[order]
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                bags = [np.unique(found[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("y"), pa.array(bags, pa.binary())], ["key", "y", "features"])

    return run


def _count_features(n_categories: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, labels = [], []
        for batch in batches:
            for y, bag in zip(batch.column("y").to_pylist(), batch.column("features").to_pylist()):
                hashes = np.frombuffer(bag, _U)
                found.append(hashes)
                labels.append(np.repeat([[0.0 if v is None else v for v in y]], len(hashes), axis=0))
        if found:
            keys, place = np.unique(np.concatenate(found), return_inverse=True)
            y = np.concatenate(labels)
            out = {"feature": keys.view(np.int64), "n": np.bincount(place).astype(np.int64)}
            out["positive"] = list(np.stack([np.bincount(place, y[:, k]) for k in range(n_categories)], axis=1))
            yield pa.RecordBatch.from_pydict({"feature": pa.array(out["feature"]), "n": pa.array(out["n"]),
                                              "positive": pa.array(out["positive"], pa.list_(pa.float64()))})

    return run


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str, text_col: str,
                  p: Params) -> DataFrame:
    """(key, y, features) of the labelled sample, stored once. Broadcast: ``p.max_rows`` label rows at most."""
    known = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in categories])
    one = (labels.where(F.col(id_col).isNotNull() & known).groupBy(F.col(id_col).alias("key"))
           .agg(*[F.max(F.col(c).cast("double")).alias(f"y{k}") for k, c in enumerate(categories)]))
    chosen = (one.orderBy(F.xxhash64("key"), "key").limit(p.max_rows)
              .select("key", F.array(*[F.col(f"y{k}") for k in range(len(categories))]).alias("y")))
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    joined = rows.join(F.broadcast(chosen), "key").select("key", "y", "text")
    kind = joined.schema["key"].dataType.simpleString()
    return stage(joined.mapInArrow(_extract(p), f"key {kind}, y array<double>, features binary"), "labelled")


def informative(sample: DataFrame, categories: list[str], p: Params) -> np.ndarray:
    """At most ``p.max_features`` feature hashes, ascending, whose link with a category is beyond chance."""
    sums = sample.agg(F.count(F.lit(1)).alias("n"),
                      *[F.sum(F.coalesce(F.col("y")[k], F.lit(0.0))).alias(f"p{k}")
                        for k in range(len(categories))]).first()
    n = sums["n"]
    if not n:
        return np.zeros(0, _U)
    counted = (sample.mapInArrow(_count_features(len(categories)), "feature bigint, n bigint, positive array<double>")
               .groupBy("feature").agg(F.sum("n").alias("n"),
                                       *[F.sum(F.col("positive")[k]).alias(f"p{k}") for k in range(len(categories))]))
    scores = []
    for k in range(len(categories)):
        rate = (sums[f"p{k}"] or 0.0) / n
        if 0 < rate < 1:
            off = F.col(f"p{k}") - F.col("n") * rate
            spread = F.col("n") * F.lit(rate * (1 - rate)) * (F.lit(1.0) - (F.col("n") - 0.5) / F.lit(float(n)))
            scores.append(off * off / spread)
    if not scores:
        return np.zeros(0, _U)
    counted = stage(counted.select("feature", (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("chi2")),
                    "features")
    least = 2.0 * np.log(max(counted.count(), 1) / 0.01)
    top = counted.where(F.col("chi2") >= float(least)).orderBy(F.desc("chi2"), "feature").limit(p.max_features)
    found = top.select("feature").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(_U))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id",
              text_col: str = "text", params: Params = Params()) -> Chain:
    """Fit the chain for the 0/1 columns ``categories`` of ``labels``, in that order."""
    p = params
    sample = training_rows(docs, labels, categories, id_col, text_col, p)
    chain = Chain(categories, informative(sample, categories, p))
    maybe = chain.marks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for bag in batch.column("features").to_pylist():
                found = np.frombuffer(bag, _U)
                hits.append(chain.places(np.zeros(len(found), np.int64), found, maybe)[1].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("fold"), batch.column("y"),
                                              pa.array(hits, pa.list_(pa.int32()))], ["row", "fold", "y", "hits"])

    folded = sample.select(F.monotonically_increasing_id().alias("row"),
                           F.pmod(F.xxhash64("key", F.lit("fold")), F.lit(p.folds)).cast("int").alias("fold"), "y", "features")
    hits = stage(folded.mapInArrow(run, "row bigint, fold int, y array<double>, hits array<int>"), "hits")
    chain.models = fit_in_tasks(hits, len(categories), len(chain.features), p)
    return chain


_FITTED = "fit int, row bigint, logit double, model binary"


def _fit_one(k: int, n_features: int, p: Params):
    """Fit number ``fit`` of category ``k``: -1 uses all rows; another one leaves its fold out and scores it."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row").combine_chunks()
        fit, row = table["fit"][0].as_py(), table["row"].to_numpy()
        fold = table["fold"].to_numpy()
        y = pc.list_element(table["y"], k).to_numpy(zero_copy_only=False).astype(float)
        lists = table["hits"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        cols = lists.flatten().to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        before = np.array(table["before"].to_pylist(), float).reshape(len(y), -1)
        use = ~np.isnan(y) & (fold != fit)
        number, own = np.cumsum(use, dtype=np.int32) - 1, use[rows]
        model = fit_linear(number[rows[own]], cols[own], before[use], y[use], n_features, p.ridge)
        pa.default_memory_pool().release_unused()
        if fit < 0:
            flat = np.concatenate([model.weights, model.earlier, [model.intercept]]).tobytes()
            return pa.table({"fit": pa.array([fit], pa.int32()), "row": pa.array([None], pa.int64()),
                             "logit": pa.array([None], pa.float64()), "model": pa.array([flat], pa.binary())})
        own = np.flatnonzero(fold == fit)
        logit = model.logit(rows, cols, before)[own]
        return pa.table({"fit": pa.array(np.full(len(own), fit), pa.int32()), "row": pa.array(row[own], pa.int64()),
                         "logit": pa.array(logit), "model": pa.array([None] * len(own), pa.binary())})

    return run


def fit_in_tasks(hits: DataFrame, n_categories: int, n_features: int, p: Params) -> list[Linear]:
    """The chain's models. A category's fits, on all rows and without each fold, are tasks of their own.

    Each task reads the bounded sample; the driver gets one model per category.
    """
    models: list[Linear] = []
    sample = hits.withColumn("before", F.array().cast("array<double>"))
    for k in range(n_categories):
        more = k + 1 < n_categories
        fits = F.array(*[F.lit(f) for f in range(-1, p.folds if more else 0)])
        each = sample.withColumn("fit", F.explode(fits)).repartition(p.folds + 1, "fit")
        fitted = stage(each.groupBy("fit").applyInArrow(_fit_one(k, n_features, p), _FITTED), "fitted")
        found = fitted.where("fit < 0").select("model").first()
        flat = np.frombuffer(bytes(found["model"])) if found else np.append(np.zeros(n_features + k), -12.0)
        models.append(Linear(flat[:n_features], flat[n_features:-1], float(flat[-1])))
        if more:
            chance = F.lit(0.5) * (F.lit(1.0) + F.tanh(F.lit(0.5) * F.col("logit")))
            held_out = fitted.where("fit >= 0").select("row", chance.alias("chance"))
            sample = stage(sample.join(held_out, "row").withColumn("before", F.concat("before", F.array("chance"))).drop("chance"),
                           "sample")
    return models


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text",
          params: Params = Params()) -> DataFrame:
    """id and the probability ``p_<category>`` of each category, for every row."""
    model = docs.sparkSession.sparkContext.broadcast((chain, chain.marks()))
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, maybe = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                places = fitted.places(*document_features(part.column(1), params.beginnings), maybe)
                p = sigmoid(fitted.logits(part.num_rows, *places))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(p[:, k]) for k in range(len(names))]],
                                                 [id_col, *names])

    rows = docs.select(F.col(id_col), F.col(text_col))
    return rows.mapInArrow(run, ", ".join([f"`{id_col}` {rows.schema[0].dataType.simpleString()}",
                                           *[f"`{n}` double" for n in names]]))


def drop_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", text_col: str = "text",
               params: Params = Params()) -> DataFrame:
    """``docs`` without the rows whose probability of ``category`` reaches the threshold; all columns unchanged."""
    model = docs.sparkSession.sparkContext.broadcast((chain, chain.marks()))
    at_category = chain.categories.index(category)

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted, maybe = model.value
        for t in texts:
            parts = []
            for at in range(0, len(t), _SLICE):
                part = pa.array(t.iloc[at:at + _SLICE], pa.string(), from_pandas=True)
                places = fitted.places(*document_features(part, params.beginnings), maybe)
                parts.append(sigmoid(fitted.logits(len(part), *places))[:, at_category])
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(probability(F.col(text_col)) < params.threshold)
