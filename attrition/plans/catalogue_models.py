"""Registered queries: sampling, encoding, scaling, evaluation, classifiers, scoring, drivers."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import auc_by_rank, roc_points
from ..operators import drivers as DR
from ..operators import evaluate as EV
from ..operators import features as FE
from ..operators import models as M
from ..operators import sampling as S
from ..operators import score as SC
from ..operators import select as SEL
from ..session import ensure_checkpoint_dir
from ..sources.sinks import load_saved, save_model
from ..sources.staging import stage
from ..schema import DASHBOARD_DRIVERS, DRIVER_NAMES, KEY, PREDICTION_COL, SCORE_COL, default_registry
from .catalogue_explore import _q
from .inputs import Inputs, finish
from .oracle_sql import r4, rounded, with_ctes
from .registry import query

#: The columns of the model, from the registry of column lists.
COLUMNS = default_registry()["churn_model_v1"]
FEATS = list(COLUMNS.num)
DRIVERS = list(DASHBOARD_DRIVERS)
NAMED_DRIVERS = list(DRIVER_NAMES)

# ---------------------------------------------------------------- sampling


def _hash_sql(seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {KEY}::varchar), 1, 15))::bigint"


@query("resample", "SA1 (keep positives, sample negatives by key hash to 1:1)",
       sql=with_ctes(f"select {KEY}, {rounded(FEATS)}, churn from account_table, (select count(*) filter (where churn = 1) "
                     "/ cast(count(*) filter (where churn = 0) as double) as share from account_table) s "
                     f"where churn = 1 or {_hash_sql(46)} % 1000000 / 1000000.0::double < share", "account_table"))
def q_resample(t: Inputs):
    return finish(S.resample(t.stored("account_table"), "churn", 1.0, seed=46, keys=[KEY]))


@query("hash_split", "SA2 (70/30 split by key hash, every account)",
       sql=with_ctes(f"select {KEY}, churn, case when {_hash_sql(42)} % 1000000 / 1000000.0::double < 0.7::double then 'train' "
                     "else 'test' end as split from account_label", "account_label"))
def q_hash_split(t: Inputs):
    return S.hash_split(t.churn_labels, [KEY], 0.7, seed=42)


@query("kfold_counts", "SA3 (5 hash folds, every account)",
       sql=with_ctes(f"select {KEY}, churn, cast({_hash_sql(46)} % 5 as int) as fold from account_label", "account_label"))
def q_kfold_counts(t: Inputs):
    return S.with_hash_folds(t.churn_labels, [KEY], 5)


@query("stratified_fold_counts", "SA4 (exactly stratified folds, ranked range by range, every account)",
       sql=with_ctes(f"select {KEY}, churn, cast((row_number() over (partition by churn order by {_hash_sql(46)}, {KEY}) - 1) "
                     "% 5 as int) as fold from account_label", "account_label"))
def q_stratified_fold_counts(t: Inputs):
    return S.with_stratified_folds(t.churn_labels, "churn", [KEY], 5)


# ---------------------------------------------------------------- encoding / scaling

_LEVEL_SQL = " union all ".join(
    f"select '{tbl}.{c}' as {_q('column')}, level, cast(index as int) as index, "
    f"cast(case when index = n - 1 then null else index end as int) as slot, count from ("
    f"select level, count, row_number() over (order by count desc, level) - 1 as index, "
    f"count(*) over () as n from (select cast({c} as varchar) as level, count(*) as count from {tbl} "
    f"where {c} is not null group by 1) a) b"
    for tbl, c in (("customer", "c_mktsegment"), ("orders", "o_orderpriority")))


@query("one_hot_labels", "M2 (frequency-ordered levels; last level dropped)", sql=_LEVEL_SQL)
def q_one_hot_labels(t: Inputs):
    a = FE.level_table(t.customer, "c_mktsegment").withColumn("column", F.lit("customer.c_mktsegment"))
    b = FE.level_table(t.orders, "o_orderpriority").withColumn("column", F.lit("orders.o_orderpriority"))
    return a.unionByName(b)


def _slot_sql(tbl: str, key: str, c: str) -> str:
    return (f"select '{tbl}.{c}' as \"column\", {key} as id, {c} as level, "
            f"case when i < n - 1 then cast(i + 1 as int) else 0 end as slot, cast(n - 1 as int) as size from {tbl} join ("
            f"select {c}, row_number() over (order by count(*) desc, {c}) - 1 as i, count(*) over () as n "
            f"from {tbl} where {c} is not null group by {c}) l using ({c})")


@query("one_hot_slots", "M2 (encoded vectors: the slot that is 1, 0 for the dropped last level)",
       sql=_slot_sql("customer", "c_custkey", "c_mktsegment") + " union all "
       + _slot_sql("orders", "o_orderkey", "o_orderpriority"))
def q_one_hot_slots(t: Inputs):
    out = None
    for name, key, c in (("customer", "c_custkey", "c_mktsegment"), ("orders", "o_orderkey", "o_orderpriority")):
        encoded, _ = FE.encode_levels(t.table(name).where(F.col(c).isNotNull()), [c])
        vector = vector_to_array(F.col(f"{c}ohe"))
        part = encoded.select(F.lit(f"{name}.{c}").alias("column"), F.col(key).alias("id"), F.col(c).alias("level"),
                              F.array_position(vector, F.lit(1.0)).cast("int").alias("slot"),
                              F.size(vector).alias("size"))
        out = part if out is None else out.unionByName(part)
    return out


_STD_SQL = with_ctes(
    "select user_account_id, "
    + ", ".join(f"{r4(f'coalesce(({c} - avg({c}) over ()) / nullif(stddev_samp({c}) over (), 0), 0.0)')} as {c}"
                for c in FEATS)
    + " from account_table", "account_table")


@query("standardised", "M4 (zero mean, unit sample std; constant column -> 0)", sql=_STD_SQL)
def q_standardised(t: Inputs):
    table = t.stored("account_table")
    scaler = FE.StandardScalerColumns(FEATS).fit(table)
    return finish(scaler.transform(table).select(KEY, *FEATS))


# ---------------------------------------------------------------- evaluation on given scores

_DOCS = ("(select d.doc_id, d.lang, cast(d.n_chars as double) as score, l.quality as label "
         "from documents d join labels l on d.doc_id = l.doc_id)")


def _docs(t: Inputs) -> DataFrame:
    return t.documents.join(t.table("labels"), "doc_id").select(
        "doc_id", "lang", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label"))


_CONF_SQL = (
    "select lang, n_true_neg, n_false_neg, n_false_pos, n_true_pos, "
    + r4("tpr") + " as true_pos_rate, " + r4("fpr") + " as false_pos_rate, "
    + r4("n_true_pos / nullif(cast(n_true_pos + n_false_pos as double), 0)") + " as precision, "
    + r4("(tpr + 1.0 - fpr) / 2.0") + " as roc_auc from ("
    "select *, n_true_pos / nullif(cast(n_true_pos + n_false_neg as double), 0) as tpr, "
    "n_false_pos / nullif(cast(n_false_pos + n_true_neg as double), 0) as fpr from ("
    "select lang, count(*) filter (where label = 0 and pred = 0) as n_true_neg, "
    "count(*) filter (where label = 1 and pred = 0) as n_false_neg, "
    "count(*) filter (where label = 0 and pred = 1) as n_false_pos, "
    "count(*) filter (where label = 1 and pred = 1) as n_true_pos from ("
    f"select *, case when score >= 1000 then 1 else 0 end as pred from {_DOCS} x) y group by lang) z) w")


@query("confusion_metrics", "E2 E3 E4 (rule prediction n_chars >= 1000 against quality, by language)",
       sql=_CONF_SQL)
def q_confusion_metrics(t: Inputs):
    pred = _docs(t).withColumn("prediction", (F.col("score") >= 1000).cast("double"))
    return finish(EV.confusion(pred, "label", "prediction", ["lang"]))


_AUC_SQL = (
    "select lang, " + r4("(sum(avg_rank) filter (where label = 1) - n_pos * (n_pos + 1) / 2.0) "
                         "/ nullif(n_pos * n_neg, 0)") + " as auc, n_pos, n_neg from ("
    "select *, rnk + (cnt - 1) / 2.0 as avg_rank, "
    "count(*) filter (where label = 1) over (partition by lang) as n_pos, "
    "count(*) filter (where label = 0) over (partition by lang) as n_neg from ("
    "select *, rank() over (partition by lang order by score) as rnk, "
    f"count(*) over (partition by lang, score) as cnt from {_DOCS} x) y) z group by lang, n_pos, n_neg")


@query("auc_rank", "E5 (exact AUC by ranks, per language)", sql=_AUC_SQL)
def q_auc_rank(t: Inputs):
    return finish(auc_by_rank(_docs(t), "score", "label", ["lang"]))


_ROC_SQL = (
    "select threshold, tp, fp, " + r4("tp / cast(sum(pos) over () as double)") + " as tpr, "
    + r4("fp / cast(sum(neg) over () as double)") + " as fpr from ("
    "select threshold, pos, neg, sum(pos) over (order by threshold desc rows between unbounded preceding "
    "and current row) as tp, sum(neg) over (order by threshold desc rows between unbounded preceding and "
    "current row) as fp from (select score as threshold, cast(count(*) filter (where label = 1) as bigint) as pos, "
    f"cast(count(*) filter (where label = 0) as bigint) as neg from {_DOCS} x group by score) a) b")


@query("roc_points", "E6 (ROC points over all distinct thresholds)", sql=_ROC_SQL)
def q_roc_points(t: Inputs):
    return finish(roc_points(_docs(t), "score", "label").select("threshold", "tp", "fp", "tpr", "fpr"))


# ---------------------------------------------------------------- classifier inputs


def model_frame(t: Inputs, k: int = 5) -> DataFrame:
    """Account table with a 70/30 hash split; features filled, standardised with the statistics of
    the training split only, assembled; hash folds for cross-validation on the training split."""
    table = t.stored("account_table").fillna(0.0, subset=FEATS).withColumn("label", F.col("churn").cast("double"))
    table = S.hash_split(table, [KEY], 0.7, seed=42)
    scaler = FE.StandardScalerColumns(FEATS).fit(table.where(F.col("split") == "train"))
    data = FE.assemble_features(scaler.transform(table), FEATS, output_col=M.FEATURES)
    data = S.with_hash_folds(data, [KEY], k)
    # many passes follow (fits, folds): keep what they read, stored once in the shared folder
    return stage(data.select(KEY, "label", "split", "fold", *FEATS, M.FEATURES), "model_frame")


def train_rows(data: DataFrame) -> DataFrame:
    return data.where(F.col("split") == "train")


def _fit_score(t: Inputs, make) -> DataFrame:
    data = model_frame(t)
    model = make().fit(data.where(F.col("split") == "train"))
    out = SC.score_accounts(model, data, [], KEY, "score", "prediction")
    return out.select(KEY, "score", F.col("prediction").cast("double").alias("prediction"))


_CLASSIFIERS = {
    "et_scores": ("C1 extra trees (20, no bootstrap)", lambda: M.extra_trees(20)),
    "rf_scores": ("C2 random forest (20)", lambda: M.random_forest(20)),
    "lda_scores": ("C3 linear discriminant", lambda: M.LinearDiscriminant(FEATS)),
    "nb_scores": ("C4 Gaussian naive Bayes", lambda: M.GaussianNaiveBayes(FEATS)),
    "gbt_scores": ("C5 gradient boosting (100 x depth 3)", lambda: M.gradient_boosting(100)),
    "dt_scores": ("C7 decision tree", lambda: M.decision_tree()),
    "logreg_scores": ("C8 logistic regression (20 iterations)", lambda: M.logistic_regression(20)),
    "sgd_scores": ("C9 SGD logistic (10 epochs, inverse scaling)", lambda: M.SGDLogistic(FEATS)),
    "svm_scores": ("C10 RBF SVM via random Fourier features", lambda: M.RandomFeatureSVM(FEATS)),
}


def _register_classifier(name: str, ops: str, make) -> None:
    @query(name, ops)
    def run(t: Inputs):
        return finish(_fit_score(t, make))


for _name, (_ops, _make) in _CLASSIFIERS.items():
    _register_classifier(_name, _ops, _make)


@query("nb_native_scores", "C4 with Spark's own Gaussian naive Bayes")
def q_nb_native(t: Inputs):
    return finish(_fit_score(t, M.naive_bayes_native))


_LDA2 = ["reloads_count", "reloads_inactive_days"]
_LDA2_SQL = with_ctes(
    "select user_account_id, churn, " + r4("z") + " as decision, cast(z > 0 as double) as prediction from ("
    "select d.*, bb + w1 * x1 + w2 * x2 as z from d, w) q",
    "account_table",
    extra=[
        "d as (select user_account_id, churn, coalesce(reloads_count, 0.0) as x1, "
        "coalesce(reloads_inactive_days, 0.0) as x2 from account_table)",
        "m as (select churn, count(*) as n, avg(x1) as m1, avg(x2) as m2 from d group by churn)",
        "s as (select sum((d.x1 - m.m1) * (d.x1 - m.m1)) as s11, sum((d.x1 - m.m1) * (d.x2 - m.m2)) as s12, "
        "sum((d.x2 - m.m2) * (d.x2 - m.m2)) as s22 from d join m using (churn))",
        "p as (select a.n as n0, b.n as n1, a.m1 as a1, a.m2 as a2, b.m1 as b1, b.m2 as b2, "
        "s11 / (a.n + b.n - 2) as c11, s12 / (a.n + b.n - 2) as c12, s22 / (a.n + b.n - 2) as c22 "
        "from m a, m b, s where a.churn = 0 and b.churn = 1)",
        "w as (select *, (c22 * (b1 - a1) - c12 * (b2 - a2)) / (c11 * c22 - c12 * c12) as w1, "
        "(c11 * (b2 - a2) - c12 * (b1 - a1)) / (c11 * c22 - c12 * c12) as w2, "
        "-0.5 * ((a1 + b1) * ((c22 * (b1 - a1) - c12 * (b2 - a2)) / (c11 * c22 - c12 * c12)) "
        "+ (a2 + b2) * ((c11 * (b2 - a2) - c12 * (b1 - a1)) / (c11 * c22 - c12 * c12))) + ln(n1 / n0) as bb from p)",
    ])


@query("lda_two_features", "C3 closed form on two features (decision value and class)", sql=_LDA2_SQL)
def q_lda_two_features(t: Inputs):
    table = t.stored("account_table").fillna(0.0, subset=_LDA2)
    model = M.LinearDiscriminant(_LDA2, label="churn").fit(table)
    z = F.expr(model.decision_sql())
    return finish(table.select(KEY, "churn", z.alias("decision"), (z > 0).cast("double").alias("prediction")))


_DIMS = 64


def _emb_features() -> list[str]:
    return [f"element_at(embedding, {i + 1})" for i in range(_DIMS)]


_NB_STATS_SQL = ("select label, count(*) as n, "
                 + ", ".join(f"{r4(f'avg(cast(embedding[{i + 1}] as double))')} as mean_{i}, "
                             f"{r4(f'var_pop(cast(embedding[{i + 1}] as double))', 6)} as var_{i}"
                             for i in range(_DIMS))
                 + " from embeddings group by label")


@query("gaussian_nb_stats", "C4 fitted statistics: per class size, mean and variance of 64 dimensions",
       sql=_NB_STATS_SQL)
def q_gaussian_nb_stats(t: Inputs):
    stats = M.GaussianNaiveBayes(_emb_features(), label="label").class_stats(t.embeddings)
    out = [F.col("label"), F.col("n")]
    for i in range(_DIMS):
        out += [F.expr(f"floor(mean_{i} * 10000D + 0.5001D) / 10000D AS mean_{i}"),
                F.expr(f"floor(var_{i} * 1000000D + 0.5001D) / 1000000D AS var_{i}")]
    return stats.select(*out)


_NB_PRED_SQL = (
    "with long as (select vec_id, label, d.i as dim, cast(embedding[d.i] as double) as x "
    f"from embeddings, range(1, {_DIMS + 1}) d(i)), "
    "cs as (select label as cls, dim, count(*) as n, avg(x) as m, var_pop(x) as v from long group by label, dim), "
    "tot as (select count(*) as total from embeddings), "
    "eps as (select 1e-9 * max(v) as e from (select var_pop(x) as v from long group by dim) z), "
    "prior as (select cls, max(n) as n from cs group by cls), "
    "ll as (select l.vec_id, l.label, c.cls, sum(-0.5 * ln(2 * pi() * (c.v + eps.e)) "
    "- 0.5 * (l.x - c.m) * (l.x - c.m) / (c.v + eps.e)) as s from long l join cs c on l.dim = c.dim, eps "
    "group by l.vec_id, l.label, c.cls), "
    "scored as (select ll.vec_id, ll.label, ll.cls, ll.s + ln(prior.n / cast(tot.total as double)) as score, "
    "row_number() over (partition by ll.vec_id order by ll.s + ln(prior.n / cast(tot.total as double)) desc, "
    "ll.cls) as rk from ll join prior on ll.cls = prior.cls, tot) "
    "select vec_id, label, cast(cls as double) as prediction from scored where rk = 1")


@query("gaussian_nb_predict", "C4 predictions: arg-max class log-likelihood over 64 dimensions", sql=_NB_PRED_SQL)
def q_gaussian_nb_predict(t: Inputs):
    model = M.GaussianNaiveBayes(_emb_features(), label="label").fit(t.embeddings)
    return model.transform(t.embeddings).select("vec_id", "label", F.col("prediction").cast("double"))


@query("cv_metrics", "E1 E2 E3 E4 E5 (5-fold cross-validation of logistic regression)")
def q_cv_metrics(t: Inputs):
    _, _, metrics = EV.cross_validate(train_rows(model_frame(t)), lambda: M.logistic_regression(20))
    return finish(metrics)


#: The ten classifiers that are compared, in the order of the comparison.
CLASSIFIERS = {
    "extra_trees": lambda: M.extra_trees(20),
    "random_forest": lambda: M.random_forest(20),
    "linear_discriminant": lambda: M.LinearDiscriminant(FEATS),
    "naive_bayes": lambda: M.GaussianNaiveBayes(FEATS),
    "gradient_boosting": lambda: M.gradient_boosting(100),
    "nearest_neighbours": lambda: M.NearestNeighbours(FEATS, k=10, id_col=KEY),
    "decision_tree": lambda: M.decision_tree(),
    "logistic_regression": lambda: M.logistic_regression(20),
    "sgd_logistic": lambda: M.SGDLogistic(FEATS),
    "rbf_svm": lambda: M.RandomFeatureSVM(FEATS),
}


@query("model_comparison", "E7 S9 S10 (ten classifiers, 5 folds, saved, reloaded, judged on the hold-out, predictions written)")
def q_model_comparison(t: Inputs):
    data = model_frame(t)
    where = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/comparison-{uuid.uuid4().hex}"
    return finish(EV.compare_models(train_rows(data), CLASSIFIERS, test=data.where(F.col("split") == "test"),
                                    model_dir=f"{where}/models", prediction_dir=f"{where}/predictions", id_col=KEY))


@query("saved_models", "S9 (the five hand-written models score the same after a save and a load, every account)",
       sql=with_ctes("select user_account_id, unnest(['linear_discriminant', 'naive_bayes', 'nearest_neighbours', "
                     "'sgd_logistic', 'rbf_svm']) as model, true as same from account_table", "account_table"))
def q_saved_models(t: Inputs):
    data = model_frame(t)
    where = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    out = None
    for name in ("linear_discriminant", "naive_bayes", "nearest_neighbours", "sgd_logistic", "rbf_svm"):
        model = CLASSIFIERS[name]().fit(train_rows(data))
        save_model(model, f"{where}/{name}")
        before = model.transform(data).select(KEY, F.col("score").alias("before"))
        after = load_saved(t.spark, f"{where}/{name}").transform(data).select(KEY, F.col("score").alias("after"))
        same = before.join(after, KEY).select(KEY, F.lit(name).alias("model"), F.col("before").eqNullSafe(F.col("after")).alias("same"))
        out = same if out is None else out.unionByName(same)
    return out


@query("feature_weights", "E8 (sparse logistic weights, ascending)")
def q_feature_weights(t: Inputs):
    data = train_rows(model_frame(t))
    model = M.logistic_regression(100, reg=0.01, elastic_net=1.0).fit(data)
    return finish(SEL.feature_weights(t.spark, model, FEATS))


@query("feature_elimination", "E9 (recursive elimination, random forest importances, 2 folds)")
def q_feature_elimination(t: Inputs):
    data = train_rows(model_frame(t, k=2))
    table, _ = SEL.feature_elimination(data, FEATS, lambda: M.random_forest(10, max_depth=5), step=10)
    return finish(table)


@query("embedding_learnability", "models learn: one-vs-rest logistic AUC on embeddings (5 folds)")
def q_embedding_learnability(t: Inputs):
    emb = t.embeddings.select("vec_id", (F.col("label") == 0).cast("double").alias("label"),
                              *[F.expr(f"CAST(element_at(embedding, {i + 1}) AS DOUBLE) AS e{i}") for i in range(_DIMS)])
    data = FE.assemble_features(emb, [f"e{i}" for i in range(_DIMS)], output_col=M.FEATURES)
    data = S.with_hash_folds(data, ["vec_id"], 5)
    _, _, metrics = EV.cross_validate(data, lambda: M.logistic_regression(50))
    return finish(metrics)


# ---------------------------------------------------------------- scored table views


@query("churn_summary", "A21 P16 (leavers, loyal, percentage, band, text)",
       sql=with_ctes("select n_churned, n_loyal, n_total, " + r4("pct") + " as churn_pct, "
                     "case when pct < 10 then 'success' when pct < 20 then 'warning' else 'danger' end as band, "
                     "printf('%.1f', pct) as churn_rate_text from (select *, n_churned / cast(n_total as double) "
                     "* 100.0 as pct from (select count(*) filter (where prediction_logistic_regression = 1) as "
                     "n_churned, count(*) filter (where prediction_logistic_regression = 0) as n_loyal, count(*) "
                     "as n_total from scored) a) b", "scored"))
def q_churn_summary(t: Inputs):
    return finish(SC.churn_summary(t.scored))


@query("call_list", "O3 O4 (top 200 predicted leavers by probability, ties by account)",
       sql=with_ctes(f"select user_account_id, {SCORE_COL} from scored where {PREDICTION_COL} = 1 "
                     f"order by {SCORE_COL} desc, user_account_id limit 200", "scored"))
def q_call_list(t: Inputs):
    return finish(SC.call_list(t.scored, 200))


def _box_sql() -> str:
    long = (f"(select * from (select {', '.join(NAMED_DRIVERS)} from scored where {PREDICTION_COL} = 0) "
            f"unpivot (value for driver in ({', '.join(NAMED_DRIVERS)})))")
    return with_ctes(
        "select driver, " + ", ".join(f"{r4(c)} as {c}" for c in ("q1", "median", "q3", "iqr"))
        + ", " + r4("min(value) filter (where value >= q1 - 1.5 * iqr)") + " as whisker_lo, "
        + r4("max(value) filter (where value <= q3 + 1.5 * iqr)") + " as whisker_hi, "
        "count(*) filter (where value < q1 - 1.5 * iqr or value > q3 + 1.5 * iqr) as n_outliers, count(*) as n "
        f"from {long} l join (select driver, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, "
        f"quantile_cont(value, 0.75) as q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr "
        f"from {long} z group by driver) s using (driver) group by driver, q1, median, q3, iqr", "scored")


@query("driver_box_stats", "A22 A23 (loyal quartiles, whiskers, outliers per driver)", sql=_box_sql())
def q_driver_box_stats(t: Inputs):
    return finish(DR.box_stats(t.stored("scored"), NAMED_DRIVERS))


def _outlier_sql() -> str:
    loyal = (f"(select * from (select user_account_id, {', '.join(NAMED_DRIVERS)} from scored where {PREDICTION_COL} = 0) "
             f"unpivot (value for driver in ({', '.join(NAMED_DRIVERS)})))")
    return with_ctes(
        f"select user_account_id, driver, {r4('value')} as value from (select l.*, "
        "quantile_cont(value, 0.25) over (partition by driver) as q1, "
        f"quantile_cont(value, 0.75) over (partition by driver) as q3 from {loyal} l) z "
        "where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)", "scored")


@query("driver_outliers", "A23 (loyal values beyond the whiskers, as rows)", sql=_outlier_sql())
def q_driver_outliers(t: Inputs):
    return finish(DR.outliers(t.stored("scored"), NAMED_DRIVERS))


def _box_scaled_sql() -> str:
    loyal = (f"(select * from (select {', '.join(NAMED_DRIVERS)} from scored where {PREDICTION_COL} = 0) "
             f"unpivot (value for driver in ({', '.join(NAMED_DRIVERS)})))")
    scaled = (f"(select l.driver, (l.value - s.median) / nullif(s.iqr, 0) as value from {loyal} l join "
              f"(select driver, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) - "
              f"quantile_cont(value, 0.25) as iqr from {loyal} z group by driver) s using (driver) "
              f"where s.iqr <> 0)")
    return with_ctes(
        "select driver, " + ", ".join(f"{r4(c)} as {c}" for c in ("q1", "median", "q3", "iqr"))
        + ", " + r4("min(value) filter (where value >= q1 - 1.5 * iqr)") + " as whisker_lo, "
        + r4("max(value) filter (where value <= q3 + 1.5 * iqr)") + " as whisker_hi, "
        "count(*) filter (where value < q1 - 1.5 * iqr or value > q3 + 1.5 * iqr) as n_outliers, count(*) as n "
        f"from {scaled} l join (select driver, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, "
        f"quantile_cont(value, 0.75) as q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr "
        f"from {scaled} z group by driver) s using (driver) group by driver, q1, median, q3, iqr", "scored")


@query("driver_box_scaled", "A23 M5 (loyal box statistics on the robust-scaled drivers, as drawn)",
       sql=_box_scaled_sql())
def q_driver_box_scaled(t: Inputs):
    return finish(DR.scaled_box_stats(t.stored("scored"), NAMED_DRIVERS))


def _analysis_sql() -> str:
    loyal = (f"(select * from (select {', '.join(DRIVERS)} from scored where {PREDICTION_COL} = 0) "
             f"unpivot (value for driver in ({', '.join(DRIVERS)})))")
    churned = (f"(select * from (select user_account_id, {SCORE_COL}, {PREDICTION_COL}, {', '.join(DRIVERS)} "
               f"from scored where {PREDICTION_COL} = 1) unpivot (value for driver in ({', '.join(DRIVERS)})))")
    v = "(c.value - s.median) / nullif(s.iqr, 0)"
    return with_ctes(
        f"select c.user_account_id, c.{SCORE_COL}, c.{PREDICTION_COL}, c.driver, {r4(v)} as value, "
        f"({v} between -3 and 30) as in_view from {churned} c join (select driver, "
        f"quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr "
        f"from {loyal} z group by driver) s on c.driver = s.driver", "scored")


@query("driver_analysis", "M5 R2 E11 P5 (leavers' drivers scaled by the loyal median and IQR)",
       sql=_analysis_sql())
def q_driver_analysis(t: Inputs):
    return finish(DR.driver_analysis(t.stored("scored"), DRIVERS))


_DIMS = 64


@query("knn_vote", "C6 (10 nearest neighbours of every vector, itself included)",
       sql=f"select vec_id, {r4('avg(y)')} as score, cast(avg(y) > 0.5 as double) as prediction from ("
           "select a.vec_id, case when b.label < 5 then 1.0 else 0.0 end as y, row_number() over (partition by a.vec_id "
           "order by round(list_distance(cast(a.embedding as double[]), cast(b.embedding as double[])), 9), b.vec_id) as place "
           "from embeddings a, embeddings b) z where place <= 10 group by vec_id")
def q_knn_vote(t: Inputs):
    rows = t.embeddings.withColumn("y", (F.col("label") < 5).cast("double"))
    features = [f"element_at(embedding, {i + 1})" for i in range(_DIMS)]
    model = M.NearestNeighbours(features, k=10, id_col="vec_id", label="y").fit(rows)
    return finish(model.transform(rows).select("vec_id", "score", "prediction"))
