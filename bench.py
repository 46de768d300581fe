"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query is executed in full with a no-op write (all columns produced,
nothing collected). The classifier entries time 5-fold cross-validation plus a
final fit on the training split of the account table, the unit of the published
classifier timings.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from attrition.operators import evaluate as EV  # noqa: E402
from attrition.operators import models as M  # noqa: E402
from attrition.plans import Inputs, runner  # noqa: E402
from attrition.plans.catalogue_models import FEATS, model_frame, train_rows  # noqa: E402
from attrition.schema import KEY  # noqa: E402
from attrition.session import local_session  # noqa: E402

HEADLINE = [
    "usage_panel", "account_table", "account_months_means", "ratio_features", "describe_table",
    "corr_all", "corr_by_class", "rate_by_indicator", "class_quartiles", "profile_numeric",
    "profile_sketch", "profile_account_table", "top_values", "histogram_equal_width", "exact_distinct",
    "standardised", "auc_rank", "roc_points", "gaussian_nb_predict", "driver_box_stats",
    "driver_analysis", "call_list",
]

CV_MODELS = {
    "cv5_naive_bayes": lambda: M.GaussianNaiveBayes(FEATS),
    "cv5_lda": lambda: M.LinearDiscriminant(FEATS),
    "cv5_logistic": lambda: M.logistic_regression(20),
    "cv5_decision_tree": lambda: M.decision_tree(),
    "cv5_random_forest": lambda: M.random_forest(20),
    "cv5_extra_trees": lambda: M.extra_trees(20),
    "cv5_sgd_logistic": lambda: M.SGDLogistic(FEATS),
    "cv5_knn": lambda: M.NearestNeighbours(FEATS, k=10, id_col=KEY),
    "cv5_gradient_boosting": lambda: M.gradient_boosting(100),
}


def run_query(spark, name: str, sf_dir: str) -> float:
    t0 = time.time()
    runner(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def run_cv(spark, make, sf_dir: str) -> float:
    data = train_rows(model_frame(Inputs(spark, sf_dir), k=5))
    t0 = time.time()
    _, _, metrics = EV.cross_validate(data, make, refit=True)
    metrics.collect()
    return time.time() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2 if cpus.isdigit() else 16),
                          app="attrition-bench")
    # warm-up on the smallest data set (other files): JVM start and JIT are not part of any query's time
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        runner("account_table")(spark, warm_dir).write.format("noop").mode("overwrite").save()
    spark.read.parquet(f"{sf_dir}/region.parquet").select(F.count(F.lit(1))).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        times[name] = round(run_query(spark, name, sf_dir), 3)
    for name, make in CV_MODELS.items():
        times[name] = round(run_cv(spark, make, sf_dir), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    out = {"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
