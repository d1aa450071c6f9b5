"""Headline queries timed on local Spark; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (cores), ``BENCH_ALL=1``
(every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelforge.plans import QUERIES  # noqa: E402
from panelforge.session import clear_scratch, local_session  # noqa: E402

HEADLINE = [
    "agg_country_summary", "agg_location_summary", "agg_kpis", "agg_corr_matrix", "agg_quantiles",
    "agg_describe", "agg_box_stats", "agg_histogram", "agg_pivot", "agg_mean_of_means",
    "agg_linear_trend", "agg_regression_metrics", "wn_lag", "wn_rolling", "fe_feature_table",
    "cl_dedupe", "cl_impute_median", "cl_winsorize", "cl_clean_panel", "ts_interpolate",
    "ts_climatology_anomaly", "ts_supervised", "ts_decompose_classical", "ts_stl",
    "fc_baselines", "fc_arima", "fc_sarima", "fc_additive", "fc_future", "fc_tree",
    "en_best_model", "en_stacking", "ml_dbscan_noise", "ml_isolation_forest", "ml_kmeans",
    "ml_pca2", "fi_permutation", "fi_shap",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    times = {}
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")

    def so_far() -> str:
        return json.dumps({
            "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
            "sf": float(scale) if scale.replace(".", "").isdigit() else scale, "open": names[len(times):],
        })

    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
        # After each query, so that a run that is stopped keeps its figures; the last line has all of them.
        print(so_far(), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
