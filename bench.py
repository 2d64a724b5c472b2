"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`*_many` run an operator over one series per customer instead of one per status.

Each query runs once to warm the JVM and is then timed, with its whole result
materialised by the tasks (the `noop` sink), nothing collected to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidebin.operators import backtest, density, regression, signal, stationarity  # noqa: E402
from tidebin.plans.queries import QUERIES, order_counts  # noqa: E402
from tidebin.session import local_session, settle  # noqa: E402

HEADLINE = [
    "weekly_event_counts", "daily_distinct_count", "daily_conditional_counts", "resample_forward_sum",
    "resample_forward_mean", "resample_backward_mean_30", "resample_backward_mean_7", "gap_fill", "interpolate_linear",
    "interval_rule_counts", "align_inner", "decompose_additive", "acf24", "pacf24", "adf_test", "ndiffs",
    "pearson_matrix", "partial_corr", "kde_by_group", "kmeans2", "ols_chrono", "ols_random", "rf_importance",
    "permutation_importance", "backtest_grid", "forecast12", "stream_interval_counts",
]
KEYS = ["o_custkey"]
MANY = {
    "acf_many": lambda df: signal.acf(df, KEYS, "bin_idx", "n_orders", nlags=6),
    "adf_many": lambda df: stationarity.adf_test(df, KEYS, "bin_idx", "n_orders", maxlag=2),
    "ols_many": lambda df: regression.ols_fit(df, "n_orders", ["bin_idx"], KEYS),
    "backtest_many": lambda df: backtest.backtest_folds(
        df, KEYS, "bin_idx", "n_orders", orders=[(0, 0), (1, 0), (1, 1)], train=36, horizon=6, step=6
    ),
    "kde_many": lambda df: density.kde(df, "n_orders", KEYS),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or [*HEADLINE, *MANY]
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    series = settle(order_counts(spark, sf_dir, 30, KEYS, bounds="feed")) if set(names) & set(MANY) else None
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            out = MANY[name](series) if name in MANY else QUERIES[name](spark, sf_dir)
            out.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    many = series.selectExpr("count(*) AS rows", "count(DISTINCT o_custkey) AS series").first().asDict() if series is not None else {}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "headline_r1": round(sum(seconds.get(n, 0.0) for n in HEADLINE), 3),
                "many": many,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
