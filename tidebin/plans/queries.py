"""Every operator applied to the test tables; keys match `oracles.ORACLES`.

Orders stand in for admissions, line items for stays and incident records, events for a
short log. Interval tables that an analysis reads more than once are settled first, so
that the raw tables are scanned once.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebin.functions import columns as C
from tidebin.operators import align, association, backtest, bins, cluster, counts, density
from tidebin.operators import fill, importance, ordering, quantiles, regression, signal, stationarity
from tidebin.operators.folds import rolling_origin_folds as origin_folds
from tidebin.plans import pipelines
from tidebin.session import settle, shared_folder, spread
from tidebin.sources import files
from tidebin.streaming import intervals as streams

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
STATUS = ["o_orderstatus"]
MEASURES = ["customers", "urgent", "items", "returned", "quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round for comparison; adding 0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


# ---------------------------------------------------------------- shared inputs


def order_counts(spark, d, freq: int = 30, keys: Sequence[str] = (), origin=None, complete: bool = True, **options) -> DataFrame:
    """Orders per interval; keyed series run from their own first to their own last order."""
    orders = table(spark, d, "orders").select(*keys, "o_orderdate", F.lit(1).cast("bigint").alias("n_orders"))
    return bins.resample_forward(
        orders, "o_orderdate", freq, sums=["n_orders"], keys=keys, origin=origin, complete=complete,
        **{"bounds": "key"} | options,
    )


def order_series(spark, d) -> DataFrame:
    """Orders per 30 days and status, settled for analysis."""
    return settle(order_counts(spark, d, 30, STATUS).select(*STATUS, "bin_idx", "n_orders"))


def item_counts(spark, d, freq: int = 30, origin=None) -> DataFrame:
    rules = {"items": F.lit(True), "returned": F.col("l_returnflag") == "R"}
    daily = counts.daily_rule_counts(table(spark, d, "lineitem"), "l_shipdate", "l_orderkey", rules)
    return bins.resample_forward(daily, "day", freq, sums=list(rules), origin=origin)


def aligned(spark, d) -> DataFrame:
    """Interval matrix of order and item measures on one origin."""
    origin = "1995-01-01"
    orders = table(spark, d, "orders")
    per_day = orders.select(
        "o_orderdate", F.lit(1).cast("bigint").alias("n_orders"),
        (F.col("o_orderpriority") == "1-URGENT").cast("bigint").alias("urgent"),
    )
    base = bins.resample_forward(per_day, "o_orderdate", 30, sums=["n_orders", "urgent"], origin=origin)
    customers = counts.daily_distinct_count(orders, "o_orderdate", "o_custkey", "customers")
    people = bins.resample_forward(customers, "day", 30, sums=["customers"], origin=origin)
    lines = table(spark, d, "lineitem").select(
        "l_shipdate", F.lit(1).cast("bigint").alias("items"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("returned"), F.col("l_quantity").alias("quantity"),
    )
    items = bins.resample_forward(lines, "l_shipdate", 30, sums=["items", "returned", "quantity"], origin=origin)
    keep = list(align.INTERVAL)
    return align.align_inner(
        base.select("bin_idx", *keep, "n_orders", "urgent"),
        people.select(*keep, "customers"),
        items.select(*keep, "items", "returned", "quantity"),
    )


# ---------------------------------------------------------------- counts and bins


def weekly_event_counts(spark, d):
    rules = {t: F.col("event_type") == t for t in EVENT_TYPES}
    daily = counts.daily_rule_counts(table(spark, d, "events"), "ts", "event_id", rules)
    return bins.resample_forward(daily, "day", 7, sums=list(rules))


def daily_distinct_count(spark, d):
    return counts.daily_distinct_count(table(spark, d, "orders"), "o_orderdate", "o_custkey", "customers")


def daily_conditional_counts(spark, d):
    """Overlapping text rules on the part behind each line item."""
    lines = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_returnflag", "l_shipdate")
    parts = table(spark, d, "part").select("p_partkey", "p_type", "p_name")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey)
    back = F.col("l_returnflag") == "R"
    rules = {
        "total_returned": back,
        "grave_returned": back & pipelines.text_rule("p_type", ["PROMO"], ["ECON", "SMALL"]),
        "total_accepted": F.col("l_returnflag") == "A",
        "promo_returned": back & pipelines.text_rule("p_type", ["PROMO"], []),
        "ring_returned": back & pipelines.text_rule("p_name", [], ["ring"]),
        "bolt_returned": back & pipelines.text_rule("p_name", [], ["bolt"]),
    }
    return counts.daily_rule_counts(rows, "l_shipdate", "l_orderkey", rules)


def distinct_rows(spark, d):
    return counts.distinct_rows(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"])


def resample_forward_sum(spark, d):
    return pipelines.interval_distinct_counts(
        table(spark, d, "orders"), "1995-03-01", 30, date_col="o_orderdate", id_col="o_custkey", out="customers"
    )


def resample_forward_mean(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    lines = spread(lines, lines.count(), "l_orderkey")
    stays = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    out = pipelines.interval_mean_stay(
        stays, "1995-03-01", 30, id_col="l_orderkey", admitted="o_orderdate", discharged="l_shipdate"
    )
    return rounded(out, "avg_los_days")


def resample_backward_mean_30(spark, d):
    return pipelines.interval_population(
        table(spark, d, "orders"), 30, date_col="o_orderdate", value="o_totalprice", out="mean_price"
    )


def resample_backward_mean_7(spark, d):
    return pipelines.interval_population(
        table(spark, d, "orders"), 7, date_col="o_orderdate", value="o_totalprice", out="mean_price",
        interpolate=True,
    )


def complete_bins(spark, d):
    events = table(spark, d, "events").withColumn("n_events", F.lit(1).cast("bigint"))
    every = bins.resample_forward(events, "ts", 7, sums=["n_events"], keys=["event_type"], complete=False, bounds="key")
    return bins.complete_bins(every, 7)


def feed_calendar(spark, d):
    """Every customer on the calendar of all orders."""
    return order_counts(spark, d, 30, ["o_custkey"], bounds="feed")


def feed_calendar_totals(spark, d):
    """Sums over customers on one calendar: those of the unkeyed intervals."""
    each = feed_calendar(spark, d)
    return each.groupBy("bin_idx", "start_date").agg(F.sum("n_orders").alias("n_orders"))


def gap_fill(spark, d):
    return order_counts(spark, d, 30, ["o_custkey"], complete=False)


def interpolate_linear(spark, d):
    sparse = order_counts(spark, d, 30, ["o_custkey"], complete=False).withColumn("n_orders", C.null_if_zero("n_orders"))
    full = fill.interpolate_linear(settle(sparse), ["o_custkey"], "bin_idx", "n_orders")
    return rounded(full.select("o_custkey", "bin_idx", "n_orders"), "n_orders")


def date_bounds(spark, d):
    return bins.date_bounds(table(spark, d, "orders"), "o_orderdate", STATUS)


def union_with_cutover(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    archive = orders.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    feed = C.filter_since(orders, "o_orderdate", "1998-06-01")
    both = counts.union_with_cutover(archive.withColumn("source", F.lit("archive")), feed.withColumn("source", F.lit("feed")), "o_orderdate")
    return both.groupBy("source", C.trunc_day("o_orderdate").alias("day")).agg(F.count("o_orderkey").alias("n_orders"))


def interval_rule_counts(spark, d):
    """Archive and current feed, rules, 30-day intervals and the derived difference."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_linestatus")
    archive = lines.filter(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    feed = C.filter_since(lines, "l_shipdate", "1999-10-01")
    back = F.col("l_returnflag") == "R"
    rules = {"total_back": back, "open_back": back & (F.col("l_linestatus") == "O")}
    out = pipelines.interval_rule_counts(
        archive, feed, "1995-03-01", 30, date_col="l_shipdate", id_col="l_orderkey", rules=rules
    )
    return out.withColumn("closed_back", F.col("total_back") - F.col("open_back"))


def late_rule_counts(spark, d):
    """A start after the archive's end: the current feed alone, from that day on."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag")
    archive = lines.filter(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    rules = {"total_back": F.col("l_returnflag") == "R"}
    return pipelines.interval_rule_counts(
        archive, C.filter_since(lines, "l_shipdate", "1997-10-01"), "1999-03-01", 30,
        date_col="l_shipdate", id_col="l_orderkey", rules=rules,
    )


#: Offence texts that stand in for the types of a part, by the first word of `p_type`.
OFFENCES = {
    "PROMO": "MURDER & NON-NEGL. MANSLAUGHTER", "STANDARD": "ROBBERY", "SMALL": "FELONY ASSAULT",
    "MEDIUM": "GRAND LARCENY", "LARGE": "GRAND LARCENY OF MOTOR VEHICLE", "ECONOMY": "DANGEROUS WEAPONS",
}


def _records(spark, d, levels: Sequence[str]) -> DataFrame:
    """Line items as offence records: text from the part, level from the return flag."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_returnflag")
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    text, kind = F.lit("BURGLARY"), F.split("p_type", " ")[0]
    for word, offence in OFFENCES.items():
        text = F.when(kind == word, offence).otherwise(text)
    level = F.when(F.col("l_returnflag") == "R", levels[0]).when(F.col("l_returnflag") == "A", levels[1]).otherwise("VIOLATION")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey)
    return rows.select("l_orderkey", "l_shipdate", text.alias("OFNS_DESC"), level.alias("LAW_CAT_CD"))


def complaint_intervals(spark, d):
    rows = _records(spark, d, pipelines.COMPLAINT_LEVELS)
    return pipelines.interval_rule_counts(
        rows, None, "1995-03-01", 30, date_col="l_shipdate", id_col="l_orderkey", rules=pipelines.complaint_rules()
    )


def arrest_intervals(spark, d):
    rows = _records(spark, d, pipelines.ARREST_LEVELS)
    return pipelines.interval_rule_counts(
        rows, None, "1995-03-01", 30, date_col="l_shipdate", id_col="l_orderkey", rules=pipelines.arrest_rules()
    )


# ---------------------------------------------------------------- alignment


def align_inner(spark, d):
    return rounded(aligned(spark, d), "quantity", digits=2)


def _order_and_item_bins(spark, d):
    origin = "1994-12-02"
    people = order_counts(spark, d, 30, origin=origin).select(*align.INTERVAL, "n_orders")
    rows = table(spark, d, "lineitem").select("l_shipdate", F.lit(1).cast("bigint").alias("items"))
    items = bins.resample_forward(rows, "l_shipdate", 30, sums=["items"], origin=origin)
    return people, items.select(*align.INTERVAL, "items")


def align_left(spark, d):
    """Items go on after the last order: their last intervals have no orders beside them."""
    people, items = _order_and_item_bins(spark, d)
    return align.align_left(items, people)


def study_table(spark, d):
    people, items = _order_and_item_bins(spark, d)
    return rounded(pipelines.study_table(items, people, log_cols=["n_orders", "items"]), "n_orders", "items")


def align_by_position(spark, d):
    """Side by side on the interval number, counted from one origin; unmatched positions are not padded."""
    origin = "1994-12-02"
    people = order_counts(spark, d, origin=origin).select("bin_idx", "n_orders")
    return align.align([people, item_counts(spark, d, origin=origin).select("bin_idx", "items", "returned")], on=["bin_idx"])


# ---------------------------------------------------------------- columns and order


def era_split(spark, d):
    """Count, mean and exact median of the interval values before and after a cut-off."""
    eras = order_counts(spark, d).withColumn("era", C.era("start_date", "1998-06-01"))
    return rounded(
        eras.groupBy("era").agg(
            F.count("n_orders").alias("n"), F.avg("n_orders").alias("mean"), F.median("n_orders").alias("median")
        ),
        "mean", "median",
    )


def mean_median(spark, d):
    return rounded(
        order_counts(spark, d, 30, STATUS).groupBy(*STATUS).agg(
            F.avg("n_orders").alias("mean"), F.median("n_orders").alias("median")
        ),
        "mean", "median",
    )


def group_stats(spark, d):
    return rounded(cluster.cluster_spans(order_counts(spark, d, 30, STATUS), "n_orders", "o_orderstatus"), "mean")


def row_counts(spark, d):
    names = ["orders", "lineitem", "part", "events"]
    each = [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in names]
    out = each[0]
    for other in each[1:]:
        out = out.unionAll(other)
    return out


def elapsed_days(spark, d):
    """Floored elapsed days to and from a fixed instant, next to calendar days."""
    noon = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select(
        "event_id",
        C.elapsed_days(noon, "ts").alias("since"),
        C.elapsed_days(F.col("ts"), noon).alias("until"),
        C.days_between(C.trunc_day("ts"), F.lit("2024-01-15").cast("date")).alias("calendar_days"),
    )


def date_columns(spark, d):
    day = C.local_date("o_orderdate")
    out = table(spark, d, "orders").select(
        "o_orderkey", day.alias("day"), C.add_days(day, 29).alias("plus_29"), C.sub_days(day, 29).alias("minus_29")
    )
    return C.with_date_parts(out, "day")


def derived_columns(spark, d):
    out = item_counts(spark, d)
    return rounded(
        out.select(
            "start_date",
            (F.col("items") - F.col("returned")).alias("kept"),
            (F.col("items") / 30).alias("items_per_day"),
            F.log1p("items").alias("log_items"),
        ),
        "items_per_day", "log_items",
    )


def round_half_even(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", C.round_half_even(F.col("l_quantity") / 2).alias("half_quantity"),
        C.null_if_zero(C.round_half_even(F.col("l_quantity") / 8)).alias("eighth"),
        C.coalesce_zero(C.null_if_zero(F.col("l_quantity") - 1)).alias("others"),
    )


def filter_since(spark, d):
    orders = table(spark, d, "orders")
    since = C.filter_since(orders, "o_orderdate", "2001-01-01").agg(F.count(F.lit(1)).alias("n_since"))
    after = C.filter_since(orders, "o_orderdate", "2001-01-01", strict=True).agg(F.count(F.lit(1)).alias("n_after"))
    return since.select("n_since", after.scalar().alias("n_after"))


def prefix_columns(spark, d):
    wide = daily_conditional_counts(spark, d)
    return wide.select("day", *C.columns_with_prefix(wide, "total_"))


def first_and_last(spark, d):
    """First and last intervals by date: a top-k at either end."""
    out = order_counts(spark, d).select("start_date", "end_date", "n_orders")
    head = ordering.first_rows(out, 5, "start_date").withColumn("side", F.lit("first"))
    tail = ordering.last_rows(out, 5, "start_date").withColumn("side", F.lit("last"))
    return head.unionByName(tail)


def drop_and_rename(spark, d):
    people, items = _order_and_item_bins(spark, d)
    joined = align.align_left(items, people).dropna("any")
    return joined.withColumnsRenamed({"n_orders": "orders", "items": "lines"}).drop("end_date")


# ---------------------------------------------------------------- series


def diff_1(spark, d):
    return signal.difference(order_series(spark, d), STATUS, "bin_idx", "n_orders", 1)


def diff_2(spark, d):
    return signal.difference(order_series(spark, d), STATUS, "bin_idx", "n_orders", 2)


def sparse_days(spark, d) -> DataFrame:
    """Orders per day and status, days without orders left out: series with gaps."""
    return settle(order_counts(spark, d, 1, STATUS, complete=False, fill=False).select(*STATUS, "bin_idx", "n_orders"))


def diff_gaps(spark, d):
    return signal.difference(sparse_days(spark, d), STATUS, "bin_idx", "n_orders", 1)


def trend_gaps(spark, d):
    out = signal.centered_trend(sparse_days(spark, d), STATUS, "bin_idx", "n_orders", 6)
    return rounded(out.filter("trend is not null"), "trend")


def decompose_additive(spark, d):
    out = signal.decompose_additive(order_series(spark, d), STATUS, "bin_idx", "n_orders")
    return rounded(out, "observed", "trend", "seasonal", "resid")


def acf24(spark, d):
    return rounded(signal.acf(order_series(spark, d), STATUS, "bin_idx", "n_orders"), "acf", "ci_lo", "ci_hi")


def pacf24(spark, d):
    return rounded(signal.pacf(order_series(spark, d), STATUS, "bin_idx", "n_orders"), "pacf", "ci_lo", "ci_hi")


def order_hint(spark, d):
    curves = signal.acf_pacf(order_series(spark, d), STATUS, "bin_idx", "n_orders")
    return rounded(signal.order_hint(curves, STATUS), "acf1")


def stationary_signal(spark, d):
    return stationarity.stationary_signal(order_series(spark, d), STATUS, "bin_idx", "n_orders")


def adf_lag0(spark, d):
    out = stationarity.adf_test(order_series(spark, d), STATUS, "bin_idx", "n_orders", maxlag=0)
    return rounded(out.drop("pvalue"), "stat", "crit_1", "crit_5", "crit_10")


def adf_test(spark, d):
    """Levels and both differences of every series at once."""
    all_d = signal.all_differences(order_series(spark, d), STATUS, "bin_idx", "n_orders")
    out = stationarity.adf_test(settle(all_d), [*STATUS, "d"], "bin_idx", "y")
    return rounded(out.select(*STATUS, "d", "stat", "usedlag", "nobs"), "stat", digits=5)


def adf_pvalues(spark, d):
    """The same tests with p-value and critical values."""
    return stationarity.adf_test(order_series(spark, d), STATUS, "bin_idx", "n_orders")


def ndiffs(spark, d):
    return stationarity.ndiffs(order_series(spark, d), STATUS, "bin_idx", "n_orders", alphas=(0.05, 0.025))


# ---------------------------------------------------------------- association and density


def pearson_matrix(spark, d):
    logs = C.log1p_columns(aligned(spark, d), ["n_orders", *MEASURES])
    return rounded(association.pearson_matrix(logs, ["n_orders", *MEASURES]), "r")


def corr_with_target(spark, d):
    logs = C.log1p_columns(aligned(spark, d), ["n_orders", *MEASURES])
    return ordering.ranked(rounded(association.corr_with_target(logs, "n_orders", MEASURES), "r"), "r")


def partial_corr(spark, d):
    return rounded(association.partial_corr(aligned(spark, d), "n_orders", ["urgent", "items", "returned"]), "r", digits=5)


def kde(spark, d):
    return rounded(density.kde(table(spark, d, "part"), "p_retailprice", count_equal=True), "x", "density", "bandwidth", digits=8)


def kde_by_group(spark, d):
    return rounded(density.kde(table(spark, d, "part"), "p_retailprice", ["p_type"], count_equal=True), "x", "density", "bandwidth", digits=8)


def kmeans2(spark, d):
    series = settle(order_counts(spark, d).select("start_date", "end_date", "n_orders"))
    return cluster.kmeans_1d(series, "n_orders")


def cluster_spans(spark, d):
    return rounded(cluster.cluster_spans(kmeans2(spark, d), "n_orders"), "mean")


def kmeans3_by_status(spark, d):
    """Three exact clusters of each status' series, with their spans."""
    series = settle(order_counts(spark, d, 30, STATUS).select(*STATUS, "start_date", "end_date", "n_orders"))
    found = cluster.kmeans_keyed(series, "n_orders", STATUS, 3)
    return rounded(cluster.cluster_spans(found, "n_orders", keys=STATUS), "mean")


# ---------------------------------------------------------------- regression


def minmax_scale(spark, d):
    out = regression.minmax_scale(order_series(spark, d), ["n_orders"], STATUS)
    return rounded(out, "n_orders")


def _matrix(spark, d) -> DataFrame:
    return settle(aligned(spark, d))


def ols_inference(spark, d):
    x = ["urgent", "items"]
    fit = regression.ols_fit(_matrix(spark, d), "n_orders", x)
    return rounded(regression.ols_inference(fit, x).drop("p"), "r2", "adj_r2", "aic", "coef", "se", "t", digits=5)


def ols_chrono(spark, d):
    fit = regression.fit_holdout(_matrix(spark, d), "n_orders", ["urgent", "items"])
    return rounded(fit.metrics, "mse", "mae", digits=5)


def ols_chrono_gaps(spark, d):
    """Trend per status on series with gaps: the first rows train, not the first positions."""
    fit = regression.fit_holdout(sparse_days(spark, d), "n_orders", ["bin_idx"], keys=STATUS)
    return rounded(fit.metrics, "mse", "mae", digits=5)


def ols_random(spark, d):
    fit = regression.fit_holdout(_matrix(spark, d), "n_orders", ["urgent", "items"], split="random", seed=7)
    return rounded(fit.metrics, "mse", "mae", digits=5)


def ols_scaled_coefficients(spark, d):
    x = ["urgent", "items"]
    fit = regression.fit_holdout(_matrix(spark, d), "n_orders", x).fit
    return rounded(regression.ols_inference(fit, x).select("term", "coef"), "coef", digits=5)


def ols_per_series(spark, d):
    """One fit per series: interval value on its position."""
    fit = regression.ols_fit(order_series(spark, d), "n_orders", ["bin_idx"], STATUS)
    return rounded(regression.ols_inference(fit, ["bin_idx"], STATUS).drop("p", "adj_r2"), "r2", "aic", "coef", "se", "t", digits=5)


def exact_quantiles(spark, d):
    """Median and other quantiles of prices by return flag, over all items."""
    items = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    out = quantiles.exact_quantiles(items, "l_extendedprice", [0.1, 0.5, 0.99], ["l_returnflag"])
    return rounded(out, "quantile", digits=4)


def split_random(spark, d):
    """Exact random share per status over all orders."""
    orders = table(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    return regression.split_random(orders, ["o_orderkey"], STATUS, seed=3)


def rf_importance(spark, d):
    rows = _matrix(spark, d)
    model = importance.fit_forest(rows, "n_orders", MEASURES)
    return importance.impurity_importance(model, MEASURES, rows)


def permutation_importance(spark, d):
    rows = _matrix(spark, d)
    model = importance.fit_forest(rows, "n_orders", MEASURES)
    return importance.permutation_importance(model, rows, "n_orders", MEASURES, ["bin_idx"])


# ---------------------------------------------------------------- model selection

FOLDS = {"train": 36, "horizon": 6, "step": 6}


def rolling_origin_folds(spark, d):
    out = origin_folds(order_series(spark, d), STATUS, "bin_idx", **FOLDS)
    return out.select(*STATUS, "fold", "role", "step_ahead", "bin_idx", "n_orders")


def backtest_ar1(spark, d):
    out = backtest.backtest_folds(order_series(spark, d), STATUS, "bin_idx", "n_orders", orders=[(1, 0), (1, 1)], **FOLDS)
    return rounded(out, "mae", digits=5)


def backtest_every_origin(spark, d):
    """A fold starts at every position, so a row is in up to 36 of them."""
    every = FOLDS | {"step": 1}
    out = backtest.backtest_folds(order_series(spark, d), STATUS, "bin_idx", "n_orders", orders=[(1, 0), (1, 1)], **every)
    return rounded(out, "mae", digits=5)


def backtest_grid(spark, d):
    folds = backtest.backtest_folds(
        order_series(spark, d), STATUS, "bin_idx", "n_orders", orders=[(p, q) for p in range(4) for q in range(3)], **FOLDS
    )
    return rounded(backtest.backtest_grid(folds, STATUS), "mae", digits=4)


def backtest_arma101(spark, d):
    """One autoregressive and one moving-average term, over an autoregression of two lags."""
    out = backtest.backtest_arma(order_series(spark, d), STATUS, "bin_idx", "n_orders", orders=[(1, 0, 1)], long=2, **FOLDS)
    return rounded(out, "mae", digits=4)


def arma_grid(spark, d):
    """All orders up to (2, 1, 1), ranked."""
    orders = [(p, i, q) for p in range(3) for i in range(2) for q in range(2)]
    folds = backtest.backtest_arma(order_series(spark, d), STATUS, "bin_idx", "n_orders", orders=orders, long=2, **FOLDS)
    return rounded(backtest.arma_grid(folds, STATUS), "mae", digits=4)


def funnel_comparison(spark, d):
    rows = _matrix(spark, d).withColumn("series", F.lit("orders"))
    sets = {"none": [], "items": ["items"], "returned": ["returned"], "urgent": ["urgent"]}
    folds = backtest.backtest_folds(
        rows, ["series"], "bin_idx", "n_orders", orders=[(p, 0) for p in range(3)] + [(1, 1)], exog_sets=sets, **FOLDS
    )
    return backtest.funnel_comparison(backtest.backtest_grid(folds, ["series"]), ["series"])


def forecast12(spark, d):
    out = backtest.forecast(order_series(spark, d), STATUS, "bin_idx", "n_orders", order=(1, 0))
    return rounded(out, "forecast", digits=5)


def forecast_best(spark, d):
    """Each series projected with the order its own backtest prefers."""
    series = order_series(spark, d)
    folds = backtest.backtest_folds(
        series, STATUS, "bin_idx", "n_orders", orders=[(p, q) for p in range(3) for q in range(2)], **FOLDS
    )
    best = settle(backtest.backtest_grid(folds, STATUS).filter("rank = 1").select(*STATUS, "p", "d"))
    out = backtest.forecast(series, STATUS, "bin_idx", "n_orders", chosen=best, max_order=(2, 1))
    return rounded(out, "forecast", digits=4)


# ---------------------------------------------------------------- files and streams


def csv_round_trip(spark, d):
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write_interval_csv(order_counts(spark, d).select("start_date", "end_date", "n_orders"), path)
    return files.read_interval_csv(spark, path, "start_date date, end_date date, n_orders bigint", index=False)


def json_round_trip(spark, d):
    path = f"{shared_folder(spark)}/json-{uuid.uuid4().hex}"
    daily = daily_distinct_count(spark, d)
    daily.select(F.col("day").cast("string"), F.col("customers").cast("string")).write.json(path)
    return files.read_json_records(spark, path, "day date, customers bigint not null", array_file=False)


def _as_arrays(batches):
    """Lines of JSON as one array for each partition."""
    sign = "["
    for batch in batches:
        lines = [f"{',' if i or sign == ',' else '['}{text.as_py()}" for i, text in enumerate(batch.column(0))]
        sign = "," if lines else sign
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if sign == "[" else "]"])], names=["value"])


def json_array_round_trip(spark, d):
    """Events with braces and quotes in a text, from files of one array each, read in small blocks."""
    path = f"{shared_folder(spark)}/array-{uuid.uuid4().hex}"
    note = F.concat(F.lit('{"\\'), "event_type", F.lit('"}, {'), "user_id")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string"), note.alias("note"), F.col("value").cast("string"))
    rows.repartition(3).select(F.to_json(F.struct("event_id", "note", "value")).alias("value")).mapInArrow(_as_arrays, "value string").write.text(path)
    return files.read_json_array(spark, path, "event_id bigint not null, note string, value double")


def object_csv(spark, d):
    """Daily counts written as an object and read from its path."""
    path = f"{shared_folder(spark)}/object-{uuid.uuid4().hex}.csv"
    daily_distinct_count(spark, d).write.option("header", True).csv(path)
    return files.read_object_csv(spark, path, "day date, customers bigint")


def parse_json_records(spark, d):
    return files.parse_json_records(table(spark, d, "events"), "props", "k int", ["event_id"])


def _event_stream(spark, d) -> DataFrame:
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def stream_interval_counts(spark, d):
    stream = _event_stream(spark, d)
    out = streams.stream_interval_counts(stream, "ts", 7, dt.date(2024, 1, 1), ["event_type"])
    target = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        out.writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", f"{target}-log").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(target)


def stream_filled_counts(spark, d):
    """Weekly counts of each type and user, empty weeks too, from a stream of the event table
    in slices of some days, so that keys fall silent and late events come."""
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "user_id")
    target = f"{shared_folder(spark)}/filled-{uuid.uuid4().hex}"
    late = F.date_add(F.to_date("ts"), F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    for low, high in (("2000-01-01", "2024-01-08"), ("2024-01-08", "2024-01-20"), ("2024-01-20", "2100-01-01")):
        rows.filter((late >= F.lit(low).cast("date")) & (late < F.lit(high).cast("date"))).coalesce(1).write.mode("append").parquet(f"{target}-feed")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}-feed")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streams.ROCKSDB)
    try:
        out = streams.stream_filled_counts(stream, "ts", 7, dt.date(2024, 1, 1), ["event_type", "user_id"], delay="2 days")
        query = (
            out.writeStream.format("parquet").outputMode("append").option("path", target)
            .option("checkpointLocation", f"{target}-log").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(out.schema).parquet(target)


def accumulate_snapshots(spark, d):
    """Every event is delivered once; those of odd users a second time, as a newer snapshot of
    their day, in several files of mixed deliveries that come one by one. The 13th is unknown."""
    day = F.to_date("ts")
    rows = table(spark, d, "events").select(F.when(F.dayofmonth(day) != 13, day).alias("day"), "event_id", "user_id")
    twice = rows.select("*", F.explode(F.when(F.col("user_id") % 2 == 1, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("delivery"))
    target = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    twice.repartition(4, "user_id").write.parquet(f"{target}-feed")
    feed = spark.readStream.schema(twice.schema).option("maxFilesPerTrigger", 1).parquet(f"{target}-feed")
    streams.accumulate_snapshots(feed, target, f"{target}-log", "day", "delivery").awaitTermination()
    stored = spark.read.schema("event_id bigint, user_id bigint, delivery int, day date").parquet(target)
    return stored.groupBy("day").agg(F.count("event_id").alias("n_rows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        weekly_event_counts, daily_distinct_count, daily_conditional_counts, distinct_rows,
        resample_forward_sum, resample_forward_mean, resample_backward_mean_30, resample_backward_mean_7,
        complete_bins, gap_fill, feed_calendar, feed_calendar_totals, interpolate_linear, date_bounds, union_with_cutover, interval_rule_counts,
        late_rule_counts, complaint_intervals, arrest_intervals,
        align_inner, align_left, study_table, align_by_position,
        era_split, mean_median, group_stats, row_counts, elapsed_days, date_columns, derived_columns,
        round_half_even, filter_since, prefix_columns, first_and_last, drop_and_rename,
        diff_1, diff_2, diff_gaps, trend_gaps, decompose_additive, acf24, pacf24, order_hint, stationary_signal,
        adf_lag0, adf_test, adf_pvalues, ndiffs,
        pearson_matrix, corr_with_target, partial_corr, kde, kde_by_group, kmeans2, cluster_spans, kmeans3_by_status,
        minmax_scale, ols_inference, ols_chrono, ols_chrono_gaps, ols_random, ols_scaled_coefficients, ols_per_series,
        exact_quantiles, split_random, rf_importance, permutation_importance,
        rolling_origin_folds, backtest_ar1, backtest_every_origin, backtest_grid, backtest_arma101, arma_grid, funnel_comparison, forecast12, forecast_best,
        csv_round_trip, json_round_trip, json_array_round_trip, object_csv, parse_json_records, stream_interval_counts, stream_filled_counts,
        accumulate_snapshots,
    )
}
