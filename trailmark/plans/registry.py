"""Every query by name: a function from (session, input folder) to a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.columns import half_up, long, unpivot_row
from trailmark.operators import (
    anomaly,
    churn,
    cleaning,
    experiment,
    funnel,
    kpi,
    product,
    quality,
    recommend,
    retention,
    segments,
    sketches,
)
from trailmark.session import cut, shared_dir
from trailmark.sources import files, incremental
from trailmark.sources.tables import Workspace, workspace
from trailmark.streaming import live

Query = Callable[[Workspace], DataFrame]


def _scratch(w: Workspace, name: str) -> str:
    tag = "".join(c if c.isalnum() else "_" for c in w.folder)
    return f"{shared_dir(w.spark)}/files/{tag}/{name}"


# --- ingestion ------------------------------------------------------------------------------------


def _csv_round_trip(w: Workspace) -> DataFrame:
    path = _scratch(w, "raw_csv")
    w.raw.write.mode("overwrite").csv(path)
    return files.read_behavior_csv(w.spark, _scratch(w, "absent"), fallback=path)


def _written_by_date(w: Workspace) -> DataFrame:
    path = _scratch(w, "clean")
    files.write_clean(w.behavior, path)
    return files.read_clean(w.spark, path).groupBy("date").agg(F.count("*").alias("rows_written"))


def _raw_to_table(w: Workspace) -> DataFrame:
    path = _scratch(w, "clean_csv")
    files.write_clean(w.behavior, path, fmt="csv", by_date=False)
    files.write_clean(files.read_clean_csv(w.spark, path), f"{path}_table", codec="zstd", by_date=False)
    return quality.load_count(w.spark, f"{path}_table")


def _incremental_load(w: Workspace) -> DataFrame:
    """The raw events loaded in three parts, one of them twice; both tables read back by date."""
    run = _scratch(w, f"load-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64("user_id", "timestamp"), F.lit(3))
    for k in (0, 1, 1, 2):
        incremental.load_events(w.raw.where(part == k), f"{run}/cleaned", f"{run}/user_day", w.start_ts, w.end_ts)
    events = w.spark.read.parquet(f"{run}/cleaned").groupBy("date").agg(F.count("*").alias("events"))
    users = w.spark.read.parquet(f"{run}/user_day").groupBy("date").agg(
        F.count("*").alias("users"), F.sum("total_actions").alias("total_actions"), F.sum("buy_count").alias("buy_count")
    )
    return events.join(users, "date")


def _validate(w: Workspace) -> DataFrame:
    """The raw rows as they come have unknown behaviours and lack the derived columns."""
    return quality.validate_dataset(w.raw)


INGEST: dict[str, Query] = {
    "read_behavior_csv": _csv_round_trip,
    "schema_check": lambda w: cleaning.schema_check(w.raw),
    "null_profile": lambda w: cleaning.null_profile(w.raw),
    "clean_events": lambda w: cleaning.clean_events(w.raw),
    "clean_positive": lambda w: cleaning.clean_positive(w.raw),
    "cleaning_report": lambda w: cleaning.cleaning_report(w.raw),
    "time_features": lambda w: cleaning.time_features(cleaning.clean_events(w.raw)),
    "behavior_score": lambda w: cleaning.behavior_score_summary(w.behavior),
    "write_clean": _written_by_date,
    "raw_to_table": _raw_to_table,
    "incremental_load": _incremental_load,
    "stg_user_behavior": lambda w: cleaning.stg_user_behavior(w.behavior),
    "behavior_type_stats": lambda w: kpi.behavior_type_stats(w.behavior),
    "weekend_purchases": lambda w: kpi.weekend_purchases(w.behavior),
    "validate_dataset": _validate,
    # estimates from a row per day; the exact figures are those of dataset_overview
    "sketch_overview": lambda w: sketches.range_overview(
        sketches.daily_sketches(w.behavior, w.user_day), cleaning.START_DATE, cleaning.END_DATE
    ),
    "dataset_overview": lambda w: kpi.dataset_overview(w.behavior),
}

# --- KPI, retention, funnels, anomalies ----------------------------------------------------------------


def _mart_daily_kpi(w: Workspace) -> DataFrame:
    return kpi.mart_daily_kpi(
        w.user_day, retention.int_user_retention(w.user_day), funnel.int_conversion_funnel(w.behavior)
    )


KPI: dict[str, Query] = {
    "daily_metrics": lambda w: kpi.daily_metrics(w.user_day),
    "user_daily_summary": lambda w: kpi.user_daily_summary(w.behavior),
    "item_metrics": lambda w: kpi.item_metrics(w.behavior),
    "hourly_distribution": lambda w: kpi.hourly_distribution(w.behavior),
    "user_first_active": lambda w: kpi.user_first_active(w.user_day),
    "hourly_traffic": lambda w: kpi.hourly_traffic(w.behavior),
    "daily_metrics_ma7": lambda w: kpi.daily_metrics_ma(kpi.daily_metrics_pct(w.user_day)),
    "behavior_ratio": lambda w: kpi.behavior_ratio(w.behavior),
    "daily_kpi_report": lambda w: kpi.daily_kpi_report(w.user_day),
    "int_user_daily_metrics": lambda w: kpi.int_user_daily_metrics(w.behavior),
    "int_user_behavior_summary": lambda w: kpi.int_user_behavior_summary(w.user_day),
    "mart_daily_kpi": _mart_daily_kpi,
    "headline_metrics": lambda w: kpi.headline_metrics(w.behavior, w.user_day),
    "behavior_distribution": lambda w: kpi.behavior_distribution(w.behavior),
    "dau_trend": lambda w: kpi.dau_trend(w.user_day),
    "hourly_activity": lambda w: kpi.hourly_activity(w.behavior),
    "activity_heatmap": lambda w: kpi.activity_heatmap(w.behavior),
    "weekend_vs_weekday": lambda w: kpi.weekend_vs_weekday(w.behavior),
    "apply_filters": lambda w: kpi.apply_filters(
        w.behavior, behaviors=["buy", "cart"], hours=(8, 20), weekend="weekend"
    ).select(*files.CLEAN_SCHEMA.fieldNames()),
    "apply_filters_dates": lambda w: kpi.apply_filters(
        w.behavior, dates=["2024-01-05", "2024-01-06"]
    ).select(*files.CLEAN_SCHEMA.fieldNames()),
    "kpi_cards": lambda w: kpi.kpi_cards(w.user_day),
    "behavior_trend": lambda w: kpi.behavior_trend(w.behavior),
    "hourly_by_behavior": lambda w: kpi.hourly_by_behavior(w.behavior),
    "repurchase_trend": lambda w: kpi.repurchase_trend(w.user_day),
    "bounce_rate": lambda w: kpi.bounce_rate(w.user_day),
    "data_explorer": lambda w: kpi.data_explorer(w.behavior).select(*files.CLEAN_SCHEMA.fieldNames()),
    "kpi_change_alert": lambda w: kpi.kpi_change_alert(w.user_day),
}

RETENTION: dict[str, Query] = {
    "daily_new_users": lambda w: retention.daily_new_users(w.user_day),
    "retention_d137": lambda w: retention.retention_dn(w.user_day),
    "retention_matrix": lambda w: retention.retention_matrix(w.user_day),
    "user_cohorts": lambda w: retention.user_cohorts(w.user_day),
    "retention_trend": lambda w: retention.retention_trend(w.user_day),
    "int_user_retention": lambda w: retention.int_user_retention(w.user_day),
    "mart_user_retention": lambda w: retention.mart_user_retention(w.user_day),
    "cohort_pivot": lambda w: retention.cohort_pivot(w.user_day),
    "cohort_table": lambda w: retention.cohort_table(w.user_day),
    "cohort_key_metrics": lambda w: retention.cohort_key_metrics(w.user_day),
}

FUNNEL: dict[str, Query] = {
    "user_funnel": lambda w: funnel.user_funnel(w.user_day),
    "user_funnel_by_day": lambda w: funnel.user_funnel(w.user_day, "user_date"),
    "user_funnel_by_item": lambda w: funnel.user_funnel(w.behavior, "user_item"),
    "event_pair_conversion": lambda w: funnel.event_pair_conversion(w.user_day),
    "event_pair_conversion_by_day": lambda w: funnel.event_pair_conversion(w.user_day, "user_date"),
    "event_pair_conversion_by_item": lambda w: funnel.event_pair_conversion(w.behavior, "user_item"),
    "conversion_paths": lambda w: funnel.conversion_paths(w.user_day),
    "conversion_paths_by_day": lambda w: funnel.conversion_paths(w.user_day, "user_date"),
    "conversion_paths_by_item": lambda w: funnel.conversion_paths(w.behavior, "user_item"),
    "daily_funnel": lambda w: funnel.daily_funnel(w.user_day),
    "period_funnel": lambda w: funnel.period_funnel(w.behavior),
    "int_conversion_funnel": lambda w: funnel.int_conversion_funnel(w.behavior),
    "item_path_stats": lambda w: funnel.item_path_stats(w.behavior),
    "action_funnel": lambda w: funnel.action_funnel(w.user_day),
    "action_pair_rates": lambda w: funnel.action_pair_rates(w.user_day),
}

ANOMALY: dict[str, Query] = {
    "zscore_anomalies": lambda w: anomaly.zscore_anomalies(w.user_day),
    "moving_avg_anomalies": lambda w: anomaly.moving_avg_anomalies(w.user_day),
    "dod_attribution": lambda w: anomaly.dod_attribution(w.user_day),
    "hourly_anomalies": lambda w: anomaly.hourly_anomalies(w.behavior),
}

# --- segments -------------------------------------------------------------------------------------------


def _cohort_cost(w: Workspace) -> DataFrame:
    """Acquisition cost per first date: the mean value of that day's sign-up events."""
    return (
        w.table("events")
        .filter(F.col("event_type") == "signup")
        .groupBy(F.to_date("ts").alias("cohort_date"))
        .agg(half_up(F.avg("value"), 4).alias("cac"))
    )


SEGMENT: dict[str, Query] = {
    "rf_scores": lambda w: segments.rf_scores(w.user_day),
    "rf_scores_all": lambda w: segments.rf_scores(w.user_day, top=None),
    "rf_segment_summary": lambda w: segments.rf_segment_summary(w.user_day),
    "rf_quartiles": lambda w: segments.rf_quartiles(w.user_day),
    "lifecycle_states": lambda w: segments.lifecycle_states(w.user_day),
    "lifecycle_states_gap": lambda w: segments.lifecycle_states(w.user_day, gap_days=1),
    "mart_rfm_segments": lambda w: segments.mart_rfm_segments(
        kpi.int_user_behavior_summary(w.user_day)
    ),
    "mart_user_segments": lambda w: segments.mart_user_segments(w.behavior),
    "user_stats": lambda w: segments.user_stats(w.behavior),
    "preferred_category": lambda w: segments.preferred_category(w.behavior),
    "user_profile": lambda w: segments.user_profile(w.behavior),
    "profile_label_distribution": lambda w: segments.profile_label_distribution(
        segments.user_profile(w.behavior)
    ),
    "purchase_segments": lambda w: segments.purchase_segments(w.user_day),
    "activity_bins": lambda w: segments.activity_bins(w.user_day),
    "rfm_monetary": lambda w: segments.rfm_monetary(
        w.table("orders").select(
            F.col("o_custkey").alias("user_id"),
            F.to_date("o_orderdate").alias("date"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        )
    ),
    "ltv_estimate": lambda w: segments.ltv_estimate(w.user_day),
    "ltv_tiers": lambda w: segments.ltv_tiers(segments.ltv_estimate(w.user_day)),
    "ltv_segment_summary": lambda w: segments.ltv_segment_summary(segments.ltv_estimate(w.user_day)),
    "top_ltv_users": lambda w: segments.top_ltv_users(segments.ltv_estimate(w.user_day)),
    "cohort_ltv_cac": lambda w: segments.cohort_ltv_cac(
        segments.ltv_estimate(w.user_day), _cohort_cost(w)
    ),
}

# --- experiments ------------------------------------------------------------------------------------------


def _arms(w: Workspace) -> DataFrame:
    return experiment.daily_arms(w.user_day)


def _p_rounded(tested: DataFrame) -> DataFrame:
    return tested.withColumn("p_value", half_up("p_value", 9))


BY = ["date"]

def _experiment_by_segment(w: Workspace) -> DataFrame:
    """Readouts of everyone and of each RF segment, time period and category, with p-values adjusted for all."""
    rf = segments.rf_scores(w.user_day, top=None).select("user_id", "user_segment")
    by = {"rf_segment": "user_segment", "time_period": "time_period", "category": "category_id"}
    arms = experiment.segment_arms(w.behavior, rf, by)
    keys = ["dimension", "slice"]
    return experiment.adjusted(_p_rounded(experiment.two_proportion_z(arms, by=keys)), keys)


EXPERIMENT: dict[str, Query] = {
    "experiment_by_segment": _experiment_by_segment,
    "assign_parity": lambda w: experiment.assign_parity(w.user_day),
    "assign_hash": lambda w: experiment.assign_hash(w.user_day),
    "ab_period_summary_pre": lambda w: experiment.ab_period_summary(w.user_day, experiment.PRE),
    "ab_period_summary_post": lambda w: experiment.ab_period_summary(w.user_day, experiment.POST),
    "ab_user_diff": lambda w: experiment.ab_user_diff(w.user_day),
    "ab_user_diff_all": lambda w: experiment.ab_user_diff(w.user_day, top=None),
    "ab_group_stats": lambda w: experiment.ab_group_stats(w.user_day),
    "ab_conversion": lambda w: experiment.ab_conversion(w.user_day),
    "srm_check": lambda w: _p_rounded(experiment.srm_check(_arms(w), by=BY)),
    "two_proportion_z": lambda w: _p_rounded(experiment.two_proportion_z(_arms(w), by=BY)),
    "chi2_contingency": lambda w: _p_rounded(experiment.chi2_contingency(_arms(w), by=BY)),
    "required_sample_size": lambda w: experiment.required_sample_size(_arms(w), by=BY),
    "proportion_ci": lambda w: experiment.proportion_ci(
        experiment.daily_groups(w.user_day), by=["date", "group_label"]
    ),
    "cohens_h": lambda w: experiment.cohens_h(_arms(w), by=BY),
    "recommender_lift": lambda w: _p_rounded(experiment.recommender_lift(w.behavior)),
    "welch_t_did": lambda w: experiment.welch_t_did(experiment.ab_user_diff(w.user_day, top=None)),
    "experiment_p_values": lambda w: _p_rounded(experiment.two_proportion_z(_arms(w), by=BY)),
}

# --- products -----------------------------------------------------------------------------------------------

PRODUCT: dict[str, Query] = {
    "top_items": lambda w: product.top_items(w.behavior),
    "top_categories": lambda w: product.top_categories(w.behavior),
    "top_conversion_items": lambda w: product.top_conversion_items(w.behavior, min_pv=15),
    "long_tail_items": lambda w: product.long_tail_items(w.behavior),
    "category_efficiency": lambda w: product.category_efficiency(w.behavior),
    "co_purchase_pairs": lambda w: product.co_purchase_pairs(w.behavior),
    "co_purchase_pairs_orders": lambda w: product.co_purchase_pairs(w.purchases),
    "item_scatter": lambda w: product.item_scatter(w.behavior, n=None),
    "zero_conversion_items": lambda w: product.zero_conversion_items(w.behavior),
    "zero_conversion_over_median": lambda w: product.zero_conversion_over_median(w.behavior),
    "top_n_contribution": lambda w: product.top_n_contribution(w.behavior),
}

# --- recommenders -------------------------------------------------------------------------------------------


def _indexed(w: Workspace):
    return recommend.index_ids(recommend.implicit_ratings(w.behavior))


def _als(w: Workspace):
    def fit():
        indexed, users, items = _indexed(w)
        split = cut(recommend.split_ratings(indexed))
        train, test = split.filter("is_train"), split.filter("NOT is_train")
        return recommend.als_fit(train), test, users, items

    return w.once("als", fit)


def _als_evaluate(w: Workspace) -> DataFrame:
    model, test, _, _ = _als(w)
    return recommend.als_evaluate(model, test)


def _als_recommend(w: Workspace) -> DataFrame:
    model, _, users, items = _als(w)
    return recommend.als_recommend(model, users, items)


def _als_sinks(w: Workspace) -> DataFrame:
    """Rows and users or items of each file set the ALS job leaves, read back from the files."""
    folder = _scratch(w, "als")
    recommend.write_recommendations(_als_recommend(w), _factor_similarity(w), _als_evaluate(w), folder)
    read = w.spark.read.option("header", True)
    rows = [
        read.csv(f"{folder}/recommendations").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("keys")),
        read.csv(f"{folder}/item_similarity").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("keys")),
        w.spark.read.json(f"{folder}/metrics").agg(F.count("*").alias("n"), F.count("rmse").alias("keys")),
    ]
    named = [r.select(F.lit(x).alias("sink"), "n", "keys") for x, r in zip(("recommendations", "item_similarity", "metrics"), rows)]
    return named[0].unionByName(named[1]).unionByName(named[2])


def _factor_similarity(w: Workspace) -> DataFrame:
    model, _, _, items = _als(w)
    return recommend.item_factor_similarity(model, items)


RECOMMEND: dict[str, Query] = {
    "implicit_ratings": lambda w: recommend.implicit_ratings(w.behavior),
    "active_buyer_ratings": lambda w: recommend.active_buyer_ratings(w.behavior),
    "index_ids": lambda w: _indexed(w)[0],
    "split_ratings": lambda w: recommend.split_ratings(recommend.implicit_ratings(w.behavior)),
    "als_evaluate": _als_evaluate,
    "als_recommend": _als_recommend,
    "als_sinks": _als_sinks,
    "item_factor_similarity": _factor_similarity,
    "item_cf_similarity": lambda w: recommend.item_cf_similarity(recommend.purchases_of(w.purchases)),
    "item_cf_recommend": lambda w: recommend.item_cf_recommend(
        recommend.purchases_of(w.behavior), recommend.purchases_of(w.behavior)
    ),
    "user_similarity": lambda w: recommend.user_similarity(recommend.active_matrix(w.purchases)),
    "user_cf_recommend": lambda w: recommend.user_cf_recommend(recommend.active_matrix(w.purchases)),
    "popularity_recommend": lambda w: recommend.popularity_recommend(
        recommend.implicit_ratings(w.behavior)
    ),
    "popularity_recommend_orders": lambda w: recommend.popularity_recommend(
        recommend.implicit_ratings(w.purchases)
    ),
    "leave_one_out_eval": lambda w: recommend.leave_one_out_eval(w.purchases),
    "matrix_sparsity": lambda w: recommend.matrix_sparsity(recommend.implicit_ratings(w.purchases)),
}

# --- churn ----------------------------------------------------------------------------------------------------


def _rule_predictions(w: Workspace) -> DataFrame:
    """A fixed scoring rule, so that the metrics can be checked by value."""
    return churn.churn_features(w.behavior).select(
        "user_id",
        F.col("churn").alias("label"),
        (F.col("recency_days") / (F.col("recency_days") + F.col("active_days"))).alias("score"),
        (F.col("recency_days") > 1).cast("long").alias("predicted"),
    )


def _churn_split(w: Workspace) -> DataFrame:
    """Features and the time split, computed once for all models."""
    return w.once("churn_split", lambda: cut(churn.time_split(cut(churn.churn_features(w.behavior)))))


def _churn_users(w: Workspace) -> DataFrame:
    return _churn_split(w).select("user_id", "churn", long("is_test").alias("is_test"))


def _churn_model_metrics(w: Workspace) -> DataFrame:
    """One row per fitted model, on the users active last."""
    rows = [
        churn.classification_metrics(_scored(w, name, fit)).select(F.lit(name).alias("model"), "*")
        for name, fit in (("churn_lr", churn.fit_lr), ("churn_gbt", churn.fit_gbt))
    ]
    return rows[0].unionByName(rows[1])


def _churn_roc(w: Workspace) -> DataFrame:
    """The ROC curve of each fitted model, on the users active last."""
    curves = [
        churn.roc_points(_scored(w, name, fit)).select(F.lit(name).alias("model"), "threshold", "fpr", "tpr")
        for name, fit in (("churn_lr", churn.fit_lr), ("churn_gbt", churn.fit_gbt))
    ]
    return curves[0].unionByName(curves[1])


def _churn_model(w: Workspace, name: str, fit):
    """Held-out split and the model fitted on the rest of it."""
    split = _churn_split(w)
    return split, w.once(name, lambda: fit(split.filter("NOT is_test")))


def _scored(w: Workspace, name: str, fit) -> DataFrame:
    split, model = _churn_model(w, name, fit)
    return churn.score(model, split.filter("is_test"))


def _importance(w: Workspace) -> DataFrame:
    return churn.feature_importance(_churn_model(w, "churn_gbt", churn.fit_gbt)[1])


CHURN: dict[str, Query] = {
    "churn_features": lambda w: churn.churn_features(w.behavior),
    "churn_label_lastk": lambda w: churn.churn_label_lastk(w.behavior),
    "churn_sample": lambda w: churn.churn_sample(churn.churn_features(w.behavior), cap=100_000),
    "time_split": lambda w: churn.split_summary(_churn_split(w)),
    "time_split_users": _churn_users,
    "churn_model_metrics": _churn_model_metrics,
    "churn_lr": lambda w: _scored(w, "churn_lr", churn.fit_lr),
    "churn_gbt": lambda w: _scored(w, "churn_gbt", churn.fit_gbt),
    "churn_metrics": lambda w: churn.classification_metrics(_rule_predictions(w)),
    "churn_roc_curves": _churn_roc,
    "roc_points": lambda w: churn.roc_points(_rule_predictions(w)).select("threshold", "fpr", "tpr"),
    "feature_importance": _importance,
}

# --- quality ----------------------------------------------------------------------------------------------------


def _expectations(w: Workspace) -> DataFrame:
    ud = w.user_day
    summary = kpi.int_user_behavior_summary(ud)
    frames = {
        "stg_user_behavior": w.behavior,
        "int_user_daily_metrics": ud,
        "int_user_retention": retention.int_user_retention(ud),
        "int_conversion_funnel": funnel.int_conversion_funnel(w.behavior),
        "int_user_behavior_summary": summary,
        "mart_daily_kpi": _mart_daily_kpi(w),
        "mart_user_segments": segments.mart_user_segments(w.behavior),
        "mart_rfm_segments": segments.mart_rfm_segments(summary),
        "mart_user_retention": retention.mart_user_retention(ud),
    }
    suite = quality.default_suite(
        cleaning.START_TS, cleaning.END_TS, cleaning.START_DATE, cleaning.END_DATE
    )
    return quality.run_expectations(frames, suite)


def _reconcile(w: Workspace) -> DataFrame:
    """The headline numbers, and the events in the user-day table, against the same ones counted from
    the cleaned events."""
    b = w.behavior

    def expected(frame: DataFrame, metric: str, value: Column, tolerance: float) -> DataFrame:
        return frame.agg(value.cast("double").alias("expected")).select(
            F.lit(metric).alias("metric"), "expected", F.lit(tolerance).alias("tolerance"), F.lit("equal").alias("comparison")
        )

    rate = F.count_if(F.col("behavior_type") == "buy") * 100 / F.count_if(F.col("behavior_type") == "pv")
    days = b.select("user_id", "date").distinct()
    first = days.groupBy("user_id").agg(F.min("date").alias("first_date"))
    gap = days.join(first, "user_id").withColumn("gap", F.date_diff("date", "first_date"))
    exact = (
        expected(b, "row_count", F.count("*"), 0.0)
        .unionByName(expected(b, "pv_to_buy_pct", rate, 0.01))
        .unionByName(expected(days.groupBy("date").agg(F.count("*").alias("dau")), "dau_mean", F.avg("dau"), 0.1))
        .unionByName(expected(
            gap, "retention_d1_pct", F.count_if(F.col("gap") == 1) * 100 / F.count_if(F.col("gap") == 0), 0.01
        ))
    )
    rows = w.user_day.agg(F.sum("total_actions").cast("double").alias("actual")).select(F.lit("row_count").alias("metric"), "actual")
    return quality.reconcile_metrics(kpi.metric_rows(b, w.user_day).unionByName(rows), exact)


def _run_summary(w: Workspace) -> DataFrame:
    """The headline numbers, how many were reconciled, and on how many days the experiment's arms
    differ or are out of balance, written as a file and read back."""
    tests = _p_rounded(experiment.two_proportion_z(_arms(w), by=BY))
    srm = _p_rounded(experiment.srm_check(_arms(w), by=BY))

    def counted(frame: DataFrame, **values: Column) -> DataFrame:
        one = frame.agg(*[v.alias(k) for k, v in values.items()])
        return unpivot_row(one, [(k, F.col(k)) for k in values], ["metric", "value"])

    path = _scratch(w, f"summary-{uuid.uuid4().hex}")
    files.write_summary([
        ("headline", kpi.metric_rows(w.behavior, w.user_day).withColumnRenamed("actual", "value")),
        ("reconciliation", counted(_reconcile(w), metrics=F.count("*"), passed=F.sum("passed"))),
        ("experiment", counted(tests, days=F.count("*"), significant_days=F.count_if(F.col("p_value") < 0.05))),
        ("experiment", counted(srm, unbalanced_days=F.count_if(F.col("balanced") == 0))),
    ], path)
    return files.read_summary(w.spark, path)


QUALITY: dict[str, Query] = {
    "run_summary": _run_summary,
    "expectations": _expectations,
    "reconcile_metrics": _reconcile,
}

# --- streaming ---------------------------------------------------------------------------------------

# Longer than the events reach: the files of one folder come in any order, and none of their rows are late.
DELAY = "100 days"


def _event_files(w: Workspace) -> tuple[str, str, str]:
    """A new folder with the raw events in several files, one for a table, one for a checkpoint."""
    run = _scratch(w, f"live-{uuid.uuid4().hex}")
    w.raw.repartitionByRange("timestamp").write.parquet(f"{run}/events")
    return f"{run}/events", f"{run}/table", f"{run}/checkpoint"


def _stream_window_kpi(w: Workspace) -> DataFrame:
    events, table, checkpoint = _event_files(w)
    windows = live.user_windows(live.event_stream(w.spark, events, files_per_batch=4), delay=DELAY)
    live.run_available(live.upserts(windows, table, checkpoint))
    return live.window_kpi(live.latest(w.spark, table, ["window_start", "user_id"]))


def _stream_clean_events(w: Workspace) -> DataFrame:
    events, table, checkpoint = _event_files(w)
    cleaned = live.clean_stream(
        live.event_stream(w.spark, events, files_per_batch=4), DELAY, w.start_ts, w.end_ts
    )
    live.run_available(live.appends(cleaned, table, checkpoint))
    return w.spark.read.parquet(table)


def _stream_sessions(w: Workspace) -> DataFrame:
    events, table, checkpoint = _event_files(w)
    last = w.raw.agg(F.max("timestamp")).first()[0] or 0
    live.end_of_input(w.spark, events, last + 101 * 86400)
    found = live.sessions(live.event_stream(w.spark, events, files_per_batch=4), delay=DELAY)
    live.run_available(live.appends(found, table, checkpoint))
    return w.spark.read.parquet(table)


STREAMING: dict[str, Query] = {
    "stream_window_kpi": _stream_window_kpi,
    "stream_clean_events": _stream_clean_events,
    "stream_sessions": _stream_sessions,
}

ALL: dict[str, Query] = {
    **INGEST,
    **KPI,
    **RETENTION,
    **FUNNEL,
    **ANOMALY,
    **SEGMENT,
    **EXPERIMENT,
    **PRODUCT,
    **RECOMMEND,
    **CHURN,
    **QUALITY,
    **STREAMING,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run: Query):
        return lambda spark, folder: run(workspace(spark, folder))

    return {name: bind(run) for name, run in ALL.items()}
