"""Operators on the hand-made frame with hand-computed answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import RAW, WINDOW
from trailmark.operators import (
    anomaly,
    churn,
    cleaning,
    experiment,
    funnel,
    kpi,
    product,
    recommend,
    retention,
    segments,
)


def d(day):
    return datetime.date(2024, 1, day)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_clean_and_report(raw, ub):
    assert ub.count() == 11
    report = by(cleaning.cleaning_report(raw, *WINDOW), "step")
    assert {k: r["row_count"] for k, r in report.items()} == {
        "input": 15, "null_id": 1, "ts_range": 1, "behavior": 1, "duplicate": 1, "kept": 11,
    }
    assert report["kept"]["pct_of_input"] == 73.33


def test_schema_check_and_nulls(raw):
    assert cleaning.schema_check(raw) is raw
    with pytest.raises(ValueError, match="timestamp"):
        cleaning.schema_check(raw.drop("timestamp"))
    nulls = {r["column_name"]: r["null_count"] for r in cleaning.null_profile(raw).collect()}
    assert nulls == {"user_id": 1, "item_id": 0, "category_id": 0, "behavior_type": 0, "timestamp": 0}


def test_time_features_boundaries(spark):
    base = 1704067200
    hours = [0, 5, 6, 11, 12, 13, 14, 17, 18, 21, 22, 23]
    df = spark.createDataFrame([(1, 1, 1, "pv", base + h * 3600) for h in hours], RAW)
    got = {r["hour"]: r["time_period"] for r in cleaning.time_features(df).collect()}
    assert got == {
        0: "dawn", 5: "dawn", 6: "morning", 11: "morning", 12: "noon", 13: "noon", 14: "afternoon",
        17: "afternoon", 18: "evening", 21: "evening", 22: "night", 23: "night",
    }
    sunday = cleaning.time_features(spark.createDataFrame([(3, 12, 1, "pv", 1704614400)], RAW)).first()
    assert (sunday["day_of_week"], sunday["is_weekend"], sunday["date"]) == (6, 1, d(7))
    shifted = cleaning.time_features(
        spark.createDataFrame([(1, 1, 1, "pv", base + 20 * 3600)], RAW), tz="Asia/Shanghai"
    ).first()
    assert (shifted["date"], shifted["hour"]) == (d(2), 4)


def test_time_features_ignore_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = cleaning.time_features(
            spark.createDataFrame([(1, 1, 1, "pv", 1704067200)], RAW)
        ).first()
        assert (row["date"], row["hour"]) == (d(1), 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_daily_metrics(ud):
    got = by(kpi.daily_metrics(ud), "date")
    assert tuple(got[d(1)])[1:] == (2, 2, 0, 1, 1, 0.5)
    assert tuple(got[d(2)])[1:] == (4, 2, 1, 1, 1, 0.5)
    assert tuple(got[d(4)])[1:] == (1, 0, 0, 0, 1, None)
    assert tuple(got[d(7)])[1:] == (1, 1, 0, 0, 0, 0.0)


def test_retention(ud):
    got = by(retention.retention_dn(ud), "date")
    assert [got[d(1)][c] for c in ("new_users", "retained_d1", "retained_d3", "retained_d7")] == [2, 2, 1, 0]
    assert [got[d(2)][c] for c in ("new_users", "retained_d1", "retained_d3")] == [2, 0, 0]
    nulls = by(retention.int_user_retention(ud), "date")
    assert nulls[d(2)]["retained_d1"] is None and nulls[d(1)]["retention_d1_rate"] == 100.0
    matrix = by(retention.retention_matrix(ud), "cohort_date")
    assert matrix[d(2)]["d5_users"] == 1


def test_funnels(ub, ud):
    users = {r["stage"]: r["user_count"] for r in funnel.user_funnel(ud).collect()}
    assert users == {"pv": 3, "fav": 1, "cart": 2, "buy": 2}
    same = {r["stage"]: r["user_count"] for r in funnel.user_funnel(ub).collect()}
    assert same == users
    paths = {r["conversion_path"]: r["user_count"] for r in funnel.conversion_paths(ud).collect()}
    assert paths == {"pv->buy direct": 1, "pv->cart->buy": 1, "no purchase": 1}


def test_pairs_similarity_ltv(ub, ud):
    pair = product.co_purchase_pairs(ub).collect()
    assert [(r["item_a"], r["item_b"], r["co_buy_count"], r["pair_rank"]) for r in pair] == [(11, 12, 1, 1)]
    sim = by(recommend.item_cf_similarity(recommend.purchases_of(ub)), "item_id", "similar_item")
    assert {k: r["similarity"] for k, r in sim.items()} == {(11, 12): 0.707106781, (12, 11): 0.707106781}
    value = {r["user_id"]: r["value_score"] for r in segments.ltv_estimate(ud).collect()}
    assert value == {1: 22, 2: 16, 3: 5, 4: 5}


def test_item_cf_recommends_only_new_items(ub):
    buys = recommend.purchases_of(ub)
    got = [tuple(r) for r in recommend.item_cf_recommend(buys, buys).select("user_id", "item_id").collect()]
    assert got == [(2, 12)]


def test_products(ub):
    top = product.top_items(ub).collect()
    assert [(r["item_id"], r["buy_count"], r["buyer_count"], r["buy_rank"]) for r in top][:2] == [
        (11, 2, 2, 1), (12, 1, 1, 2),
    ]
    zero = product.zero_conversion_items(ub).first()
    assert (zero["viewed_items"], zero["zero_conversion_items"]) == (2, 0)
    share = product.top_n_contribution(ub, n=1).first()
    assert (share["top_buys"], share["all_buys"], share["share_pct"]) == (2, 3, 66.67)


def test_headline_cards_bounce(ub, ud):
    head = kpi.headline_metrics(ub, ud).first()
    assert head["dau_mean"] == 2.0 and head["pv_to_buy_pct"] == 60.0 and head["retention_d1_pct"] == 50.0
    cards = kpi.kpi_cards(ud).first()
    assert (cards["users"], cards["pv"], cards["repurchase_pct"]) == (4, 5, 50.0)
    assert kpi.bounce_rate(ud).first()["bounced_users"] == 0


def test_filters(ub):
    assert kpi.apply_filters(ub).count() == 11
    assert kpi.apply_filters(ub, dates=["2024-01-07"]).count() == 1
    assert kpi.apply_filters(ub, weekend="weekend").count() == 1
    assert kpi.apply_filters(ub, behaviors=["buy"], hours=(9, 10)).count() == 1
    assert kpi.data_explorer(ub, 3).count() == 3


def test_lifecycle_gap(ud):
    plain = {r["lifecycle_status"]: r["occurrence_count"] for r in segments.lifecycle_states(ud).collect()}
    assert plain == {"first_active": 4, "continuing": 1, "last_active": 3}
    gap = {r["lifecycle_status"]: r["occurrence_count"] for r in segments.lifecycle_states(ud, gap_days=1).collect()}
    assert gap == {"first_active": 4, "continuing": 1, "last_active": 1, "returning": 2}


def test_bins_keep_empty_labels(ud):
    got = {r["bin"]: r["user_count"] for r in segments.purchase_segments(ud).collect()}
    assert got == {"none": 2, "1": 1, "2-3": 1, "4-10": 0, ">10": 0}


def test_preferred_category_tie(spark):
    df = spark.createDataFrame([(1, 1, 7, "pv", 1), (1, 2, 5, "pv", 2)], RAW)
    assert segments.preferred_category(df).first()["preferred_category"] == 5


def test_churn_label(ub):
    got = by(churn.churn_features(ub, "2024-01-02", "2024-01-07"), "user_id")
    assert {u: r["churn"] for u, r in got.items()} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert got[1]["active_hours"] == 3 and got[1]["active_days"] == 2


def test_hash_groups(spark):
    users = spark.createDataFrame([(i,) for i in range(1, 9)], "user_id long")
    got = {r["user_id"]: r["group_label"][0].upper() for r in experiment.assign_hash(users).collect()}
    assert "".join(got[i] for i in range(1, 9)) == "TCCTTTCC"


def test_moving_average_needs_three_days(ud):
    flags = [r["anomaly_flag"] for r in anomaly.moving_avg_anomalies(ud).orderBy("date").collect()]
    assert flags[:3] == ["insufficient"] * 3


def test_empty_input(ub, ud):
    none, no_days = ub.filter(F.lit(False)), ud.filter(F.lit(False))
    assert kpi.daily_metrics(no_days).count() == 0
    assert retention.retention_dn(no_days).count() == 0
    assert funnel.user_funnel(no_days).count() == 4
    assert segments.rf_scores(no_days).count() == 0
    assert product.co_purchase_pairs(none).count() == 0
    assert recommend.item_cf_recommend(*[recommend.purchases_of(none)] * 2).count() == 0
    assert churn.churn_features(none).count() == 0


def test_buy_without_views(spark):
    df = cleaning.time_features(spark.createDataFrame([(1, 1, 1, "buy", 1704099600)], RAW))
    ud = kpi.int_user_daily_metrics(df)
    assert kpi.daily_metrics(ud).first()["buy_rate"] is None
    assert ud.first()["conversion_rate"] == 0.0
    assert [r["conversion_rate"] for r in funnel.user_funnel(ud).collect()][1:] == [None] * 3
