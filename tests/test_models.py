"""Models, sources and quality checks."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import RAW
from trailmark.operators import churn, cleaning, quality, recommend
from trailmark.plans import registry
from trailmark.sources import files
from trailmark.sources.tables import workspace

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def w(spark):
    return workspace(spark, SF)


def test_als(spark, w):
    ratings = recommend.implicit_ratings(w.behavior)
    indexed, users, items = recommend.index_ids(ratings)
    assert indexed.count() == ratings.count()
    ids = sorted(r["user_idx"] for r in users.collect())
    assert ids == list(range(len(ids)))
    split = recommend.split_ratings(indexed)
    again = recommend.split_ratings(indexed.repartition(3))
    key = ["user_id", "item_id", "is_train"]
    assert sorted(map(tuple, split.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))
    model = recommend.als_fit(split.filter("is_train"), maxIter=2)
    metrics = recommend.als_evaluate(model, split.filter("NOT is_train")).first()
    assert metrics["test_pairs"] > 0 and 0 <= metrics["mae"] <= metrics["rmse"]
    recs = recommend.als_recommend(model, users, items, n=3)
    per_user = recs.groupBy("user_id").count().collect()
    assert len(per_user) == len(ids) and all(r["count"] == 3 for r in per_user)
    one = recommend.recommendations_for(recs, per_user[0]["user_id"]).collect()
    assert [r["rank_no"] for r in one] == [1, 2, 3] and one[0]["score"] >= one[2]["score"]


def test_write_recommendations(spark, tmp_path):
    recs = spark.createDataFrame([(1, 2, 0.5, 1)], "user_id long, item_id long, score double, rank_no long")
    metrics = spark.createDataFrame([(0.1,)], "rmse double")
    recommend.write_recommendations(recs, recs, metrics, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/recommendations").count() == 1
    assert spark.read.json(f"{tmp_path}/metrics").first()["rmse"] == 0.1


def test_churn_models_beat_a_constant(spark):
    rows = []
    for i in range(200):
        gone = i % 4 == 0
        rows.append((i, 5, 1, 1, 1, 4, 4, 9.0 if gone else 1.0 + i % 3, 0.2, 0.1, 0.1, 0.1, int(gone)))
    cols = ["user_id", *churn.FEATURES]
    kinds = ["long"] + ["double" if c in ("recency_days", "weekend_ratio") or c.endswith("conversion") else "long" for c in churn.FEATURES]
    schema = ", ".join(f"{c} {k}" for c, k in zip(cols, kinds)) + ", churn long"
    df = spark.createDataFrame(rows, schema)
    for model in (churn.fit_lr(df, 20), churn.fit_gbt(df, trees=3, depth=2)):
        got = churn.classification_metrics(churn.score(model, df)).first()
        assert got["auc"] == 1.0 and got["f1"] == 1.0
    top = churn.feature_importance(model).first()
    assert top["feature"] == "recency_days"


def test_metrics_match_hand_count(spark):
    pred = spark.createDataFrame(
        [(1, 0.9, 1), (0, 0.8, 1), (1, 0.7, 1), (1, 0.4, 0), (0, 0.4, 0), (0, 0.1, 0)],
        "label long, score double, predicted long",
    )
    got = churn.classification_metrics(pred).first()
    # pairs: 9, won 3 + 2 + 1 (0.4 beats 0.1) + 0.5 tie = 6.5
    assert got["auc"] == pytest.approx(6.5 / 9, abs=1e-6)
    assert got["accuracy"] == pytest.approx(4 / 6, abs=1e-6)
    assert got["precision"] == pytest.approx(2 / 3, abs=1e-6)


def test_splits(spark):
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int") % 10)
    df = spark.range(1000).select(
        F.col("id").alias("user_id"), day.alias("last_date"), (F.col("id") % 2).alias("churn")
    )
    split = churn.time_split(df)
    assert split.filter("is_test").count() == 200
    one_day = df.withColumn("last_date", F.lit("2024-01-05").cast("date"))
    assert churn.time_split(one_day).filter("is_test").count() == 200
    share = churn.stratified_split(df).filter("is_test").groupBy("churn").count().collect()
    assert all(60 < r["count"] < 140 for r in share)
    assert churn.churn_sample(df, cap=100).count() == 100
    assert churn.churn_sample(df).count() == 1000


def test_csv_source(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.csv").write_text("1,2,3,pv,1704099600\nx,2,3,buy,1704099601\n5,6,7,fav,oops\n9999999999,1,1,pv,1704099600\n")
    df = files.read_behavior_csv(spark, str(tmp_path / "absent"), fallback=str(path))
    rows = sorted(map(tuple, df.collect()), key=str)
    assert (9999999999, 1, 1, "pv", 1704099600) in rows and (None, 2, 3, "buy", 1704099601) in rows
    bad = files.read_behavior_csv(spark, str(path), keep_corrupt=True).cache()
    assert bad.filter(F.col(files.CORRUPT).isNotNull()).count() == 2


def test_sinks(spark, ub, tmp_path):
    path = f"{tmp_path}/clean"
    files.write_clean(ub, path)
    assert files.read_back_matches(spark, ub, path)
    back = files.read_clean(spark, path)
    assert back.schema.simpleString() == ub.select(*back.columns).schema.simpleString()
    plan = back.filter(F.col("date") == F.lit("2024-01-07").cast("date"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    files.write_clean(ub, f"{tmp_path}/csv", fmt="csv")
    assert files.read_clean_csv(spark, f"{tmp_path}/csv").count() == 11
    files.write_report(ub.groupBy("date").count(), f"{tmp_path}/report")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report").count() == 4
    files.export_csv(ub, f"{tmp_path}/export")
    assert spark.read.option("header", True).csv(f"{tmp_path}/export").count() == 11


def test_validate(spark, ub):
    assert quality.validate_dataset(ub, start="2024-01-01", end="2024-01-07").count() == 0
    few = quality.validate_dataset(spark.createDataFrame([(1, 2), (3, 4)], "user_id long, item_id long"))
    assert {r["check"] for r in few.collect()} == {"missing columns"}
    one = cleaning.time_features(spark.createDataFrame([(1, 1, 1, "click", 1704099600)], RAW))
    assert {r["check"] for r in quality.validate_dataset(one).collect()} == {"unknown behaviour"}
    assert "empty" in {r["check"] for r in quality.validate_dataset(ub.filter(F.lit(False))).collect()}


def test_expectations_find_violations(spark):
    rows = spark.createDataFrame([(1, -1), (1, 5), (None, 500)], "user_id long, rate long")
    suite = [
        quality.not_null("t", "user_id"),
        quality.unique("t", ["user_id"]),
        quality.non_negative("t", ["rate"]),
        quality.bounded("t", ["rate"], 100),
        quality.accepted_values("t", "rate", (5, 500)),
    ]
    got = {r["check_name"]: r["violations"] for r in quality.run_expectations({"t": rows}, suite).collect()}
    assert got == {
        "not_null_user_id": 1, "unique_user_id": 1, "non_negative": 1, "bounded_rate": 1, "accepted_values_rate": 1,
    }
    up = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 2.0)], "f_score long, frequency double")
    check = [quality.score_direction("s")]
    assert quality.run_expectations({"s": up}, check).first()["violations"] == 1


def test_suite_passes_except_warnings(spark, w):
    got = registry.QUALITY["expectations"](w).collect()
    assert all(r["violations"] == 0 for r in got if r["severity"] == "error" and "direction" not in r["check_name"])


def test_reconcile_query_sees_differences(w):
    got = {r["metric"]: r for r in registry.QUALITY["reconcile_metrics"](w).collect()}
    assert set(got) == {"row_count", "pv_to_buy_pct", "dau_mean", "retention_d1_pct"}
    assert all(r["passed"] == 1 and r["comparison"] == "equal" for r in got.values())
    assert got["row_count"]["expected"] == w.behavior.count()


def test_run_summary(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "metric string, value long")
    files.write_summary([("one", rows), ("two", rows.limit(0)), ("three", rows.withColumn("more", F.lit(1)))], str(tmp_path / "s"))
    got = {(r["section"], r["metric"], r["value"]) for r in files.read_summary(spark, str(tmp_path / "s")).collect()}
    assert got == {("one", "a", 1.0), ("one", "b", None), ("three", "a", 1.0), ("three", "b", None)}


def test_reconcile(spark):
    actual = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "metric string, actual double")
    expected = spark.createDataFrame(
        [("a", 1.05, 0.1, "equal"), ("b", 3.0, 0.0, "above"), ("c", 0.0, 0.0, "equal")],
        "metric string, expected double, tolerance double, comparison string",
    )
    got = {r["metric"]: r["passed"] for r in quality.reconcile_metrics(actual, expected).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}
