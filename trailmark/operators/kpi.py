"""Daily, hourly and per-user KPI tables.

``ub`` is the cleaned event table, ``ud`` the table per user and day (``int_user_daily_metrics``).
At the user-day grain DAU is a plain row count, so most reports read ``ud`` and need no distinct.
Windows without a partition run only over frames of one row per date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    BEHAVIORS,
    all_rows,
    behavior_counts,
    by_date,
    half_up,
    long,
    nonzero,
    one_row,
    pct,
    ratio,
    sum_counts,
    unpivot_row,
)



def _buyers():
    return F.count_if(F.col("buy_count") > 0).alias("buyer_count")


# --- per user and day ---------------------------------------------------------------------------


def user_daily_summary(ub: DataFrame) -> DataFrame:
    return ub.groupBy("user_id", "date").agg(
        F.count("*").alias("total_actions"),
        *behavior_counts(),
        F.max("timestamp").alias("last_timestamp"),
    )


def int_user_daily_metrics(ub: DataFrame) -> DataFrame:
    """Counts, distinct items and categories, first and last action per user and day.

    Events are first counted per item, so the expansion for the two distinct counts works on the
    reduced rows and a user with very many events is spread over many groups.
    """
    per_item = ub.groupBy("user_id", "date", "item_id", "category_id").agg(
        F.count("*").alias("total_actions"),
        *behavior_counts(),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )
    return (
        per_item.groupBy("user_id", "date")
        .agg(
            F.sum("total_actions").alias("total_actions"),
            *sum_counts(),
            F.count_distinct("item_id").alias("unique_items"),
            F.count_distinct("category_id").alias("unique_categories"),
            F.min("first_ts").alias("first_ts"),
            F.max("last_ts").alias("last_ts"),
        )
        .withColumn(
            "conversion_rate", F.coalesce(ratio("buy_count", "pv_count"), F.lit(0.0))
        )
        .withColumn("is_purchase_day", (F.col("buy_count") > 0).cast("long"))
        .withColumn("is_cart_day", (F.col("cart_count") > 0).cast("long"))
    )


def int_user_behavior_summary(ud: DataFrame) -> DataFrame:
    """Per user over all days; distinct items are summed over days, as the modelled table does."""
    return (
        ud.groupBy("user_id")
        .agg(
            F.count("*").alias("active_days"),
            F.sum("total_actions").alias("total_actions"),
            *[F.sum(f"{b}_count").alias(f"total_{b}") for b in BEHAVIORS],
            F.sum("is_purchase_day").alias("purchase_days"),
            F.sum("is_cart_day").alias("cart_days"),
            F.sum("unique_items").alias("unique_items_touched"),
            F.min("date").alias("first_active_date"),
            F.max("date").alias("last_active_date"),
        )
        .withColumn("overall_conversion_rate", ratio("total_buy", "total_pv"))
    )


def user_first_active(ud: DataFrame) -> DataFrame:
    return ud.groupBy("user_id").agg(
        F.min("date").alias("first_date"), F.min("first_ts").alias("first_timestamp")
    )


# --- per date -----------------------------------------------------------------------------------


def daily_metrics(ud: DataFrame) -> DataFrame:
    return (
        ud.groupBy("date")
        .agg(F.count("*").alias("dau"), *sum_counts())
        .withColumn("buy_rate", ratio("buy_count", "pv_count"))
    )


def daily_metrics_pct(ud: DataFrame) -> DataFrame:
    """Daily table of the batch job: all actions, conversion in percent, 0 without views."""
    return (
        ud.groupBy("date")
        .agg(F.count("*").alias("dau"), F.sum("total_actions").alias("total_actions"), *sum_counts())
        .withColumn("conversion_rate", F.coalesce(pct("buy_count", "pv_count", 4), F.lit(0.0)))
    )


def daily_metrics_ma(daily: DataFrame, rows: int = 7) -> DataFrame:
    """Trailing mean over the last ``rows`` dates, the current one included."""
    w = by_date().rowsBetween(1 - rows, 0)
    return daily.select(
        "date",
        "dau",
        half_up(F.avg("dau").over(w), 2).alias("dau_ma"),
        "conversion_rate",
        half_up(F.avg("conversion_rate").over(w), 4).alias("conversion_rate_ma"),
    )


def daily_kpi_report(ud: DataFrame) -> DataFrame:
    return (
        ud.groupBy("date")
        .agg(F.count("*").alias("dau"), *sum_counts(), _buyers())
        .select(
            "date",
            "dau",
            *[f"{b}_count" for b in BEHAVIORS],
            ratio("buy_count", "pv_count").alias("conversion_rate"),
            ratio("pv_count", "dau", 2).alias("pv_per_user"),
            pct("buyer_count", "dau").alias("buyer_pct"),
        )
    )


def dau_trend(ud: DataFrame) -> DataFrame:
    return ud.groupBy("date").agg(F.count("*").alias("dau"))


def repurchase_trend(ud: DataFrame) -> DataFrame:
    """Buyers per date, and how many of them bought more than once that day."""
    return (
        ud.filter(F.col("buy_count") > 0)
        .groupBy("date")
        .agg(
            F.count("*").alias("total_buyers"),
            F.count_if(F.col("buy_count") >= 2).alias("repeat_buyers"),
        )
        .withColumn("repurchase_rate", pct("repeat_buyers", "total_buyers"))
    )


def kpi_change_alert(ud: DataFrame, threshold_pct: float = 20.0) -> DataFrame:
    """Day-over-day change of DAU, views, purchases and conversion, flagged above the threshold."""
    daily = daily_metrics(ud)
    parts = []
    for metric in ("dau", "pv_count", "buy_count", "buy_rate"):
        now = F.col(metric).cast("double")
        before = F.lag(now).over(by_date())
        parts.append(pct(now - before, before).alias(f"{metric}_change_pct"))
    out = daily.select("date", "dau", "pv_count", "buy_count", "buy_rate", *parts)
    hit = F.lit(False)
    for metric in ("dau", "pv_count", "buy_count", "buy_rate"):
        change = F.col(f"{metric}_change_pct")
        hit = hit | F.coalesce(F.abs(change) > threshold_pct, F.lit(False))
    return out.withColumn("alert", hit.cast("long"))


# --- items, hours, behaviours ---------------------------------------------------------------------


def item_metrics(ub: DataFrame) -> DataFrame:
    return (
        ub.groupBy("item_id", "category_id")
        .agg(*behavior_counts())
        .withColumn("conversion_rate", ratio("buy_count", "pv_count"))
    )


def hourly_distribution(ub: DataFrame) -> DataFrame:
    return (
        ub.groupBy("hour", "time_period")
        .agg(F.count("*").alias("total_actions"), *behavior_counts(("pv", "buy")))
        .select(
            long("hour").alias("hour"),
            "time_period",
            "total_actions",
            "pv_count",
            "buy_count",
            ratio("buy_count", "pv_count").alias("buy_rate"),
        )
    )


def hourly_traffic(ub: DataFrame) -> DataFrame:
    """Per date and hour; users are counted once per hour by grouping on the user first."""
    return (
        ub.groupBy("date", "hour", "user_id")
        .agg(F.count("*").alias("n"), *behavior_counts(("pv", "buy")))
        .groupBy("date", long("hour").alias("hour"))
        .agg(
            F.sum("n").alias("total_events"),
            F.count("*").alias("hourly_uv"),
            *sum_counts(("pv", "buy")),
        )
    )


def behavior_trend(ub: DataFrame) -> DataFrame:
    return ub.groupBy("date", "behavior_type").agg(F.count("*").alias("behavior_count"))


def behavior_ratio(ub: DataFrame) -> DataFrame:
    total = F.sum("behavior_count").over(Window.partitionBy("date"))
    return (
        behavior_trend(ub)
        .withColumn("total_daily", total)
        .withColumn("ratio", pct("behavior_count", "total_daily"))
    )


def behavior_type_stats(ub: DataFrame, approx: bool = False) -> DataFrame:
    """Events, users and items per behaviour.

    Rows are reduced per (behaviour, key) first, once for each key, so that a busy behaviour is spread over
    its users or items and no event is copied; with ``approx`` a sketch replaces both shuffles.
    """
    if approx:
        return ub.groupBy("behavior_type").agg(
            F.count("*").alias("total_count"),
            F.approx_count_distinct("user_id").alias("unique_users"),
            F.approx_count_distinct("item_id").alias("unique_items"),
        )
    by_user = ub.groupBy("behavior_type", "user_id").agg(F.count("*").alias("n"))
    by_user = by_user.groupBy("behavior_type").agg(
        F.sum("n").alias("total_count"), F.count("user_id").alias("unique_users")
    )
    by_item = ub.select("behavior_type", "item_id").distinct()
    by_item = by_item.groupBy("behavior_type").agg(F.count("item_id").alias("unique_items"))
    return by_user.join(by_item, "behavior_type")  # a row per behaviour on both sides


def behavior_distribution(ub: DataFrame) -> DataFrame:
    counts = ub.groupBy("behavior_type").agg(F.count("*").alias("behavior_count"))
    return counts.withColumn(
        "pct", pct("behavior_count", F.sum("behavior_count").over(all_rows()))
    )


def weekend_purchases(ub: DataFrame) -> DataFrame:
    return ub.filter((F.col("behavior_type") == "buy") & (F.col("is_weekend") == 1)).agg(
        F.count("*").alias("weekend_purchases")
    )


def hourly_activity(ub: DataFrame) -> DataFrame:
    """Events per hour, with the busiest hour marked (the earliest one on a tie)."""
    per_hour = ub.groupBy(long("hour").alias("hour")).agg(F.count("*").alias("events"))
    order = Window.orderBy(F.desc("events"), F.asc("hour"))
    return per_hour.withColumn("is_peak", (F.row_number().over(order) == 1).cast("long"))


def activity_heatmap(ub: DataFrame) -> DataFrame:
    """Events per weekday (rows) and hour (columns h0..h23), empty cells 0."""
    wide = ub.groupBy(long("day_of_week").alias("day_of_week")).pivot("hour", list(range(24))).count()
    return wide.select(
        "day_of_week", *[F.coalesce(F.col(f"`{h}`"), F.lit(0)).alias(f"h{h}") for h in range(24)]
    )


def weekend_vs_weekday(ub: DataFrame) -> DataFrame:
    return ub.groupBy(long("is_weekend").alias("is_weekend"), "behavior_type").agg(
        F.count("*").alias("events")
    )


def hourly_by_behavior(ub: DataFrame) -> DataFrame:
    return ub.groupBy(long("hour").alias("hour"), "behavior_type").agg(
        F.count("*").alias("behavior_count")
    )


def dataset_overview(ub: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, users, items, categories and dates; each distinct count groups its own column, so no event is
    copied for another."""

    def distinct(column: str) -> Column:
        if approx:
            return F.approx_count_distinct(column)
        found = ub.select(column).distinct()
        return one_row(found.agg(F.count(column).alias("n")))("n")

    ends = [F.count("*").alias("row_count"), F.min("date").alias("min_date"), F.max("date").alias("max_date")]
    names = {"users": "user_id", "items": "item_id", "categories": "category_id"}
    counts = [distinct(c).alias(n) for n, c in names.items()]
    one = ub.agg(*ends, *counts) if approx else ub.agg(*ends).select("*", *counts)
    return one.select("row_count", *names, "min_date", "max_date")


# --- slices and cards -------------------------------------------------------------------------------


def apply_filters(
    ub: DataFrame, dates=(), behaviors=(), hours: tuple[int, int] | None = None, weekend: str = "all"
) -> DataFrame:
    """Dashboard slice. An empty list leaves that column unfiltered; the date list prunes files."""
    if dates:
        ub = ub.filter(F.col("date").isin([F.lit(d).cast("date") for d in dates]))
    if behaviors:
        ub = ub.filter(F.col("behavior_type").isin(list(behaviors)))
    if hours:
        ub = ub.filter(F.col("hour").between(*hours))
    if weekend != "all":
        ub = ub.filter(F.col("is_weekend") == (1 if weekend == "weekend" else 0))
    return ub


def data_explorer(ub: DataFrame, n: int = 1000) -> DataFrame:
    """The first ``n`` rows of a slice in a fixed order."""
    key = ["timestamp", "user_id", "item_id", "category_id", "behavior_type"]
    return ub.orderBy(*key).limit(n)


def _per_user(ud: DataFrame) -> DataFrame:
    return ud.groupBy("user_id").agg(*sum_counts())


def kpi_cards(ud: DataFrame) -> DataFrame:
    """Users, views, purchases per view, and the share of buyers with two or more purchases."""
    return (
        _per_user(ud)
        .agg(
            F.count("*").alias("users"),
            F.sum("pv_count").alias("pv"),
            F.sum("buy_count").alias("buys"),
            F.count_if(F.col("buy_count") > 0).alias("buyers"),
            F.count_if(F.col("buy_count") >= 2).alias("repeat_buyers"),
        )
        .select(
            "users",
            "pv",
            pct("buys", "pv").alias("buy_rate_pct"),
            pct("repeat_buyers", "buyers").alias("repurchase_pct"),
        )
    )


def bounce_rate(ud: DataFrame) -> DataFrame:
    """Share of users who viewed and did nothing else."""
    only_views = (
        (F.col("pv_count") > 0)
        & (F.col("fav_count") == 0)
        & (F.col("cart_count") == 0)
        & (F.col("buy_count") == 0)
    )
    return (
        _per_user(ud)
        .agg(F.count("*").alias("users"), F.count_if(only_views).alias("bounced_users"))
        .withColumn("bounce_pct", pct("bounced_users", "users"))
    )


def headline_metrics(ub: DataFrame, ud: DataFrame) -> DataFrame:
    """One row with the headline numbers of the whole window."""
    daily = one_row(
        dau_trend(ud).agg(half_up(F.avg("dau"), 1).alias("dau_mean"))
    )
    items = one_row(
        ub.filter(F.col("behavior_type").isin("pv", "buy"))
        .groupBy("item_id")
        .agg(*behavior_counts(("pv", "buy")))
        .filter(F.col("pv_count") > 0)
        .agg(
            F.count("*").alias("viewed"),
            F.count_if(F.col("buy_count") == 0).alias("unsold"),
        )
    )
    # a user came back on day one if the second of their dates is the day after the first
    per_user = ud.groupBy("user_id").agg(
        F.min("date").alias("first_date"), F.collect_set("date").alias("dates"), *sum_counts()
    )
    returned = F.array_contains("dates", F.date_add("first_date", 1))
    totals = per_user.agg(
        F.count("*").alias("users"), F.count_if(returned).alias("returned"), *sum_counts()
    )
    return totals.select(
        daily("dau_mean").alias("dau_mean"),
        pct("buy_count", "pv_count").alias("pv_to_buy_pct"),
        pct("cart_count", "pv_count").alias("pv_to_cart_pct"),
        pct("buy_count", "cart_count").alias("cart_to_buy_pct"),
        pct("returned", "users").alias("retention_d1_pct"),
        items("unsold").alias("zero_conversion_items"),
        pct(items("unsold"), items("viewed")).alias("zero_conversion_item_share_pct"),
    )


# --- wide KPI mart ------------------------------------------------------------------------------------


def mart_daily_kpi(
    ud: DataFrame, retention: DataFrame, funnel: DataFrame, censored: str = "zero"
) -> DataFrame:
    """Daily KPIs with retention, funnel, day-over-day change, three-sigma flags and health score.

    ``censored="null"`` keeps retention NULL for cohorts too young to have it; by default it
    counts as 0, which is what the modelled table publishes.
    """

    def rate(value):
        return F.coalesce(value, F.lit(0.0))

    daily = (
        ud.groupBy("date")
        .agg(F.count("*").alias("dau"), F.sum("total_actions").alias("actions"), *sum_counts())
        .select(
            "date",
            "dau",
            *[f"{b}_count" for b in ("pv", "buy", "cart", "fav")],
            rate(pct("buy_count", "pv_count")).alias("purchase_conversion_rate"),
            rate(pct("cart_count", "pv_count")).alias("cart_conversion_rate"),
            rate(pct("fav_count", "pv_count")).alias("fav_conversion_rate"),
            rate(pct("buy_count", "actions")).alias("overall_conversion_rate"),
            rate(ratio("pv_count", "dau", 2)).alias("avg_pv_per_user"),
            rate(ratio("buy_count", "dau", 2)).alias("avg_buy_per_user"),
        )
    )
    fill = (lambda c: F.coalesce(F.col(c), F.lit(0.0))) if censored == "zero" else F.col
    # all three frames have one row per date
    base = (
        daily.join(
            retention.select(
                "date", "new_users", *[f"retention_d{n}_rate" for n in (1, 3, 7)]
            ),
            "date",
            "left",
        )
        .join(
            funnel.select(
                "date",
                F.col("pv_users").alias("f_pv"),
                F.col("buy_users").alias("f_buy"),
                F.col("overall_buy_rate").alias("f_rate"),
            ),
            "date",
            "left",
        )
        .select(
            *daily.columns,
            *[fill(f"retention_d{n}_rate").alias(f"retention_d{n}_rate") for n in (1, 3, 7)],
            F.coalesce("new_users", F.lit(0)).alias("new_users"),
            F.coalesce("f_pv", "pv_count").alias("funnel_pv"),
            F.coalesce("f_buy", "buy_count").alias("funnel_buy"),
            F.coalesce("f_rate", "purchase_conversion_rate").alias("funnel_buy_rate"),
        )
    )
    everything = all_rows()

    def flag(metric):
        far = F.abs(F.col(metric) - F.avg(metric).over(everything)) > 3 * F.stddev_samp(metric).over(
            everything
        )
        return F.when(far, "abnormal").otherwise("normal")

    def share(metric):
        return F.col(metric) / nonzero(F.max(metric).over(everything))

    before = F.lag("dau").over(by_date())
    score = (
        30 * share("dau")
        + 30 * share("purchase_conversion_rate")
        + 20 * share("retention_d1_rate")
        + 20 * share("new_users")
    )
    return base.select(
        *base.columns,
        (F.col("dau") - before).alias("dau_change"),
        F.coalesce(pct(F.col("dau") - before, before), F.lit(0.0)).alias("dau_change_pct"),
        half_up(
            F.col("purchase_conversion_rate") - F.lag("purchase_conversion_rate").over(by_date()), 4
        ).alias("conversion_change"),
        flag("dau").alias("dau_anomaly_flag"),
        flag("purchase_conversion_rate").alias("conversion_anomaly_flag"),
        flag("retention_d1_rate").alias("retention_anomaly_flag"),
        half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), score)), 0).alias("health_score"),
    )


def metric_rows(ub: DataFrame, ud: DataFrame) -> DataFrame:
    """The headline numbers as (metric, value) rows, for ``quality.reconcile_metrics``."""
    head = headline_metrics(ub, ud)
    return unpivot_row(
        head, [(c, F.col(c).cast("double")) for c in head.columns], ["metric", "actual"]
    )


