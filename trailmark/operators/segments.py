"""User value: RF and RFM scores, lifecycle, profiles, lifetime-value tiers.

User-level frames can have as many rows as there are users, so scores go through
``ranking.with_ntiles`` instead of a global window, and quantiles through value histograms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    BEHAVIORS,
    LTV_WEIGHTS,
    all_rows,
    behavior_counts,
    half_up,
    labelled,
    long,
    one_row,
    pct,
    ratio,
    sum_counts,
    unpivot_row,
    weighted_counts,
)
from trailmark.operators.ranking import (
    interpolated_quantiles,
    value_at,
    value_histogram,
    with_ntiles,
)

AS_OF = "2024-01-30"


def _days_to(as_of: str, column) -> F.Column:
    return long(F.datediff(F.lit(as_of).cast("date"), column))


def user_totals(ud: DataFrame) -> DataFrame:
    """Per user: actions, counts per behaviour, first and last date, active days."""
    return ud.groupBy("user_id").agg(
        F.sum("total_actions").alias("total_actions"),
        *sum_counts(),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count("*").alias("active_days"),
    )


# --- RF -----------------------------------------------------------------------------------------


def rf_base(ud: DataFrame, as_of: str = AS_OF) -> DataFrame:
    return user_totals(ud).select(
        "user_id",
        _days_to(as_of, "last_date").alias("recency_days"),
        "total_actions",
        "buy_count",
        "active_days",
    )


def _rf_scored(ud: DataFrame, as_of: str) -> DataFrame:
    tiled = with_ntiles(
        rf_base(ud, as_of),
        "user_id",
        {
            "r_tile": ("recency_days", False, 5),
            "f_score_actions": ("total_actions", False, 5),
            "f_score_buy": ("buy_count", False, 5),
        },
    )
    r, f = 6 - F.col("r_tile"), F.col("f_score_actions")
    return tiled.select(
        "user_id",
        "recency_days",
        "total_actions",
        "buy_count",
        "active_days",
        r.alias("r_score"),
        "f_score_actions",
        "f_score_buy",
        (r + f).alias("rf_score"),
        labelled(
            ((r >= 4) & (f >= 4), "high_value"),
            ((r >= 3) & (f >= 3), "active"),
            (r >= 3, "new_or_returning"),
            (f >= 3, "dormant"),
            otherwise="churn_risk",
        ).alias("user_segment"),
        labelled((F.col("buy_count") > 0, "purchased"), otherwise="not_purchased").alias(
            "purchase_status"
        ),
    )


def rf_scores(ud: DataFrame, as_of: str = AS_OF, top: int | None = 50) -> DataFrame:
    """Recency and frequency scores per user; the report shows the best ``top``, None gives all."""
    scored = _rf_scored(ud, as_of)
    if top is None:
        return scored
    return scored.orderBy(F.desc("rf_score"), F.desc("buy_count"), "user_id").limit(top)


def rfm_monetary(orders: DataFrame) -> DataFrame:
    """Recency, frequency and money of every customer's orders, each in fifths, 5 the best.

    ``orders`` is (user_id, date, amount decimal); recency counts from the last date of all orders.
    """
    latest = one_row(orders.agg(F.max("date").alias("d")))("d")
    base = orders.groupBy("user_id").agg(
        F.max("date").alias("last_date"), F.count("*").alias("order_count"), F.sum("amount").alias("total")
    ).select(
        "user_id",
        long(F.datediff(latest, "last_date")).alias("recency_days"),
        "order_count",
        F.col("total").cast("double").alias("monetary"),
    )
    tiled = with_ntiles(
        base,
        "user_id",
        {
            "r_tile": ("recency_days", False, 5),
            "f_score": ("order_count", False, 5),
            "m_score": ("monetary", False, 5),
        },
    )
    r, f, m = 6 - F.col("r_tile"), F.col("f_score"), F.col("m_score")
    return tiled.select(
        "user_id", "recency_days", "order_count", "monetary", r.alias("r_score"), "f_score", "m_score",
        (r + f + m).alias("rfm_score"),
    )


def rf_segment_summary(ud: DataFrame, as_of: str = AS_OF) -> DataFrame:
    return (
        _rf_scored(ud, as_of)
        .groupBy("user_segment")
        .agg(
            F.count("*").alias("user_count"),
            half_up(F.avg("recency_days"), 2).alias("avg_recency_days"),
            half_up(F.avg("total_actions"), 2).alias("avg_actions"),
            half_up(F.avg("buy_count"), 2).alias("avg_buy_count"),
            half_up(F.avg("active_days"), 2).alias("avg_active_days"),
            F.sum("buy_count").alias("total_buy_count"),
        )
        .withColumn("pct_of_total", pct("user_count", F.sum("user_count").over(all_rows())))
        .withColumn(
            "buy_contribution_pct", pct("total_buy_count", F.sum("total_buy_count").over(all_rows()))
        )
    )


def rf_quartiles(ud: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Min, mean, max and positional quartiles of recency, actions and purchases."""
    hist = value_histogram(rf_base(ud, as_of), ["recency_days", "total_actions", "buy_count"])

    def quarter(k):
        return value_at(F.floor(F.col("n") * k / 4))

    return hist.groupBy("metric").agg(
        F.min("value").alias("min_val"),
        half_up(F.sum(F.col("value") * F.col("rows")) / F.sum("rows"), 2).alias("avg_val"),
        F.max("value").alias("max_val"),
        quarter(1).alias("q1"),
        quarter(2).alias("median"),
        quarter(3).alias("q3"),
    )


def lifecycle_states(ud: DataFrame, gap_days: int | None = None) -> DataFrame:
    """First, last and continuing activity over each user's dates.

    With ``gap_days`` a date after a longer pause counts as returning; without it the pause is not
    looked at, as in the published report.
    """
    user = Window.partitionBy("user_id").orderBy("date")
    days = ud.select(
        "user_id",
        "total_actions",
        "buy_count",
        F.lag("date").over(user).alias("before"),
        F.lead("date").over(user).alias("after"),
        "date",
    )
    steps = [(F.col("before").isNull(), "first_active")]
    if gap_days is not None:
        steps.append((F.datediff("date", "before") > gap_days, "returning"))
    steps.append((F.col("after").isNull(), "last_active"))
    return days.groupBy(labelled(*steps, otherwise="continuing").alias("lifecycle_status")).agg(
        F.count("*").alias("occurrence_count"),
        half_up(F.avg("total_actions"), 2).alias("avg_daily_actions"),
        F.sum("buy_count").alias("total_daily_buy"),
    )


# --- RFM ----------------------------------------------------------------------------------------


_RFM_TILES = {
    "r_tile": ("recency", False, 5),
    "f_tile": ("frequency", True, 5),
    "m_tile": ("monetary", True, 5),
}


def _rfm_scores(tiled: DataFrame) -> DataFrame:
    return tiled.select(
        *[c for c in tiled.columns if not c.endswith("_tile")],
        *[(6 - F.col(f"{x}_tile")).alias(f"{x}_score") for x in "rfm"],
    )


def mart_rfm_segments(summary: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """RFM from the per-user summary: frequency is active days, monetary the purchase count."""
    base = summary.select(
        "user_id",
        _days_to(as_of, "last_active_date").alias("recency"),
        F.col("active_days").alias("frequency"),
        F.col("total_buy").alias("monetary"),
    )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    return _rfm_scores(with_ntiles(base, "user_id", _RFM_TILES)).select(
        "user_id",
        F.col("recency").alias("recency_days"),
        "frequency",
        "monetary",
        "r_score",
        "f_score",
        "m_score",
        (r * 100 + f * 10 + m).alias("rfm_score"),
        labelled(
            ((r >= 4) & (f >= 4) & (m >= 4), "high_value"),
            ((r >= 3) & (f >= 3), "potential"),
            ((r >= 4) & (f <= 2), "new"),
            ((r <= 2) & (f >= 3), "churn_warning"),
            ((r <= 2) & (f <= 2), "dormant"),
            otherwise="general",
        ).alias("segment_label"),
    )


def user_stats(ub: DataFrame) -> DataFrame:
    """Per user: counts, last and first date, true distinct items and categories.

    Events are counted per (user, item, category, date) first, so a very active user is spread
    over many groups before the distinct counts.
    """
    per_item = ub.groupBy("user_id", "item_id", "category_id", "date").agg(
        F.count("*").alias("total_actions"), *behavior_counts()
    )
    return per_item.groupBy("user_id").agg(
        F.sum("total_actions").alias("total_actions"),
        *sum_counts(),
        F.min("date").alias("first_active_date"),
        F.max("date").alias("last_active_date"),
        F.count_distinct("item_id").alias("unique_items"),
        F.count_distinct("category_id").alias("unique_categories"),
        F.count_distinct("date").alias("active_days"),
    )


def mart_user_segments(
    ub: DataFrame, as_of: str = AS_OF, new_since: str = "2024-01-04"
) -> DataFrame:
    """The wide user table: RFM scores and segment, value tier, activity, behaviour tag, stage."""
    base = user_stats(ub).select(
        "user_id",
        _days_to(as_of, "last_active_date").alias("recency"),
        F.col("active_days").alias("frequency"),
        F.col("buy_count").alias("monetary"),
        "first_active_date",
        "last_active_date",
        "pv_count",
        "cart_count",
        "fav_count",
        "unique_items",
        "unique_categories",
    )
    scored = _rfm_scores(with_ntiles(base, "user_id", _RFM_TILES))
    r, f, m = (F.col(f"{x}_score") >= 4 for x in "rfm")
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    bought, carted, faved = (F.col(c) > 0 for c in ("monetary", "cart_count", "fav_count"))
    return scored.select(
        *scored.columns,
        labelled(
            (r & f & m, "champion"),
            (r & f, "develop"),
            (r & m, "keep"),
            (r, "retain"),
            (f & m, "general_value"),
            (f, "general_develop"),
            (m, "general_keep"),
            otherwise="churn_risk",
        ).alias("rfm_segment"),
        labelled((total >= 13, "high"), (total >= 9, "mid"), otherwise="low").alias("value_tier"),
        labelled(
            (F.col("recency") == 0, "today"),
            (F.col("recency") <= 2, "recent"),
            (F.col("recency") <= 5, "normal"),
            otherwise="dormant",
        ).alias("activity_label"),
        labelled(
            (bought & carted & faved, "full_path"),
            (bought & carted, "cart_buyer"),
            (bought & faved, "fav_buyer"),
            (bought, "direct_buyer"),
            (carted | faved, "intent"),
            otherwise="browser",
        ).alias("behavior_tag"),
        labelled(
            (F.col("first_active_date") >= F.lit(new_since).cast("date"), "new"),
            (bought & (F.col("frequency") >= 5), "mature"),
            (bought, "growing"),
            (F.col("frequency") >= 3, "active"),
            otherwise="potential",
        ).alias("lifecycle_stage"),
        F.coalesce(pct("monetary", "pv_count"), F.lit(0.0)).alias("personal_conversion_rate"),
    )


# --- profile --------------------------------------------------------------------------------------


def preferred_category(ub: DataFrame) -> DataFrame:
    """The category each user viewed most (lowest id on a tie), as an aggregate, without a window."""
    views = (
        ub.filter(F.col("behavior_type") == "pv")
        .groupBy("user_id", "category_id")
        .agg(F.count("*").alias("views"))
    )
    best = F.max(F.struct(F.col("views"), (-F.col("category_id")).alias("neg_id")))
    return views.groupBy("user_id").agg(best.alias("b")).select(
        "user_id",
        (-F.col("b.neg_id")).alias("preferred_category"),
        F.col("b.views").alias("preferred_category_pv"),
    )


def user_profile(ub: DataFrame, high_decile: int = 8) -> DataFrame:
    """User table with preferred category, deciles, activity label and conversion."""
    latest = one_row(ub.agg(F.max("date").alias("d")))("d")
    stats = user_stats(ub).withColumn(
        "recency_days", long(F.datediff(latest, "last_active_date"))
    )
    base = stats.drop("active_days", "first_active_date").join(preferred_category(ub), "user_id", "left")
    tiled = with_ntiles(
        base,
        "user_id",
        {
            "action_decile": ("total_actions", False, 10),
            "recency_decile": ("recency_days", False, 10),
        },
    )
    a, rec = F.col("action_decile"), F.col("recency_days")
    return tiled.select(
        *tiled.columns,
        labelled(
            ((a >= high_decile) & (F.col("buy_count") > 0) & (rec <= 3), "high"),
            ((a >= 5) & (rec <= 7), "normal"),
            ((rec > 7) & (rec <= 30), "dormant"),
            ((rec > 30) | ((a <= 2) & (rec > 7)), "churned"),
            otherwise="normal",
        ).alias("user_label"),
        F.coalesce(ratio("buy_count", "pv_count"), F.lit(0.0)).alias("buy_conversion_rate"),
    )


def profile_label_distribution(profile: DataFrame) -> DataFrame:
    return profile.groupBy("user_label").agg(F.count("*").alias("user_count"))


def _binned(ud: DataFrame, column: str, bins: list[tuple[str, int, int | None]]) -> DataFrame:
    """Users per bin of a per-user total; bins are (label, low, high), empty bins stay with 0."""
    per_user = ud.groupBy("user_id").agg(F.sum(column).alias("v"))

    def inside(low, high):
        cond = F.col("v") >= low
        return cond if high is None else cond & (F.col("v") <= high)

    one = per_user.agg(
        F.count("*").alias("n"),
        *[F.count_if(inside(lo, hi)).alias(f"b{i}") for i, (_, lo, hi) in enumerate(bins)],
    )
    rows = [(i + 1, label, F.col(f"b{i}"), pct(f"b{i}", "n")) for i, (label, _, _) in enumerate(bins)]
    out = unpivot_row(one, rows, ["bin_no", "bin", "user_count", "user_pct"])
    return out.withColumn("bin_no", long("bin_no"))


def purchase_segments(ud: DataFrame) -> DataFrame:
    bins = [("none", 0, 0), ("1", 1, 1), ("2-3", 2, 3), ("4-10", 4, 10), (">10", 11, None)]
    return _binned(ud, "buy_count", bins)


def activity_bins(ud: DataFrame) -> DataFrame:
    bins = [("0-10", 0, 10), ("11-50", 11, 50), ("51-100", 51, 100), ("101-500", 101, 500), (">500", 501, None)]
    return _binned(ud, "total_actions", bins)


# --- lifetime value ---------------------------------------------------------------------------------


def ltv_estimate(ud: DataFrame, weights=None, forecast_days: int = 30) -> DataFrame:
    """Weighted behaviour value per user, extrapolated from the days in ``ud`` to ``forecast_days``."""
    days = one_row(ud.agg(F.count_distinct("date").alias("n")))("n")
    latest = one_row(ud.agg(F.max("date").alias("d")))("d")
    value = weighted_counts(weights or LTV_WEIGHTS)
    return user_totals(ud).select(
        "user_id",
        "first_date",
        "active_days",
        *[f"{b}_count" for b in BEHAVIORS],
        value.alias("value_score"),
        (value * (F.lit(float(forecast_days)) / days)).alias("ltv_estimate"),
        long(F.datediff(latest, "last_date")).alias("recency_days"),
        long(F.datediff("last_date", "first_date") + 1).alias("lifespan_days"),
        ratio("buy_count", "total_actions").alias("buy_conversion"),
    )


_TIERS = ("bottom_20", "20_40", "40_60", "60_80", "top_20")


def _tier(ltv: DataFrame, closed: str) -> DataFrame:
    """Five quantile tiers; ``closed`` says to which side an edge value belongs."""
    edge = one_row(interpolated_quantiles(ltv, "ltv_estimate", [0.2, 0.4, 0.6, 0.8]))
    v = F.col("ltv_estimate")
    if closed == "right":
        steps = [(v <= edge(f"q{i}"), _TIERS[i]) for i in range(4)]
    else:
        steps = [(v < edge(f"q{i}"), _TIERS[i]) for i in range(4)]
    return ltv.withColumn("tier", labelled(*steps, otherwise=_TIERS[4]))


def ltv_tiers(ltv: DataFrame, closed: str = "right") -> DataFrame:
    """Share of the total value held by each tier of users with any value."""
    tiers = _tier(ltv.filter(F.col("ltv_estimate") > 0), closed)
    return (
        tiers.groupBy("tier")
        .agg(F.count("*").alias("user_count"), F.sum("ltv_estimate").alias("total_ltv"))
        .withColumn("contribution_pct", pct("total_ltv", F.sum("total_ltv").over(all_rows())))
    )


def ltv_segment_summary(ltv: DataFrame) -> DataFrame:
    return (
        _tier(ltv, "left")
        .groupBy(F.col("tier").alias("ltv_segment"))
        .agg(
            F.count("*").alias("user_count"),
            half_up(F.avg("buy_count"), 4).alias("avg_buy_count"),
            half_up(F.avg("active_days"), 4).alias("avg_active_days"),
            half_up(F.avg("value_score"), 4).alias("avg_behavior_value"),
            half_up(F.avg("ltv_estimate"), 4).alias("avg_ltv"),
            F.sum("ltv_estimate").alias("total_ltv"),
        )
        .withColumn("user_pct", pct("user_count", F.sum("user_count").over(all_rows())))
        .withColumn("ltv_pct", pct("total_ltv", F.sum("total_ltv").over(all_rows())))
    )


def top_ltv_users(ltv: DataFrame, n: int = 10) -> DataFrame:
    return (
        ltv.orderBy(F.desc("value_score"), "user_id")
        .limit(n)
        .select("user_id", "buy_count", "active_days", "value_score", "recency_days")
    )


def cohort_ltv_cac(ltv: DataFrame, cac: DataFrame) -> DataFrame:
    """Value per first-date cohort against its acquisition cost; ``cac`` is (cohort_date, cac)."""
    cohorts = ltv.groupBy(F.col("first_date").alias("cohort_date")).agg(
        F.count("*").alias("user_count"),
        F.avg("ltv_estimate").alias("mean_ltv"),
        F.sum("ltv_estimate").alias("total_ltv"),
        half_up(F.avg("buy_count"), 4).alias("avg_buys"),
    )
    x = ratio("mean_ltv", "cac", None)
    return cohorts.join(cac, "cohort_date", "left").select(
        "cohort_date",
        "user_count",
        half_up("mean_ltv", 4).alias("avg_ltv"),
        "total_ltv",
        "avg_buys",
        "cac",
        half_up(x, 4).alias("ltv_cac_ratio"),
        F.when(x.isNotNull(), labelled((x >= 3, "healthy"), (x >= 1, "fair"), otherwise="poor")).alias(
            "health"
        ),
    )
