"""Conversion funnels. One pass per grain; stages come from flags, rows from an unpivot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    BEHAVIORS,
    behavior_counts,
    half_up,
    labelled,
    long,
    pct,
    sum_counts,
    unpivot_row,
)

# Keys of one funnel subject per grain.
GRAINS = {
    "user": ("user_id",),
    "user_date": ("user_id", "date"),
    "user_item": ("user_id", "item_id"),
}


def stage_flags(df: DataFrame, keys) -> DataFrame:
    """0/1 per stage for each key, from raw events or from an already counted frame."""
    counted = "behavior_type" not in df.columns
    counts = sum_counts() if counted else behavior_counts()
    return df.groupBy(*keys).agg(*counts).select(
        *keys, *[long(F.col(f"{b}_count") > 0).alias(f"has_{b}") for b in BEHAVIORS]
    )


def _has(*on, without=()):
    cond = F.lit(True)
    for b in on:
        cond = cond & (F.col(f"has_{b}") == 1)
    for b in without:
        cond = cond & (F.col(f"has_{b}") == 0)
    return cond


def user_funnel(df: DataFrame, grain: str = "user") -> DataFrame:
    """Subjects that ever reached each stage, and percent of those with a view."""
    one = stage_flags(df, GRAINS[grain]).agg(*[F.sum(f"has_{b}").alias(b) for b in BEHAVIORS])
    rows = [
        ("pv", F.col("pv"), F.lit(100.0), "all traffic"),
        ("fav", F.col("fav"), pct("fav", "pv"), "view to favourite"),
        ("cart", F.col("cart"), pct("cart", "pv"), "view to cart"),
        ("buy", F.col("buy"), pct("buy", "pv"), "view to purchase"),
    ]
    return unpivot_row(one, rows, ["stage", "user_count", "conversion_rate", "description"])


def event_pair_conversion(df: DataFrame, grain: str = "user") -> DataFrame:
    steps = [
        ("pv->fav", _has("pv", "fav"), "pv"),
        ("pv->cart", _has("pv", "cart"), "pv"),
        ("fav->buy", _has("fav", "buy"), "fav"),
        ("cart->buy", _has("cart", "buy"), "cart"),
        ("pv->buy direct", _has("pv", "buy", without=("fav", "cart")), "pv"),
    ]
    one = stage_flags(df, GRAINS[grain]).agg(
        *[F.count_if(cond).alias(f"c{i}") for i, (_, cond, _) in enumerate(steps)],
        *[F.sum(f"has_{b}").alias(b) for b in BEHAVIORS],
    )
    rows = [
        (name, F.col(f"c{i}"), F.col(base), pct(f"c{i}", base))
        for i, (name, _, base) in enumerate(steps)
    ]
    return unpivot_row(
        one, rows, ["funnel_step", "converted_users", "from_users", "step_conversion_rate"]
    )


def conversion_paths(df: DataFrame, grain: str = "user") -> DataFrame:
    """Subjects with a view, by the way they took to a purchase."""
    path = labelled(
        (F.col("has_buy") == 0, "no purchase"),
        (_has("fav", "cart"), "pv->fav+cart->buy"),
        (_has("fav"), "pv->fav->buy"),
        (_has("cart"), "pv->cart->buy"),
        otherwise="pv->buy direct",
    )
    counts = (
        stage_flags(df, GRAINS[grain])
        .filter(F.col("has_pv") == 1)
        .groupBy(path.alias("conversion_path"))
        .agg(F.count("*").alias("user_count"))
    )
    order = Window.orderBy(F.desc("user_count"), F.asc("conversion_path"))
    return counts.select(
        "conversion_path",
        "user_count",
        pct("user_count", F.sum("user_count").over(Window.partitionBy())).alias("pct_of_total"),
        long(F.row_number().over(order)).alias("path_rank"),
    )


def daily_funnel(ud: DataFrame) -> DataFrame:
    """Users per stage and date; ``ud`` has one row per user and date."""
    daily = ud.groupBy("date").agg(
        *[F.count_if(F.col(f"{b}_count") > 0).alias(f"{b}_users") for b in BEHAVIORS]
    )
    buy_rate = pct("buy_users", "pv_users")
    return daily.select(
        *daily.columns,
        pct("fav_users", "pv_users").alias("pv_to_fav_rate"),
        pct("cart_users", "pv_users").alias("pv_to_cart_rate"),
        buy_rate.alias("pv_to_buy_rate"),
        half_up(buy_rate - F.lag(buy_rate).over(Window.orderBy("date")), 2).alias("buy_rate_change"),
    )


def period_funnel(ub: DataFrame) -> DataFrame:
    flags = stage_flags(ub.filter(F.col("behavior_type").isin("pv", "buy")), ("time_period", "user_id"))
    return (
        flags.groupBy("time_period")
        .agg(F.sum("has_pv").alias("pv_users"), F.sum("has_buy").alias("buy_users"))
        .withColumn("conversion_rate", pct("buy_users", "pv_users"))
        .withColumn(
            "conversion_rank",
            long(F.rank().over(Window.orderBy(F.desc_nulls_last("conversion_rate")))),
        )
    )


def _item_flags(ub: DataFrame) -> DataFrame:
    return stage_flags(ub, ("date", "user_id", "item_id"))


def int_conversion_funnel(ub: DataFrame) -> DataFrame:
    """Per date over (user, item) pairs. The flag frame is unique on them, so sums are distincts."""
    daily = _item_flags(ub).groupBy("date").agg(
        *[F.sum(f"has_{b}").alias(f"{b}_users") for b in BEHAVIORS],
        F.count_if(_has("buy", without=("fav", "cart"))).alias("direct_buy_count"),
    )

    def step(num, den):
        return F.coalesce(pct(num, den), F.lit(0.0))

    return daily.select(
        "date",
        *[f"{b}_users" for b in BEHAVIORS],
        step("fav_users", "pv_users").alias("pv_to_fav_rate"),
        step("cart_users", "fav_users").alias("fav_to_cart_rate"),
        step("buy_users", "cart_users").alias("cart_to_buy_rate"),
        step("buy_users", "pv_users").alias("overall_buy_rate"),
        "direct_buy_count",
    )


def item_path_stats(ub: DataFrame) -> DataFrame:
    """(user, item) pairs per date and path."""
    path = labelled(
        (_has("buy", "cart", "fav"), "pv->fav->cart->buy"),
        (_has("buy", "cart"), "pv->cart->buy"),
        (_has("buy", "fav"), "pv->fav->buy"),
        (_has("cart", "fav"), "pv->fav->cart"),
        (_has("buy"), "pv->buy"),
        (_has("cart"), "pv->cart"),
        (_has("fav"), "pv->fav"),
        otherwise="pv_only",
    )
    return (
        _item_flags(ub)
        .groupBy("date", path.alias("conversion_path"))
        .agg(F.count("*").alias("path_count"))
    )


def _totals(ud: DataFrame) -> DataFrame:
    return ud.agg(*[F.sum(f"{b}_count").alias(b) for b in BEHAVIORS])


def action_funnel(ud: DataFrame) -> DataFrame:
    """Events per stage with the rate against the stage before."""
    rows = [
        (1, "pv", F.col("pv"), F.lit(100.0)),
        (2, "fav", F.col("fav"), pct("fav", "pv")),
        (3, "cart", F.col("cart"), pct("cart", "fav")),
        (4, "buy", F.col("buy"), pct("buy", "cart")),
    ]
    out = unpivot_row(_totals(ud), rows, ["stage_no", "stage", "events", "step_rate"])
    return out.withColumn("stage_no", long("stage_no"))


def action_pair_rates(ud: DataFrame) -> DataFrame:
    pairs = [("pv", "fav"), ("pv", "cart"), ("fav", "buy"), ("cart", "buy"), ("pv", "buy")]
    rows = [
        (f"{a}->{b}", F.col(a), F.col(b), pct(b, a)) for a, b in pairs
    ]
    return unpivot_row(_totals(ud), rows, ["pair", "from_events", "to_events", "rate_pct"])
