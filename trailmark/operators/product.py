"""Product and category reports.

Item tables can be as long as the catalogue: top-k is a distributed take-ordered, ranks are computed
inside the top rows where the order is the same, and otherwise from a histogram of the count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    behavior_counts,
    half_up,
    labelled,
    long,
    one_row,
    pct,
    ratio,
    sum_counts,
)
from trailmark.operators.ranking import value_at, value_histogram
from trailmark.operators.similarity import top_pairs
from trailmark.session import cut


def _rank_in(order):
    """Rank inside rows that are already the first k of the same order."""
    return long(F.rank().over(Window.orderBy(order)))


def rank_by_histogram(rows: DataFrame, everything: DataFrame, column: str, name: str) -> DataFrame:
    """Global descending RANK of ``column`` for a few ``rows``: 1 + number of larger values.

    The histogram has one row per distinct count, at most about sqrt(2 x events) of them.
    """
    hist = everything.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    above = F.sum("_c").over(Window.orderBy(F.desc("_v"))) - F.col("_c")
    ranks = hist.select("_v", (above + 1).alias(name))
    return rows.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def item_sales(ub: DataFrame) -> DataFrame:
    """Per item and category: purchases, views, distinct buyers.

    Counting per (item, user) first keeps a hot item spread over its users.
    """
    per_user = (
        ub.filter(F.col("behavior_type").isin("pv", "buy"))
        .groupBy("item_id", "category_id", "user_id")
        .agg(*behavior_counts(("pv", "buy")))
    )
    return per_user.groupBy("item_id", "category_id").agg(
        *sum_counts(("pv", "buy")), F.count_if(F.col("buy_count") > 0).alias("buyer_count")
    )


def top_items(ub: DataFrame, n: int = 20) -> DataFrame:
    top = item_sales(ub).orderBy(F.desc("buy_count"), "item_id", "category_id").limit(n)
    by_buys = Window.orderBy(F.desc("buy_count"))
    return top.select(
        "item_id",
        "category_id",
        "buy_count",
        "pv_count",
        "buyer_count",
        ratio("buy_count", "pv_count").alias("conversion_rate"),
        long(F.rank().over(by_buys)).alias("buy_rank"),
        long(F.dense_rank().over(by_buys)).alias("buy_dense_rank"),
    )


def category_totals(ub: DataFrame) -> DataFrame:
    per_user_item = ub.groupBy("category_id", "item_id", "user_id").agg(*behavior_counts())
    return per_user_item.groupBy("category_id").agg(
        *sum_counts(),
        F.count_distinct("item_id").alias("item_count"),
        F.count_distinct(F.when(F.col("buy_count") > 0, F.col("user_id"))).alias("buyer_count"),
    )


def top_categories(ub: DataFrame, n: int = 10) -> DataFrame:
    cats = cut(category_totals(ub))
    top = cats.orderBy(F.desc("buy_count"), "category_id").limit(n)
    top = rank_by_histogram(top, cats, "pv_count", "pv_rank")
    return (
        top.withColumn("buy_rank", _rank_in(F.desc("buy_count")))
        .withColumn("rank_diff", F.col("pv_rank") - F.col("buy_rank"))
        .withColumn("category_conversion_rate", ratio("buy_count", "pv_count"))
        .withColumn("avg_buy_per_buyer", ratio("buy_count", "buyer_count", 2))
    )


def top_conversion_items(ub: DataFrame, min_pv: int = 50, n: int = 20) -> DataFrame:
    items = cut(item_sales(ub).filter(F.col("pv_count") >= min_pv)).withColumn(
        "conversion_rate", ratio("buy_count", "pv_count")
    )
    top = items.orderBy(
        F.desc("conversion_rate"), F.desc("pv_count"), "item_id", "category_id"
    ).limit(n)
    return rank_by_histogram(top, items, "buy_count", "buy_rank").withColumn(
        "conversion_rank", _rank_in(F.desc("conversion_rate"))
    )


def long_tail_items(ub: DataFrame, n: int = 30) -> DataFrame:
    """Items with more views than the median item, most viewed first, flagged by conversion."""
    items = cut(ub.groupBy("item_id", "category_id").agg(*behavior_counts()))
    mean = one_row(items.agg(F.avg("pv_count").alias("pv"), F.avg("buy_count").alias("buy")))
    median = one_row(
        value_histogram(items, ["pv_count"]).agg(value_at(F.floor(F.col("n") / 2)).alias("pv"))
    )
    rate = ratio("buy_count", "pv_count")
    return (
        items.filter(F.col("pv_count") > median("pv"))
        .select(
            "item_id",
            "category_id",
            "pv_count",
            "buy_count",
            "cart_count",
            "fav_count",
            rate.alias("conversion_rate"),
            labelled(
                (rate < 0.001, "high_views_no_conversion"),
                (rate < 0.005, "high_views_low_conversion"),
                (
                    (F.col("pv_count") > mean("pv") * 2) & (F.col("buy_count") < mean("buy")),
                    "wasted_traffic",
                ),
                otherwise="normal",
            ).alias("long_tail_flag"),
            labelled(
                (
                    (F.col("cart_count") + F.col("fav_count") > 0) & (F.col("buy_count") == 0),
                    "intent_without_purchase",
                ),
                otherwise="converted_or_no_intent",
            ).alias("intent_no_convert"),
        )
        .orderBy(F.desc("pv_count"), F.asc("conversion_rate"), "item_id", "category_id")
        .limit(n)
    )


def category_efficiency(ub: DataFrame, min_pv: int = 100) -> DataFrame:
    """Conversion of each category against the pooled rate of all categories with enough views."""
    per_item = ub.groupBy("category_id", "item_id").agg(*behavior_counts(("pv", "buy")))
    totals = (
        per_item.groupBy("category_id")
        .agg(*sum_counts(("pv", "buy")), F.count("*").alias("sku_count"))
        .filter(F.col("pv_count") >= min_pv)
    )
    everything = Window.partitionBy()
    base = ratio(F.sum("buy_count").over(everything), F.sum("pv_count").over(everything), None)
    rate = F.col("buy_count") / F.col("pv_count")
    rows = totals.withColumn("b", base).withColumn("r", rate)
    b, r = F.col("b"), F.col("r")
    return rows.select(
        "category_id",
        "sku_count",
        "pv_count",
        "buy_count",
        half_up(b, 6).alias("benchmark_rate"),
        half_up(r, 4).alias("conversion_rate"),
        half_up(r - b, 4).alias("rate_diff"),
        half_up((r - b) * 100 / b, 2).alias("rate_diff_pct"),
        labelled(
            (r > b * 1.5, "excellent"), (r > b, "good"), (r > b * 0.5, "fair"), otherwise="poor"
        ).alias("category_grade"),
        ratio("pv_count", "sku_count", 2).alias("avg_pv_per_sku"),
        long(F.rank().over(Window.orderBy(F.desc("r")))).alias("conversion_rank"),
    )


def item_scatter(ub: DataFrame, n: int | None = 5000, seed: int = 42) -> DataFrame:
    """Views and purchases of viewed items; a sample of ``n`` items in hash order, None for all."""
    items = (
        ub.filter(F.col("behavior_type").isin("pv", "buy"))
        .groupBy("item_id")
        .agg(*behavior_counts(("pv", "buy")))
        .filter(F.col("pv_count") > 0)
    )
    if n is None:
        return items
    return items.orderBy(F.xxhash64(F.col("item_id"), F.lit(seed)), "item_id").limit(n)


def _viewed_and_bought(ub: DataFrame) -> DataFrame:
    return ub.groupBy("item_id").agg(*behavior_counts(("pv", "buy")))


def zero_conversion_items(ub: DataFrame) -> DataFrame:
    """Viewed items nobody bought, and their share of viewed items; one pass, no anti-join."""
    return (
        _viewed_and_bought(ub)
        .filter(F.col("pv_count") > 0)
        .agg(
            F.count("*").alias("viewed_items"),
            F.count_if(F.col("buy_count") == 0).alias("zero_conversion_items"),
        )
        .withColumn("share_pct", pct("zero_conversion_items", "viewed_items"))
    )


def zero_conversion_over_median(ub: DataFrame) -> DataFrame:
    """The other published definition: unsold items with more views than the median, of all items."""
    items = cut(_viewed_and_bought(ub))
    median = one_row(
        value_histogram(items, ["pv_count"]).agg(value_at(F.floor(F.col("n") / 2)).alias("pv"))
    )
    hit = (F.col("buy_count") == 0) & (F.col("pv_count") > median("pv"))
    return items.agg(
        F.count("*").alias("all_items"), F.count_if(hit).alias("zero_conversion_items")
    ).withColumn("share_pct", pct("zero_conversion_items", "all_items"))


def top_n_contribution(ub: DataFrame, n: int = 20) -> DataFrame:
    """Share of all purchases that falls on the ``n`` best-selling items."""
    items = cut(
        ub.filter(F.col("behavior_type") == "buy").groupBy("item_id").agg(F.count("*").alias("buys"))
    )
    total = one_row(items.agg(F.sum("buys").alias("t")))("t")
    top = items.orderBy(F.desc("buys"), "item_id").limit(n)
    return top.agg(F.sum("buys").alias("top_buys")).select(
        "top_buys", total.alias("all_buys"), pct("top_buys", total).alias("share_pct")
    )


def co_purchase_pairs(ub: DataFrame, n: int = 20, **tuning) -> DataFrame:
    """The ``n`` item pairs bought by the most common users, with categories and rank."""
    bought = (
        ub.filter(F.col("behavior_type") == "buy")
        .select("user_id", "item_id", "category_id")
        .distinct()
    )
    pairs = top_pairs(bought, "user_id", ["item_id", "category_id"], "item_id", n, **tuning)
    return pairs.select(
        F.col("a_item_id").alias("item_a"),
        F.col("b_item_id").alias("item_b"),
        F.col("a_category_id").alias("cat_a"),
        F.col("b_category_id").alias("cat_b"),
        F.col("together").alias("co_buy_count"),
        _rank_in(F.desc("together")).alias("pair_rank"),
    )
