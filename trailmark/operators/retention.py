"""Cohorts and retention.

All reports share one reduction: per user the first date, then users per (cohort, day). A user's
rows are one per active date, so no group is longer than the window has dates, and every report
below works on at most dates x dates rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import half_up, labelled, long, pct, ratio


def user_cohorts(ud: DataFrame) -> DataFrame:
    """Per user and active date: first date, days since then and the running number of the date."""
    user = Window.partitionBy("user_id")
    first = F.min("date").over(user)
    return ud.select(
        "user_id",
        "date",
        first.alias("cohort_date"),
        long(F.datediff("date", first)).alias("day_diff"),
        long(F.row_number().over(user.orderBy("date"))).alias("active_seq"),
    )


def cohort_counts(ud: DataFrame) -> DataFrame:
    """Users per cohort and day after the first date (``ud`` has one row per user and date)."""
    first = F.min("date").over(Window.partitionBy("user_id"))
    days = ud.select("date", first.alias("cohort_date"))
    return days.groupBy("cohort_date", long(F.datediff("date", "cohort_date")).alias("day_diff")).agg(
        F.count("*").alias("users")
    )


def _on_day(n: int):
    return F.max(F.when(F.col("day_diff") == n, F.col("users")))


def daily_new_users(ud: DataFrame) -> DataFrame:
    first = ud.groupBy("user_id").agg(F.min("date").alias("date"))
    return first.groupBy("date").agg(F.count("*").alias("new_users"))


def retention_dn(ud: DataFrame, days=(1, 3, 7)) -> DataFrame:
    """Per cohort: size, and retained users and percent for each of ``days`` (0 when none)."""
    wide = cohort_counts(ud).groupBy(F.col("cohort_date").alias("date")).agg(
        _on_day(0).alias("new_users"),
        *[F.coalesce(_on_day(n), F.lit(0)).alias(f"retained_d{n}") for n in days],
    )
    out = ["date", "new_users"]
    for n in days:
        out += [f"retained_d{n}", pct(f"retained_d{n}", "new_users").alias(f"retention_d{n}_pct")]
    return wide.select(*out)


def retention_matrix(ud: DataFrame, max_day: int = 7, rates=(1, 3, 7)) -> DataFrame:
    wide = cohort_counts(ud).groupBy("cohort_date").agg(
        _on_day(0).alias("cohort_size"),
        *[F.coalesce(_on_day(n), F.lit(0)).alias(f"d{n}_users") for n in range(1, max_day + 1)],
    )
    return wide.select(
        *wide.columns, *[pct(f"d{n}_users", "cohort_size").alias(f"d{n}_rate") for n in rates]
    )


def _with_size(counts: DataFrame) -> DataFrame:
    return counts.withColumn(
        "cohort_size",
        F.max(F.when(F.col("day_diff") == 0, F.col("users"))).over(Window.partitionBy("cohort_date")),
    )


def retention_trend(ud: DataFrame, days=(1, 3, 7)) -> DataFrame:
    """Rate per cohort and day, against the previous cohort that has this day."""
    raw = pct("users", "cohort_size", None)
    order = Window.partitionBy("day_diff").orderBy("cohort_date")
    rows = _with_size(cohort_counts(ud)).filter(F.col("day_diff").isin(*days))
    return rows.select(
        F.col("cohort_date").alias("first_date"),
        "cohort_size",
        F.col("day_diff").alias("retention_day"),
        half_up(raw, 2).alias("retention_rate"),
        F.lag(half_up(raw, 2)).over(order).alias("prev_rate"),
        half_up(raw - F.lag(half_up(raw, 2)).over(order), 2).alias("rate_change"),
    )


def int_user_retention(ud: DataFrame, days=(1, 3, 7)) -> DataFrame:
    """As ``retention_dn`` but NULL where nobody came back, with a trailing mean of the D1 rate."""
    wide = cohort_counts(ud).groupBy(F.col("cohort_date").alias("date")).agg(
        _on_day(0).alias("new_users"), *[_on_day(n).alias(f"retained_d{n}") for n in days]
    )
    week = Window.orderBy("date").rowsBetween(-6, 0)
    return wide.select(
        *wide.columns,
        *[pct(f"retained_d{n}", "new_users").alias(f"retention_d{n}_rate") for n in days],
        half_up(F.avg(pct(f"retained_d{days[0]}", "new_users", None)).over(week), 2).alias(
            "retention_d1_ma7"
        ),
    )


def mart_user_retention(ud: DataFrame, days=(1, 3, 7)) -> DataFrame:
    return (
        _with_size(cohort_counts(ud))
        .filter(F.col("day_diff").isin(*days))
        .select(
            "cohort_date",
            "day_diff",
            F.col("users").alias("retained_users"),
            F.col("cohort_size").alias("cohort_users"),
            ratio("users", "cohort_size").alias("retention_rate"),
            labelled(
                (F.col("day_diff") == 1, "D1"),
                (F.col("day_diff") == 3, "D3"),
                (F.col("day_diff") == 7, "D7"),
                otherwise="Other",
            ).alias("retention_label"),
        )
    )


def cohort_pivot(ud: DataFrame, max_day: int = 7) -> DataFrame:
    """Cohort x D0..Dn in percent of D0, one decimal, missing 0."""
    wide = cohort_counts(ud).groupBy("cohort_date").agg(
        *[F.coalesce(_on_day(n), F.lit(0)).alias(f"n{n}") for n in range(max_day + 1)]
    )
    return wide.select(
        "cohort_date", *[pct(f"n{n}", "n0", 1).alias(f"d{n}") for n in range(max_day + 1)]
    )


def cohort_table(ud: DataFrame) -> DataFrame:
    return _with_size(cohort_counts(ud)).select(
        "cohort_date",
        F.col("day_diff").alias("period"),
        F.col("users").alias("active_users"),
        "cohort_size",
        ratio("users", "cohort_size").alias("retention_rate"),
    )


def cohort_key_metrics(ud: DataFrame) -> DataFrame:
    """Per cohort: size, D0 users, D1/D3/D7 and the last observed period; best D1 cohort marked.

    The final column is the retention in the last period of the whole table (0 for a cohort that
    is too young to have it).
    """
    counts = cohort_counts(ud)
    wide = counts.groupBy("cohort_date").agg(
        _on_day(0).alias("cohort_size"),
        *[F.coalesce(_on_day(n), F.lit(0)).alias(f"n{n}") for n in (1, 3, 7)],
        F.max("day_diff").alias("last_period"),
        F.max_by("users", "day_diff").alias("last_users"),
    )
    horizon = F.max("last_period").over(Window.partitionBy())
    final_users = F.when(F.col("last_period") == horizon, F.col("last_users")).otherwise(0)
    best = Window.orderBy(F.desc_nulls_last("d1_retention"), F.asc("cohort_date"))
    return wide.select(
        "cohort_date",
        "cohort_size",
        F.col("cohort_size").alias("d0_active"),
        *[ratio(f"n{n}", "cohort_size").alias(f"d{n}_retention") for n in (1, 3, 7)],
        ratio(final_users, "cohort_size").alias("final_retention"),
    ).withColumn("is_best_d1", long(F.row_number().over(best) == 1))
