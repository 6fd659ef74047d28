"""Cleaning and feature columns of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    BEHAVIORS,
    SCORE_WEIGHTS,
    half_up,
    labelled,
    pct,
    unpivot_row,
    weighted,
)

EVENT_KEY = ["user_id", "item_id", "category_id", "behavior_type", "timestamp"]
# 2024-01-01T00:00:00Z .. 2024-01-30T23:59:59Z, the window of the input data
START_TS, END_TS = 1704067200, 1706659199
START_DATE, END_DATE = "2024-01-01", "2024-01-30"


def schema_check(df: DataFrame, required=tuple(EVENT_KEY)) -> DataFrame:
    """The frame itself, or an error naming the columns it lacks."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def null_profile(df: DataFrame, cols=tuple(EVENT_KEY)) -> DataFrame:
    """NULLs per column, one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return unpivot_row(one, [(c, F.col(c)) for c in cols], ["column_name", "null_count"])


def _reject_reason(start_ts: int, end_ts: int, behaviors):
    missing = F.col("user_id").isNull() | F.col("item_id").isNull() | F.col("timestamp").isNull()
    return labelled(
        (missing, "null_id"),
        (~F.col("timestamp").between(start_ts, end_ts), "ts_range"),
        (~F.coalesce(F.col("behavior_type").isin(*behaviors), F.lit(False)), "behavior"),
        otherwise="valid",
    )


def clean_events(
    raw: DataFrame, start_ts: int = START_TS, end_ts: int = END_TS, behaviors=BEHAVIORS
) -> DataFrame:
    """Rows with ids, inside the window, of a known behaviour, each distinct event once.

    The row filters run before the one shuffle, which is on the full event key and so is even
    whatever a single user or item holds; copies are dropped map-side first.
    """
    schema_check(raw)
    return (
        raw.select(*EVENT_KEY)
        .filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
        .filter(F.col("timestamp").between(start_ts, end_ts))
        .filter(F.col("behavior_type").isin(*behaviors))
        .dropDuplicates(EVENT_KEY)
    )


def clean_positive(raw: DataFrame, behaviors=BEHAVIORS) -> DataFrame:
    """The batch job's variant: positive ids and timestamp, no window."""
    return (
        raw.select(*EVENT_KEY)
        .filter(
            (F.col("user_id") > 0)
            & (F.col("item_id") > 0)
            & (F.col("category_id") > 0)
            & (F.col("timestamp") > 0)
            & F.col("behavior_type").isin(*behaviors)
        )
        .dropDuplicates(EVENT_KEY)
    )


def cleaning_report(
    raw: DataFrame, start_ts: int = START_TS, end_ts: int = END_TS, behaviors=BEHAVIORS
) -> DataFrame:
    """Rows in, removed per step, and kept, from one pass.

    Rejected rows lose their key before the grouping, so each task sends one row per reason.
    """
    reason = _reject_reason(start_ts, end_ts, behaviors)
    keyed = raw.select(reason.alias("reason"), *EVENT_KEY)
    keyed = keyed.select(
        "reason", *[F.when(F.col("reason") == "valid", F.col(c)).alias(c) for c in EVENT_KEY]
    )
    totals = (
        keyed.groupBy("reason", *EVENT_KEY)
        .count()
        .agg(
            F.sum("count").alias("n"),
            *[
                F.sum(F.when(F.col("reason") == r, F.col("count")).otherwise(0)).alias(r)
                for r in ("null_id", "ts_range", "behavior")
            ],
            F.sum(F.when(F.col("reason") == "valid", F.col("count") - 1).otherwise(0)).alias("duplicate"),
        )
    )
    kept = F.col("n") - F.col("null_id") - F.col("ts_range") - F.col("behavior") - F.col("duplicate")
    rows = [
        (i, step, F.coalesce(value, F.lit(0)).cast("long"), F.coalesce(pct(value, "n"), F.lit(0.0)))
        for i, (step, value) in enumerate(
            [
                ("input", F.col("n")),
                ("null_id", F.col("null_id")),
                ("ts_range", F.col("ts_range")),
                ("behavior", F.col("behavior")),
                ("duplicate", F.col("duplicate")),
                ("kept", kept),
            ]
        )
    ]
    return unpivot_row(totals, rows, ["step_no", "step", "row_count", "pct_of_input"]).withColumn(
        "step_no", F.col("step_no").cast("long")
    )


def time_features(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """date, hour, day_of_week (Monday 0), is_weekend and time_period of a unix-second column.

    UTC is plain arithmetic, independent of the session time zone.
    """
    if tz == "UTC":
        days = F.floor(F.col("timestamp") / 86400).cast("int")
        out = df.withColumn("date", F.date_add(F.lit("1970-01-01").cast("date"), days)).withColumn(
            "hour", F.floor(F.pmod(F.col("timestamp"), F.lit(86400)) / 3600).cast("int")
        )
    else:
        utc = F.expr("timestampadd(SECOND, timestamp, TIMESTAMP_NTZ'1970-01-01 00:00:00')")
        local = F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
        out = df.withColumn("date", F.to_date(local)).withColumn("hour", F.hour(local))
    hour = F.col("hour")
    return (
        out.withColumn("day_of_week", F.weekday("date"))
        .withColumn("is_weekend", F.when(F.col("day_of_week") >= 5, 1).otherwise(0))
        .withColumn(
            "time_period",
            labelled(
                (hour < 6, "dawn"),
                (hour < 12, "morning"),
                (hour < 14, "noon"),
                (hour < 18, "afternoon"),
                (hour < 22, "evening"),
                otherwise="night",
            ),
        )
    )


def behavior_score(df: DataFrame, weights=None) -> DataFrame:
    """Calendar parts and the behaviour as a number."""
    return (
        df.withColumn("year", F.year("date"))
        .withColumn("month", F.month("date"))
        .withColumn("day", F.dayofmonth("date"))
        .withColumn("behavior_score", weighted(weights or SCORE_WEIGHTS))
    )


def behavior_score_summary(df: DataFrame) -> DataFrame:
    """Events and score per calendar day."""
    return (
        behavior_score(df)
        .groupBy("year", "month", "day")
        .agg(F.count("*").alias("events"), F.sum("behavior_score").alias("score"))
        .select(
            F.col("year").cast("long").alias("year"),
            F.col("month").cast("long").alias("month"),
            F.col("day").cast("long").alias("day"),
            "events",
            "score",
            half_up(F.col("score") / F.col("events"), 4).alias("avg_score"),
        )
    )


def stg_user_behavior(df: DataFrame, start: str = START_DATE, end: str = END_DATE) -> DataFrame:
    """The typed staging view: renamed columns, known behaviours, date window."""
    return df.filter(
        F.col("user_id").isNotNull()
        & F.col("behavior_type").isin(*BEHAVIORS)
        & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    ).select(
        F.col("user_id").cast("long").alias("user_id"),
        F.col("item_id").cast("long").alias("item_id"),
        F.col("category_id").cast("long").alias("category_id"),
        F.col("behavior_type").cast("string").alias("behavior_type"),
        F.col("timestamp").cast("long").alias("event_timestamp"),
        F.col("date").alias("event_date"),
        F.col("hour").cast("int").alias("event_hour"),
        F.col("day_of_week").cast("int").alias("day_of_week"),
        F.col("is_weekend").cast("int").alias("is_weekend"),
        F.col("time_period").alias("time_period"),
    )
