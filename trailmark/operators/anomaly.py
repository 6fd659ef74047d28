"""Anomaly flags on daily and hourly aggregates (one row per date, or per date and hour)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import (
    all_rows,
    by_date,
    half_up,
    labelled,
    long,
    nonzero,
    pct,
    ratio,
    sum_counts,
)
from trailmark.operators.kpi import hourly_traffic



def _daily(ud: DataFrame) -> DataFrame:
    return (
        ud.groupBy("date")
        .agg(
            F.count("*").alias("dau"),
            *sum_counts(("pv", "buy")),
            F.count_if(F.col("buy_count") > 0).alias("buyer_count"),
        )
        .withColumn("conversion_rate", ratio("buy_count", "pv_count"))
    )


def _z(metric: str, window) -> F.Column:
    spread = F.stddev_pop(metric).over(window)
    return (F.col(metric) - F.avg(metric).over(window)) / nonzero(spread)


def _beyond(z, k):
    return F.coalesce(F.abs(z) > k, F.lit(False))


def zscore_anomalies(ud: DataFrame, k: float = 2.0) -> DataFrame:
    """Daily metrics against the mean and population deviation of the whole window."""
    daily = _daily(ud)
    z = {m: _z(m, all_rows()) for m in ("dau", "pv_count", "buy_count", "conversion_rate")}
    return daily.select(
        "date",
        "dau",
        "pv_count",
        "buy_count",
        "conversion_rate",
        half_up(z["dau"], 2).alias("dau_zscore"),
        half_up(z["pv_count"], 2).alias("pv_zscore"),
        half_up(z["buy_count"], 2).alias("buy_zscore"),
        half_up(z["conversion_rate"], 2).alias("rate_zscore"),
        labelled(
            (_beyond(z["dau"], k), "dau"),
            (_beyond(z["pv_count"], k), "pv"),
            (_beyond(z["buy_count"], k), "buy"),
            (_beyond(z["conversion_rate"], k), "conversion"),
            otherwise="normal",
        ).alias("anomaly_flag"),
    )


def moving_avg_anomalies(ud: DataFrame, w: int = 3, k: float = 2.0) -> DataFrame:
    """Each date against the ``w`` dates before it; the first ``w`` dates have too few."""
    before = by_date().rowsBetween(-w, -1)
    rn = F.row_number().over(by_date())

    def off(metric):
        gap = F.abs(F.col(metric) - F.avg(metric).over(before))
        return F.coalesce(gap > k * nonzero(F.stddev_pop(metric).over(before)), F.lit(False))

    ma = {m: F.avg(m).over(before) for m in ("dau", "pv_count", "conversion_rate")}
    return _daily(ud).select(
        "date",
        "dau",
        "conversion_rate",
        half_up(ma["dau"], 2).alias("dau_ma"),
        "pv_count",
        half_up(ma["pv_count"], 2).alias("pv_ma"),
        half_up(ma["conversion_rate"], 4).alias("rate_ma"),
        labelled(
            (rn <= w, "insufficient"),
            (off("dau"), "dau"),
            (off("pv_count"), "pv"),
            (off("conversion_rate"), "conversion"),
            otherwise="normal",
        ).alias("anomaly_flag"),
        F.when(rn > w, pct(F.col("dau") - ma["dau"], ma["dau"])).alias("dau_deviation_pct"),
    )


def dod_attribution(ud: DataFrame, swing_pct: float = 10.0) -> DataFrame:
    """Day-over-day DAU change with a weekday/weekend reason."""
    before = F.lag("dau").over(by_date())
    change = pct(F.col("dau") - before, before, None)
    weekend = F.weekday("date") >= 5
    return _daily(ud).select(
        "date",
        "dau",
        "pv_count",
        "buy_count",
        "conversion_rate",
        "buyer_count",
        long(weekend).alias("is_weekend"),
        half_up(change, 2).alias("dau_change_pct"),
        labelled(
            (weekend & (F.col("dau") > before), "weekend_up"),
            (weekend & (F.col("dau") < before), "weekend_down"),
            (~weekend & (F.abs(change) > swing_pct), "weekday_swing"),
            otherwise="normal",
        ).alias("possible_reason"),
    )


def hourly_anomalies(ub: DataFrame, k: float = 2.0, top: int = 20) -> DataFrame:
    """Each (date, hour) against the same hour of all dates; the ``top`` largest DAU deviations."""
    hourly = hourly_traffic(ub).withColumn("conversion_rate", ratio("buy_count", "pv_count"))
    same_hour = Window.partitionBy("hour")
    z = _z("hourly_uv", same_hour)
    rate_z = _z("conversion_rate", same_hour)
    return (
        hourly.select(
            "date",
            "hour",
            "hourly_uv",
            "conversion_rate",
            half_up(F.avg("hourly_uv").over(same_hour), 2).alias("expected_uv"),
            half_up(z, 2).alias("uv_zscore"),
            half_up(F.avg("conversion_rate").over(same_hour), 4).alias("expected_rate"),
            labelled(
                (_beyond(z, k), "uv"), (_beyond(rate_z, k), "conversion"), otherwise="normal"
            ).alias("hourly_anomaly"),
            half_up(F.abs(z), 6).alias("size"),
        )
        .orderBy(F.desc_nulls_last("size"), "date", "hour")
        .limit(top)
        .drop("size")
    )
