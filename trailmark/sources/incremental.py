"""Incremental load of the cleaned and the user-day table: only the dates that new events touch are rebuilt.

Both tables are partitioned by date. A load merges its events with those of the same dates that are there,
drops copies, and replaces these dates alone (dynamic partition overwrite). Loading the same events again, or
running a load again after a crash, gives the same tables.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import cleaning, kpi
from trailmark.session import staged
from trailmark.sources.files import path_exists


def _replace_dates(df: DataFrame, path: str) -> None:
    writer = df.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date").parquet(path)


def _of_dates(spark: SparkSession, path: str, dates: list[datetime.date], like: DataFrame) -> DataFrame | None:
    """The rows of a table on some dates; only their partitions are read."""
    if not path_exists(spark, f"{path}/date=*"):
        return None
    return spark.read.schema(like.schema).parquet(path).where(F.col("date").isin(dates))


def load_events(
    raw: DataFrame,
    cleaned: str,
    user_day: str,
    start_ts: int = cleaning.START_TS,
    end_ts: int = cleaning.END_TS,
) -> list[datetime.date]:
    """Loads raw events into the tables at ``cleaned`` and ``user_day``; returns the dates it rebuilt.

    Invalid rows are left out as by ``cleaning.clean_events``. An empty load, or one without valid rows,
    changes nothing.
    """
    spark = raw.sparkSession
    new = staged(cleaning.time_features(cleaning.clean_events(raw, start_ts, end_ts)), "load")
    dates = [r["date"] for r in new.select("date").distinct().collect()]  # no more than the window has days
    if not dates:
        return []
    old = _of_dates(spark, cleaned, dates, new)
    # written before the partitions it reads from are replaced
    merged = new if old is None else staged(new.unionByName(old).dropDuplicates(cleaning.EVENT_KEY), "merged")
    _replace_dates(merged, cleaned)
    _replace_dates(kpi.int_user_daily_metrics(merged), user_day)
    return sorted(dates)
