"""Staged tables follow the window and the input folder's state."""

import os

from pyspark.sql import functions as F

from trailmark.sources.tables import workspace

SF = "/root/testdata/sf0.001"
DAY = 86400


def test_window_is_a_parameter(spark):
    whole = workspace(spark, SF)
    first, last = whole.start_ts + 3 * DAY, whole.start_ts + 6 * DAY - 1
    part = workspace(spark, SF, first, last)
    expected = whole.behavior.where(F.col("timestamp").between(first, last)).count()
    assert 0 < expected < whole.behavior.count()
    assert part.behavior.count() == expected
    assert part.user_day.agg(F.sum("total_actions")).first()[0] == expected


def test_changed_folder_is_read_again(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.limit(50).write.parquet(f"{tmp_path}/events.parquet")
    before = workspace(spark, str(tmp_path))
    assert workspace(spark, str(tmp_path)) is before
    few = before.behavior.count()
    events.write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    os.utime(tmp_path / "events.parquet", (2_000_000_000, 2_000_000_000))
    after = workspace(spark, str(tmp_path))
    assert after is not before and after.behavior.count() > few
