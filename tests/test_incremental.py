"""Incremental loads against one load of everything."""

import datetime
import uuid

import pytest

from tests.conftest import RAW, TINY, WINDOW, rows
from trailmark.operators import cleaning, kpi
from trailmark.session import shared_dir
from trailmark.sources import incremental


@pytest.fixture
def paths(spark):
    folder = f"{shared_dir(spark)}/loads/{uuid.uuid4().hex}"
    return f"{folder}/cleaned", f"{folder}/user_day"


def load(spark, paths, events):
    return incremental.load_events(spark.createDataFrame(events, RAW), *paths, *WINDOW)


def tables(spark, paths):
    return [rows(spark.read.parquet(p).select(*sorted(spark.read.parquet(p).columns))) for p in paths]


def whole(spark):
    ub = cleaning.time_features(cleaning.clean_events(spark.createDataFrame(TINY, RAW), *WINDOW))
    ud = kpi.int_user_daily_metrics(ub)
    return [rows(x.select(*sorted(x.columns))) for x in (ub, ud)]


def test_loads_in_parts_equal_one_load(spark, paths):
    for part in (TINY[::3], TINY[1::3], TINY[2::3]):
        load(spark, paths, part)
    assert tables(spark, paths) == whole(spark)


def test_a_second_load_changes_nothing(spark, paths):
    first = load(spark, paths, TINY)
    before = tables(spark, paths)
    assert load(spark, paths, TINY) == first
    assert load(spark, paths, TINY[:4]) and load(spark, paths, []) == []
    assert load(spark, paths, [(None, 1, 1, "pv", WINDOW[0]), (1, 1, 1, "click", WINDOW[0])]) == []
    assert tables(spark, paths) == before == whole(spark)


def test_other_dates_are_not_touched(spark, paths):
    load(spark, paths, TINY)
    files = lambda: {f for f in spark.read.parquet(paths[0]).inputFiles() if "date=2024-01-01" not in f}
    before = files()
    # one late event of the first day
    assert load(spark, paths, [(9, 11, 1, "pv", WINDOW[0] + 60)]) == [datetime.date(2024, 1, 1)]
    assert before == files() and before
    day = spark.read.parquet(paths[1]).where("user_id = 9").collect()
    assert [(str(r["date"]), r["total_actions"]) for r in day] == [("2024-01-01", 1)]
