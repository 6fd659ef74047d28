"""Sketches against exact figures, over single days and merged ranges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trailmark.operators import sketches

DAY = datetime.date(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = [
        (rng.randrange(6000), int(9000 * rng.random() ** 2), DAY + datetime.timedelta(days=rng.randrange(10)))
        for _ in range(60_000)
    ]
    ub = spark.createDataFrame(rows, "user_id long, item_id long, date date")
    ud = ub.groupBy("user_id", "date").agg(F.count("*").alias("total_actions"))
    return rows, ub, ud, sketches.daily_sketches(ub, ud).cache()


@pytest.mark.parametrize("first,last", [("2024-01-01", "2024-01-01"), ("2024-01-03", "2024-01-07"), ("2023-01-01", "2025-01-01")])
def test_ranges_are_within_the_stated_error(tables, first, last):
    rows, _, ud, daily = tables
    inside = [r for r in rows if first <= r[2].isoformat() <= last]
    got = sketches.range_overview(daily, first, last).first()
    assert got["events"] == len(inside)
    # four standard errors
    assert got["users"] == pytest.approx(len({r[0] for r in inside}), rel=4 * 0.0163)
    assert got["items"] == pytest.approx(len({r[1] for r in inside}), rel=4 * 0.0163)
    actions = sorted(r["total_actions"] for r in ud.where(F.col("date").between(first, last)).collect())
    for q in sketches.QUANTILES:
        value = got[f"actions_p{round(100 * q)}"]
        below, upto = (sum(a < value for a in actions), sum(a <= value for a in actions))
        assert below / len(actions) - 0.04 <= q <= upto / len(actions) + 0.04


def test_a_range_without_events(tables):
    got = sketches.range_overview(tables[3], "2030-01-01", "2030-01-02").first()
    assert (got["events"], got["users"], got["items"], got["actions_p50"]) == (0, 0, 0, None)


def test_a_day_is_one_small_row(tables):
    daily = tables[3]
    assert daily.count() == 10
    assert daily.agg(F.max(F.length("users") + F.length("items") + F.length("actions"))).first()[0] < 20_000
