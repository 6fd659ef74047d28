"""Streams against the batch results, with late rows, restarts and bounded state."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import RAW
from trailmark.operators import cleaning
from trailmark.session import shared_dir
from trailmark.streaming import live

DAY0 = 1704067200  # 2024-01-01, the first second that cleaning keeps
HOUR = 3600


@pytest.fixture
def folder(spark):
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def add(spark, folder, rows):
    spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(f"{folder}/events")


def events(n, seed, hours=48):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.choice(["pv", "pv", "cart", "fav", "buy"])
        out.append((rng.randrange(12), rng.randrange(9), 1, kind, DAY0 + rng.randrange(hours * HOUR)))
    return out


def run_windows(spark, folder, **options):
    stream = live.user_windows(live.event_stream(spark, f"{folder}/events"), **options)
    return live.run_available(live.upserts(stream, f"{folder}/table", f"{folder}/checkpoint"))


def kpi(spark, folder):
    table = live.latest(spark, f"{folder}/table", ["window_start", "user_id"])
    return {r["window_start"]: (r["events"], r["buy_count"], r["users"]) for r in live.window_kpi(table).collect()}


def want_kpi(rows):
    hours = {t // HOUR * HOUR for *_, t in rows}
    out = {}
    for h in hours:
        inside = [r for r in rows if r[4] // HOUR * HOUR == h]
        out[h] = (len(inside), sum(r[3] == "buy" for r in inside), len({r[0] for r in inside}))
    return out


def test_windows_go_on_after_a_restart(spark, folder):
    rows = events(400, 1)
    for part in (rows[:150], rows[150:300], rows[300:]):
        add(spark, folder, part)
        run_windows(spark, folder, delay="3 days")
    assert kpi(spark, folder) == want_kpi(rows)
    run_windows(spark, folder, delay="3 days")  # nothing new
    assert kpi(spark, folder) == want_kpi(rows)


def test_a_batch_run_again_replaces_its_rows(spark, folder):
    """What a crash between the write and the commit leaves: the batch is there twice."""
    rows = events(100, 2)
    add(spark, folder, rows)
    run_windows(spark, folder, delay="3 days")
    run_windows_again = live.user_windows(live.event_stream(spark, f"{folder}/events"), delay="3 days")
    live.run_available(live.upserts(run_windows_again, f"{folder}/table", f"{folder}/other"))
    assert kpi(spark, folder) == want_kpi(rows)


def test_late_rows_take_no_part_and_state_is_dropped(spark, folder):
    first = [(1, 1, 1, "pv", DAY0 + 10), (2, 1, 1, "buy", DAY0 + 20)]
    second = [(1, 1, 1, "pv", DAY0 + 10 * HOUR)]
    in_time = [(3, 1, 1, "buy", DAY0 + 9 * HOUR + 5)]
    late = [(4, 1, 1, "pv", DAY0 + 30)]
    add(spark, folder, first)
    run_windows(spark, folder, delay="2 hours")
    add(spark, folder, second)
    run_windows(spark, folder, delay="2 hours")
    add(spark, folder, in_time + late)
    query = run_windows(spark, folder, delay="2 hours")
    assert kpi(spark, folder) == want_kpi(first + second + in_time)
    state = query.lastProgress["stateOperators"][0]
    assert state["numRowsTotal"] <= 2  # the windows of the first hour are gone
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress) == 1


def test_dedupe_equals_batch_within_the_watermark(spark, folder):
    rows = events(200, 3)
    doubled = rows + random.Random(4).sample(rows, 80) + [(None, 1, 1, "pv", DAY0), (1, 1, 1, "x", DAY0), (1, 1, 1, "pv", 5)]
    for part in (doubled[:120], doubled[120:]):
        add(spark, folder, part)
        stream = live.clean_stream(live.event_stream(spark, f"{folder}/events"), "3 days")
        live.run_available(live.appends(stream, f"{folder}/table", f"{folder}/checkpoint"))
    got = spark.read.parquet(f"{folder}/table")
    want = cleaning.clean_events(spark.createDataFrame(doubled, RAW))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dedupe_state_is_bounded_by_the_watermark(spark, folder):
    for hour in range(0, 60, 6):
        add(spark, folder, [(u, 1, 1, "pv", DAY0 + hour * HOUR + u) for u in range(50)])
        stream = live.clean_stream(live.event_stream(spark, f"{folder}/events"), "3 hours")
        query = live.run_available(live.appends(stream, f"{folder}/table", f"{folder}/checkpoint"))
    assert spark.read.parquet(f"{folder}/table").count() == 500
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 100  # not 500


def want_sessions(rows, gap):
    out = []
    for user in {r[0] for r in rows}:
        times = sorted(r[4] for r in rows if r[0] == user)
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((user, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((user, start, last, n))
    return sorted(out)


def test_sessions_merge_over_files(spark, folder):
    """Files come in no order, so that a later one joins sessions of earlier ones; the gap itself joins."""
    rows = events(300, 5) + [(77, 1, 1, "pv", DAY0), (77, 1, 1, "pv", DAY0 + 3600), (77, 1, 1, "buy", DAY0 + 1800)]
    def run():
        stream = live.sessions(live.event_stream(spark, f"{folder}/events"), "30 minutes", "3 days")
        live.run_available(live.appends(stream, f"{folder}/table", f"{folder}/checkpoint"))

    for part in (rows[::3], rows[1::3], rows[2::3]):
        add(spark, folder, part)
        run()
    assert spark.read.parquet(f"{folder}/table").count() == 0  # all still open
    live.end_of_input(spark, f"{folder}/events", DAY0 + 9 * 86400)
    run()
    got = spark.read.parquet(f"{folder}/table").select("user_id", "session_start", "session_end", "events")
    assert sorted(map(tuple, got.collect())) == want_sessions(rows, 1800)


def test_operators_take_batch_frames_too(spark):
    rows = events(120, 6)
    frame = spark.createDataFrame(rows, RAW)
    found = live.sessions(frame).select("user_id", "session_start", "session_end", "events")
    assert sorted(map(tuple, found.collect())) == want_sessions(rows, 1800)
    got = {r["window_start"]: r["events"] for r in live.window_kpi(live.user_windows(frame)).collect()}
    assert got == {h: v[0] for h, v in want_kpi(rows).items()}
    assert live.window_kpi(live.user_windows(frame.where(F.lit(False)))).count() == 0
