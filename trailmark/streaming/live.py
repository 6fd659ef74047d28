"""Live KPI windows, event dedupe and sessions over a folder that files are added to.

Each operator takes a streaming (or batch) frame of raw events. A run reads the files that are new since
the checkpoint, with ``availableNow``, and ends; the next run, after a stop or a crash, goes on from there.
State is kept per key until the watermark, the latest event time seen less ``delay``, has passed it. Rows
older than the watermark are late and take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from trailmark.functions.columns import long
from trailmark.operators.cleaning import BEHAVIORS, END_TS, EVENT_KEY, START_TS
from trailmark.sources.files import RAW_SCHEMA

# The column in which tables written by ``upserts`` keep the batch a row is from.
BATCH = "batch"


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Raw events from the Parquet files of a folder, those that are there and those that come."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_event_time(events: DataFrame, delay: str) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", delay)


def _counts() -> list:
    each = [F.count_if(F.col("behavior_type") == b).alias(f"{b}_count") for b in BEHAVIORS]
    return [F.count("*").alias("events"), *each]


# --- tumbling windows -------------------------------------------------------------------------------


def user_windows(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Events by behaviour of every window and user. A busy window is spread over its users, and the
    counts are combined before the shuffle."""
    counted = with_event_time(events, delay).groupBy(F.window("event_time", width), "user_id").agg(*_counts())
    start = F.unix_timestamp("window.start").alias("window_start")
    return counted.select(start, "user_id", *[c for c in counted.columns if c not in ("window", "user_id")])


def window_kpi(windows: DataFrame) -> DataFrame:
    """Per window its events by behaviour and its active users, from rows of ``user_windows``."""
    sums = [F.sum(c).alias(c) for c in ("events", *(f"{b}_count" for b in BEHAVIORS))]
    # a row per user: no distinct count
    return windows.groupBy("window_start").agg(*sums, F.count("user_id").alias("users"))


def upserts(updates: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes the rows that each batch changes. A batch that is run again replaces what it had written."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that ``upserts`` keeps: of each key the row of the last batch that changed it."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("v"))
    return last.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


# --- dedupe ---------------------------------------------------------------------------------------------


def clean_stream(
    events: DataFrame, delay: str = "1 day", start_ts: int = START_TS, end_ts: int = END_TS, behaviors=BEHAVIORS
) -> DataFrame:
    """The rules of ``cleaning.clean_events`` on a stream: each distinct valid event once. Copies have the
    time of their event, so one that comes within ``delay`` is known and a later one is late."""
    valid = (
        events.select(*EVENT_KEY)
        .filter(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
        .filter(F.col("timestamp").between(start_ts, end_ts))
        .filter(F.col("behavior_type").isin(*behaviors))
    )
    return with_event_time(valid, delay).dropDuplicatesWithinWatermark(EVENT_KEY).select(*EVENT_KEY)


# --- sessions -------------------------------------------------------------------------------------------


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``. A session is given out when the
    watermark has passed its end plus the gap; sessions that an event between them joins are merged in
    state until then."""
    grouped = with_event_time(events, delay).groupBy("user_id", F.session_window("event_time", gap).alias("s"))
    counted = grouped.agg(*_counts(), F.max("timestamp").alias("session_end"))
    return counted.select(
        "user_id",
        F.unix_timestamp("s.start").alias("session_start"),
        "session_end",
        long(F.col("session_end") - F.unix_timestamp("s.start")).alias("duration_sec"),
        *[c for c in counted.columns if c not in ("user_id", "s", "session_end")],
    )


def appends(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Rows that no later event can change, written once each to a Parquet table."""
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    )


# --- running --------------------------------------------------------------------------------------------


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """One run over all files that are new; raises what the query raised."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def end_of_input(spark: SparkSession, path: str, at: int) -> None:
    """Adds an event of nobody at second ``at`` to the folder, which moves the watermark there: everything
    that ended ``delay`` before is given out. The event itself stays open and is in no session given out."""
    row = spark.createDataFrame([(None, None, None, None, at)], RAW_SCHEMA)
    row.coalesce(1).write.mode("append").parquet(path)
