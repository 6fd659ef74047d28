"""The canonical behaviour table and the tables derived from it, for one input folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.operators import cleaning, kpi
from trailmark.session import shared_dir
from trailmark.sources.files import last_change, path_exists, stored_bytes

BUCKET_BYTES = 128 * 1024 * 1024
MAX_BUCKETS = 50_000

# How the event types of the input map to behaviours.
EVENT_TO_BEHAVIOR = {"view": "pv", "click": "cart", "signup": "fav", "purchase": "buy"}


def behavior_from_events(events: DataFrame) -> DataFrame:
    """Raw behaviour rows; an event type without a mapping keeps its name and is cleaned out later."""
    behavior = F.col("event_type")
    for event, name in EVENT_TO_BEHAVIOR.items():
        behavior = F.when(F.col("event_type") == event, F.lit(name)).otherwise(behavior)
    key = F.get_json_object("props", "$.k").try_cast("long")
    ts = F.col("ts")
    seconds = (
        F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )
    return events.select(
        "user_id",
        (key + 1).alias("item_id"),
        (key % 10 + 1).alias("category_id"),
        behavior.alias("behavior_type"),
        seconds.alias("timestamp"),
    )


def purchases_from_orders(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Order lines as pure buy events: customer buys part, category is the part's brand number."""
    day = F.to_date("o_orderdate")
    seconds = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86400
    brands = part.select(
        F.col("p_partkey").alias("item_id"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long").alias("category_id"),
    )
    lines = lineitem.select("l_orderkey", F.col("l_partkey").alias("item_id"))
    lines = lines.join(brands, "item_id")
    heads = orders.select("o_orderkey", "o_custkey", seconds.alias("timestamp"), day.alias("date"))
    return heads.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("user_id"),
        "item_id",
        "category_id",
        F.lit("buy").alias("behavior_type"),
        "timestamp",
        "date",
    )


class Workspace:
    """Input tables of one folder, and the cleaned and modelled tables built from them once.

    The cleaned table is written to the shared folder partitioned by date, as the batch job it
    stands for does; every later question reads only the columns and dates it needs. The table per
    user and day is written too, because most reports need no finer grain. ``start_ts`` and ``end_ts``
    are the first and last second that cleaning keeps. What is written is named after the folder, its
    last change and the window, so other data or another window never meet old tables.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        start_ts: int = cleaning.START_TS,
        end_ts: int = cleaning.END_TS,
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.start_ts, self.end_ts = start_ts, end_ts
        self.changed = last_change(spark, self.folder)
        self._kept: dict[str, object] = {}

    def once(self, name: str, build: Callable[[], object]):
        """A fitted model kept for the session, so several questions can be asked of one fit."""
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _staged(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        path = self._path(name)
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            df = build()
            if by:
                df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)
            else:
                df.write.mode("overwrite").parquet(path)  # as the last join leaves it: no shuffle for the files' sake
        return self.spark.read.parquet(path)

    def _bucketed(self, name: str, build: Callable[[], DataFrame], key: str, sort: str) -> DataFrame:
        """Staged as a table bucketed and sorted on ``key``: what groups or windows on it later
        reads its bucket and needs no shuffle. Sized by the bytes of the cleaned events."""
        path = self._path(name)
        app = "".join(c if c.isalnum() else "_" for c in self.spark.sparkContext.applicationId)
        table = f"trailmark_{app}_{self._tag()}_{name}"
        if not self.spark.catalog.tableExists(table):
            df = build()
            size = stored_bytes(self.spark, self._path("behavior"))
            cores = self.spark.sparkContext.defaultParallelism
            buckets = min(MAX_BUCKETS, max(cores, -(-size // BUCKET_BYTES)))
            (
                df
                .repartition(buckets, key)
                .write.mode("overwrite")
                .bucketBy(buckets, key)
                .sortBy(key, sort)
                .option("path", path)
                .saveAsTable(table)
            )
        return self.spark.table(table)

    def _tag(self) -> str:
        name = f"{self.folder}_{self.changed}_{self.start_ts}_{self.end_ts}"
        return "".join(c if c.isalnum() else "_" for c in name).strip("_").lower()

    def _path(self, name: str) -> str:
        return f"{shared_dir(self.spark)}/tables/{self._tag()}/{name}"

    @cached_property
    def raw(self) -> DataFrame:
        return behavior_from_events(self.table("events"))

    @cached_property
    def behavior(self) -> DataFrame:
        return self._staged(
            "behavior",
            lambda: cleaning.time_features(cleaning.clean_events(self.raw, self.start_ts, self.end_ts)),
            by="date",
        )

    @cached_property
    def user_day(self) -> DataFrame:
        # a user has at most one row per date, so no bucket can grow hot
        return self._bucketed(
            "user_day", lambda: kpi.int_user_daily_metrics(self.behavior), "user_id", "date"
        )

    @cached_property
    def purchases(self) -> DataFrame:
        return self._staged(
            "purchases",
            lambda: purchases_from_orders(
                self.table("orders"), self.table("lineitem"), self.table("part")
            ),
        )


_OPEN: dict[tuple, Workspace] = {}


def workspace(
    spark: SparkSession, folder: str, start_ts: int = cleaning.START_TS, end_ts: int = cleaning.END_TS
) -> Workspace:
    """The session's workspace of a folder as it is now; a changed folder gets a new one."""
    new = Workspace(spark, folder, start_ts, end_ts)
    key = (spark.sparkContext.applicationId, new.folder, new.changed, start_ts, end_ts)
    return _OPEN.setdefault(key, new)
