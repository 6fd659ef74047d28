"""CSV and Parquet sources and sinks for the behaviour table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("category_id", T.LongType()),
        T.StructField("behavior_type", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

CLEAN_SCHEMA = T.StructType(
    RAW_SCHEMA.fields
    + [
        T.StructField("date", T.DateType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("day_of_week", T.IntegerType()),
        T.StructField("is_weekend", T.IntegerType()),
        T.StructField("time_period", T.StringType()),
    ]
)

CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def last_change(spark: SparkSession, folder: str) -> int:
    """Newest modification time of what a folder holds directly, in milliseconds; 0 if it is empty."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return max((x.getModificationTime() for x in fs.listStatus(target)), default=0)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a path, from file metadata."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(target).getLength()


def read_behavior_csv(
    spark: SparkSession,
    path: str,
    fallback: str | None = None,
    header: bool = False,
    keep_corrupt: bool = False,
) -> DataFrame:
    """Raw events with the declared schema; fields that do not parse become NULL.

    ``keep_corrupt`` adds the text of lines that did not fit, so they can be counted.
    """
    if fallback is not None and not path_exists(spark, path):
        path = fallback
    schema = RAW_SCHEMA
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    if keep_corrupt:
        schema = T.StructType(RAW_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(schema).csv(path)


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned events written as CSV with a header."""
    return spark.read.schema(CLEAN_SCHEMA).option("header", True).csv(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned events from Parquet, columns in the declared order."""
    return spark.read.schema(CLEAN_SCHEMA).parquet(path).select(*CLEAN_SCHEMA.fieldNames())


def write_clean(
    df: DataFrame, path: str, fmt: str = "parquet", codec: str = "snappy", by_date: bool = True
) -> None:
    """Write cleaned events, by default Parquet split by date.

    The rebalance hint lets adaptive execution cut a large date into several files and put small
    dates together, so neither one task per date nor one file per task and date comes out.
    """
    out = df.hint("rebalance", "date") if by_date else df
    writer = out.write.mode("overwrite").option("compression", codec)
    if by_date:
        writer = writer.partitionBy("date")
    if fmt == "csv":
        writer = df.write.mode("overwrite").option("header", True).option("compression", "none")
    writer.format(fmt).save(path)


def read_back_matches(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Row count of the written table equals that of the frame."""
    return spark.read.parquet(path).count() == df.count()


def write_report(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = True) -> None:
    """Write a small report. ``single_file`` is for aggregated results only."""
    out = df.coalesce(1) if single_file else df
    writer = out.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_summary(metrics: list[tuple[str, DataFrame]], path: str) -> None:
    """Leave the figures of a run as JSON lines (section, metric, value) in one file; each of ``metrics``
    is a section with its few (metric, value) rows."""
    rows = None
    for section, frame in metrics:
        part = frame.select(F.lit(section).alias("section"), "metric", F.col("value").cast("double").alias("value"))
        rows = part if rows is None else rows.unionByName(part)
    write_report(rows, path, "json")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("section string, metric string, value double").json(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Materialise a modelled table in the catalog (``append`` for an incremental load)."""
    if mode == "append" and df.sparkSession.catalog.tableExists(name):
        df.write.insertInto(name)
    else:
        df.write.mode(mode).saveAsTable(name)


def export_csv(df: DataFrame, path: str) -> None:
    """Export a filtered slice as CSV, one file per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_seconds("timestamp"))
