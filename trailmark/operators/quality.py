"""Dataset validation, expectations on modelled tables, and metric reconciliation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.columns import BEHAVIORS, long, unpivot_row
from trailmark.sources.files import CLEAN_SCHEMA

_VIOLATION = "check string, detail string, violations long"
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


# --- dataset validation -------------------------------------------------------------------------------


def validate_dataset(
    df: DataFrame,
    schema: T.StructType = CLEAN_SCHEMA,
    start: str = "2024-01-01",
    end: str = "2024-01-30",
    behaviors=BEHAVIORS,
) -> DataFrame:
    """(check, detail, violations) rows of everything that is wrong; no rows means valid.

    Columns and types are checked on the schema, values in one pass. Any integer type is accepted
    for an integer column.
    """
    spark = df.sparkSession
    found = {f.name: f.dataType for f in df.schema.fields}
    meta = []
    for field in schema.fields:
        if field.name not in found:
            meta.append(("missing columns", field.name, 1))
            continue
        both_ints = isinstance(found[field.name], _INTEGERS) and isinstance(field.dataType, _INTEGERS)
        if found[field.name] != field.dataType and not both_ints:
            meta.append(("type mismatch", f"{field.name}: {found[field.name].simpleString()}", 1))
    meta += [("unexpected columns", c, 1) for c in found if c not in schema.fieldNames()]
    problems = spark.createDataFrame(meta, _VIOLATION)

    known = [f.name for f in schema.fields if f.name in found]
    rules: list[tuple[str, str, Column]] = [
        ("null values", c, F.count_if(F.col(c).isNull())) for c in known
    ]
    if "behavior_type" in known:
        unknown = ~F.col("behavior_type").isin(*behaviors)
        rules.append(("unknown behaviour", "behavior_type", F.count_if(unknown)))
    if "date" in known:
        day = F.col("date").cast("date")
        outside = ~day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        rules.append(("date range", f"{start}..{end}", F.count_if(outside)))
    rules.append(("empty", "rows", F.when(F.count("*") == 0, 1).otherwise(0)))
    one = df.agg(*[rule.cast("long").alias(f"r{i}") for i, (_, _, rule) in enumerate(rules)])
    values = unpivot_row(
        one,
        [(name, detail, F.col(f"r{i}")) for i, (name, detail, _) in enumerate(rules)],
        ["check", "detail", "violations"],
    ).filter(F.col("violations") > 0)
    return problems.unionByName(values)


# --- expectations ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Expectation:
    """A named check on a table: a row predicate that is true where the row offends, or a function
    from the table to the frame of offending groups."""

    name: str
    table: str
    offends: Column | None = None
    offending: Callable[[DataFrame], DataFrame] | None = None
    severity: str = "error"


def not_null(table: str, column: str) -> Expectation:
    return Expectation(f"not_null_{column}", table, F.col(column).isNull())


def accepted_values(table: str, column: str, values) -> Expectation:
    inside = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return Expectation(f"accepted_values_{column}", table, ~inside)


def non_negative(table: str, columns) -> Expectation:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c) < 0, F.lit(False))
    return Expectation("non_negative", table, bad)


def bounded(table: str, columns, high: float, low: float | None = None) -> Expectation:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.col(c) > high, F.lit(False))
        if low is not None:
            bad = bad | F.coalesce(F.col(c) < low, F.lit(False))
    return Expectation("bounded_" + "_".join(columns), table, bad)


def funnel_monotonic(table: str) -> Expectation:
    bad = (
        (F.col("pv_users") < F.col("fav_users"))
        | (F.col("pv_users") < F.col("cart_users"))
        | (F.col("pv_users") < F.col("buy_users"))
        | (F.col("cart_users") < F.col("buy_users"))
    )
    return Expectation("funnel_monotonic", table, bad, severity="warn")


def in_window(table: str, start_ts: int, end_ts: int, start: str, end: str) -> Expectation:
    inside = F.col("timestamp").between(start_ts, end_ts) & F.col("date").between(
        F.lit(start).cast("date"), F.lit(end).cast("date")
    )
    return Expectation("valid_timestamp", table, ~F.coalesce(inside, F.lit(False)))


def unique(table: str, columns) -> Expectation:
    def repeated(df: DataFrame) -> DataFrame:
        return df.groupBy(*columns).agg(F.count("*").alias("n")).filter(F.col("n") > 1)

    return Expectation("unique_" + "_".join(columns), table, offending=repeated)


def no_abnormal_repeat(table: str, most: int = 100) -> Expectation:
    def repeated(df: DataFrame) -> DataFrame:
        return (
            df.groupBy("user_id", "item_id", "date")
            .agg(F.count("*").alias("n"))
            .filter(F.col("n") > most)
        )

    return Expectation("no_abnormal_repeat", table, offending=repeated)


def score_direction(table: str, score: str = "f_score", metric: str = "frequency") -> Expectation:
    """The mean of ``metric`` must rise with each score step."""

    def falling(df: DataFrame) -> DataFrame:
        means = df.groupBy(score).agg(F.avg(metric).alias("m"))
        above = means.select((F.col(score) - 1).alias(score), F.col("m").alias("next_m"))
        return means.join(above, score).filter(F.col("next_m") <= F.col("m"))

    return Expectation(f"{score}_direction", table, offending=falling)


def run_expectations(frames: dict[str, DataFrame], suite: list[Expectation]) -> DataFrame:
    """(table_name, check_name, severity, violations) for every expectation.

    All row predicates on a table are counted in one pass; group checks are one aggregate each.
    """
    parts = []
    for table, df in frames.items():
        mine = [e for e in suite if e.table == table]
        rows = [e for e in mine if e.offends is not None]
        if rows:
            one = df.agg(*[F.count_if(e.offends).alias(f"c{i}") for i, e in enumerate(rows)])
            parts.append(
                unpivot_row(
                    one,
                    [(table, e.name, e.severity, F.col(f"c{i}")) for i, e in enumerate(rows)],
                    ["table_name", "check_name", "severity", "violations"],
                )
            )
        for e in mine:
            if e.offending is not None:
                parts.append(
                    e.offending(df)
                    .agg(F.count("*").alias("violations"))
                    .select(
                        F.lit(table).alias("table_name"),
                        F.lit(e.name).alias("check_name"),
                        F.lit(e.severity).alias("severity"),
                        "violations",
                    )
                )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def default_suite(start_ts: int, end_ts: int, start: str, end: str) -> list[Expectation]:
    """The checks the modelled tables ship with."""
    counts = [f"{b}_count" for b in BEHAVIORS]
    users = [f"{b}_users" for b in BEHAVIORS]
    rates = [f"retention_d{n}_rate" for n in (1, 3, 7)]
    return [
        *[not_null("stg_user_behavior", c) for c in ("user_id", "item_id", "behavior_type", "date")],
        accepted_values("stg_user_behavior", "behavior_type", BEHAVIORS),
        accepted_values("stg_user_behavior", "is_weekend", (0, 1)),
        in_window("stg_user_behavior", start_ts, end_ts, start, end),
        no_abnormal_repeat("stg_user_behavior"),
        *[not_null("int_user_daily_metrics", c) for c in ("user_id", "date")],
        non_negative("int_user_daily_metrics", counts),
        bounded("int_user_daily_metrics", ["conversion_rate"], 100),
        not_null("int_user_retention", "date"),
        unique("int_user_retention", ["date"]),
        non_negative("int_user_retention", ["new_users", "retained_d1", "retained_d3", "retained_d7"]),
        bounded("int_user_retention", rates, 100),
        not_null("int_conversion_funnel", "date"),
        unique("int_conversion_funnel", ["date"]),
        non_negative("int_conversion_funnel", users),
        funnel_monotonic("int_conversion_funnel"),
        not_null("int_user_behavior_summary", "user_id"),
        unique("int_user_behavior_summary", ["user_id"]),
        not_null("mart_daily_kpi", "date"),
        unique("mart_daily_kpi", ["date"]),
        not_null("mart_user_segments", "user_id"),
        unique("mart_user_segments", ["user_id"]),
        score_direction("mart_user_segments"),
        score_direction("mart_user_segments", "m_score", "monetary"),
        not_null("mart_rfm_segments", "user_id"),
        *[not_null("mart_user_retention", c) for c in ("cohort_date", "day_diff")],
    ]


# --- reconciliation ----------------------------------------------------------------------------------------


def reconcile_metrics(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare (metric, actual) with (metric, expected, tolerance, comparison).

    ``comparison`` is ``equal`` (within the tolerance) or ``above`` (greater than expected). A metric
    that was not produced fails.
    """
    joined = expected.join(actual, "metric", "left")
    close = F.abs(F.col("actual") - F.col("expected")) <= F.col("tolerance")
    passed = F.when(F.col("comparison") == "above", F.col("actual") > F.col("expected")).otherwise(close)
    return joined.select(
        "metric",
        "actual",
        "expected",
        "comparison",
        long(F.coalesce(passed, F.lit(False))).alias("passed"),
    )


def load_count(spark: SparkSession, path: str) -> DataFrame:
    """Row count of a written Parquet table, as the load step reports it."""
    return spark.read.parquet(path).agg(F.count("*").alias("row_count"))


