"""Column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The behaviour types of the event table, in funnel order.
BEHAVIORS = ("pv", "fav", "cart", "buy")

# Weights per behaviour for the three scores.
LTV_WEIGHTS = {"pv": 1, "fav": 3, "cart": 5, "buy": 10}
RATING_WEIGHTS = {"pv": 1, "fav": 2, "cart": 3, "buy": 5}
SCORE_WEIGHTS = {"pv": 1, "fav": 2, "cart": 3, "buy": 4}


def count_of(behavior: str, column: str = "behavior_type") -> Column:
    return F.count_if(F.col(column) == behavior)


def behavior_counts(names=BEHAVIORS) -> list[Column]:
    """``pv_count, fav_count, ...`` as conditional counts over raw events."""
    return [count_of(b).alias(f"{b}_count") for b in names]


def sum_counts(names=BEHAVIORS) -> list[Column]:
    """``pv_count, fav_count, ...`` summed from an already counted frame."""
    return [F.sum(f"{b}_count").alias(f"{b}_count") for b in names]


def weighted(weights: dict[str, int], column: str = "behavior_type", default: int = 0) -> Column:
    value = F.lit(default)
    for name, weight in weights.items():
        value = F.when(F.col(column) == name, F.lit(weight)).otherwise(value)
    return value.cast("long")


def weighted_counts(weights: dict[str, int]) -> Column:
    total = F.lit(0).cast("long")
    for name, weight in weights.items():
        total = total + F.col(f"{name}_count") * F.lit(weight)
    return total


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def half_up(value, digits: int) -> Column:
    """Round half away from zero; the same arithmetic is used on every engine we compare with."""
    value = _col(value).cast("double")
    scale = F.lit(float(10**digits))
    return (
        F.when(value < 0, -F.floor(-value * scale + 0.5) / scale)
        .otherwise(F.floor(value * scale + 0.5) / scale)
    )


def nonzero(value) -> Column:
    value = _col(value).cast("double")
    return F.when(value != 0, value)


def ratio(num, den, digits: int | None = 4) -> Column:
    """num / den in double, NULL when den is 0 or NULL."""
    value = _col(num).cast("double") / nonzero(den)
    return value if digits is None else half_up(value, digits)


def pct(num, den, digits: int | None = 2) -> Column:
    value = _col(num).cast("double") * F.lit(100.0) / nonzero(den)
    return value if digits is None else half_up(value, digits)


def long(value) -> Column:
    return _col(value).cast("long")


def labelled(*steps, otherwise: str) -> Column:
    """First matching label of (condition, label) steps."""
    out = None
    for condition, label in steps:
        out = F.when(condition, F.lit(label)) if out is None else out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise))


def unpivot_row(df: DataFrame, rows: list[tuple], names: list[str], keep=()) -> DataFrame:
    """Turn a one-row (or per-key) aggregate into one row per entry of ``rows``.

    Each entry is a tuple of Columns or literals matching ``names``. Replaces a UNION ALL that
    would read the input once per branch.
    """
    structs = [
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, r)])
        for r in rows
    ]
    return df.select(*keep, F.inline(F.array(*structs)))


def one_row(stats: DataFrame):
    """Field access into a one-row aggregate, planned as a scalar subquery instead of a join."""
    row = stats.select(F.struct(*[F.col(c) for c in stats.columns])).scalar()
    return row.getField


def by_date():
    """Window over frames of one row per date."""
    return Window.orderBy("date")


def all_rows():
    """Window over a whole small frame (one row per date, label or behaviour)."""
    return Window.partitionBy()
