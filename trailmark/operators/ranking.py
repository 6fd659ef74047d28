"""Exact global positions without a single-partition window.

``Window.orderBy`` without a partition sends every row to one task. Here rows are range-partitioned
on (value, id) instead: sampled range bounds on a unique pair keep the partitions even, also where
a third of all rows share one value. The sorted rows are checkpointed, so partition numbers and the
order inside each file are fixed even if executors are lost, and the position of a row is the rows
in earlier partitions plus its place in its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import long
from trailmark.session import cut

# Fixed value: monotonically_increasing_id puts the partition number above these 33 bits.
_ROW_BITS = 33


def _positions(sorted_rows: DataFrame) -> DataFrame:
    """Zero-based ``pos`` over all partitions of a range-sorted frame, and the row total ``n``."""
    fixed = cut(sorted_rows)
    mid = F.monotonically_increasing_id()
    rows = fixed.select(
        "*",
        F.shiftright(mid, _ROW_BITS).cast("int").alias("_part"),
        mid.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    # one row per partition, so the window and the broadcast are bounded by the partition number
    sizes = fixed.groupBy(F.spark_partition_id().alias("_part")).agg(F.count("*").alias("c"))
    starts = sizes.select(
        "_part",
        (F.sum("c").over(Window.orderBy("_part")) - F.col("c")).alias("_start"),
        F.sum("c").over(Window.partitionBy()).alias("n"),
    )
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn("pos", F.col("_start") + F.col("_row"))
        .drop("_part", "_row", "_start")
    )


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """``row_number() OVER (ORDER BY ...)``; ``order`` must end in a unique key."""
    placed = _positions(df.repartitionByRange(*order).sortWithinPartitions(*order))
    return placed.withColumn(name, F.col("pos") + 1).drop("pos", "n")


def bucket_of(position: Column, n: Column, k: int) -> Column:
    """NTILE bucket of a zero-based position: the first n mod k buckets hold one row more."""
    small = F.floor(n / k)
    extra = n % k
    cutoff = extra * (small + 1)
    return long(
        F.when(position < cutoff, F.floor(position / F.greatest(small + 1, F.lit(1))) + 1).otherwise(
            extra + F.floor((position - cutoff) / F.greatest(small, F.lit(1))) + 1
        )
    )


def with_ntiles(
    df: DataFrame, id_col: str, tiles: dict[str, tuple[str, bool, int]]
) -> DataFrame:
    """Add ``name: (order column, descending, k)`` NTILE columns, ties ordered by ``id_col``.

    All orders share one range shuffle: rows are repeated once per order as narrow (order, value,
    id) records, the payload travels with the first, and one grouping on the id puts them together.
    ``df`` has one row per id with fixed-width columns.
    """
    names = list(tiles)
    payload = [c for c in df.columns if c != id_col]
    keys = F.array(
        *[
            F.struct(
                F.lit(i).alias("_m"),
                (F.col(col).cast("double") * (-1.0 if descending else 1.0)).alias("_v"),
            )
            for i, (col, descending, _) in enumerate(tiles.values())
        ]
    )
    rows = df.select(id_col, *payload, F.explode(keys).alias("_k")).select(
        id_col,
        F.col("_k._m").alias("_m"),
        F.col("_k._v").alias("_v"),
        *[F.when(F.col("_k._m") == 0, F.col(c)).alias(c) for c in payload],
    )
    order = ["_m", "_v", id_col]
    placed = _positions(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    per_order = long(F.col("n") / len(names))
    at = F.col("pos") - F.col("_m") * per_order
    picks = [
        F.max(F.when(F.col("_m") == i, bucket_of(at, per_order, tiles[name][2]))).alias(name)
        for i, name in enumerate(names)
    ]
    return placed.groupBy(id_col).agg(*[F.max(c).alias(c) for c in payload], *picks)


def value_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value, rows, upto, n): counts per distinct value with their running total.

    Values are counts or days: d distinct ones need at least d(d-1)/2 events, so the ordered window
    per metric runs over at most about sqrt(2 x events) rows.
    """
    cells = F.array(
        *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    hist = df.select(F.inline(cells)).groupBy("metric", "value").agg(F.count("*").alias("rows"))
    per = Window.partitionBy("metric")
    return hist.withColumn("upto", F.sum("rows").over(per.orderBy("value"))).withColumn(
        "n", F.sum("rows").over(per)
    )


def value_at(position: Column) -> Column:
    """Aggregate over a value histogram: the value at a zero-based sorted position."""
    inside = (position >= F.col("upto") - F.col("rows")) & (position < F.col("upto"))
    return F.max(F.when(inside, F.col("value")))


def interpolated_quantiles(df: DataFrame, column: str, probs: list[float]) -> DataFrame:
    """One row q0..qk of linearly interpolated quantiles, exact, from the value histogram."""
    hist = value_histogram(df, [column])
    aggs = []
    for i, p in enumerate(probs):
        place = (F.col("n") - 1) * F.lit(p)
        aggs += [
            value_at(F.floor(place)).alias(f"lo{i}"),
            value_at(F.ceil(place)).alias(f"hi{i}"),
            F.max(place - F.floor(place)).alias(f"w{i}"),
        ]
    one = hist.agg(*aggs)
    return one.select(
        *[
            (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}")
            for i in range(len(probs))
        ]
    )


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Add ``name: column`` running totals over a global order whose key is unique per row.

    Totals of earlier partitions are one row per partition; inside a partition the window is over
    an even range of the order, never over the whole frame.
    """
    fixed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    rows = fixed.withColumn("_part", F.spark_partition_id())
    per_part = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select(
        "_part",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums],
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    out = rows.join(F.broadcast(starts), "_part")
    for name, column in sums.items():
        out = out.withColumn(name, F.sum(column).over(inside) + F.col(f"_b_{name}"))
    return out.drop("_part", *[f"_b_{n}" for n in sums])
