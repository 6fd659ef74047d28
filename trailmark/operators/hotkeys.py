"""Joins whose left side may have a few keys with a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys that go through the broadcast path.
HOT_KEYS = 512


def join_spread(
    rows: DataFrame, lookup: DataFrame, key: str, hot: int = HOT_KEYS, counts: DataFrame | None = None
) -> DataFrame:
    """Inner join of ``rows`` to ``lookup`` on ``key`` that never shuffles the busiest keys.

    The ``hot`` keys with the most rows meet a broadcast of their lookup rows (``lookup`` holds a
    bounded number of rows per key), the others, none of which can hold more than 1/hot of the rows,
    meet in a shuffle join. ``counts`` (key, _c) spares counting the rows of each key.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("_c"))
    busiest = counts.orderBy(F.desc("_c"), key).limit(hot).select(key)
    hot_lookup = lookup.join(F.broadcast(busiest), key, "left_semi")
    cold = rows.join(F.broadcast(busiest), key, "left_anti")
    return rows.join(F.broadcast(hot_lookup), key).unionByName(cold.join(lookup, key))
