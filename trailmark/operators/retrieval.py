"""Exact largest inner products between two factor tables, without scoring every pair.

Items are ordered by norm and cut into blocks. Every user is scored against the first block, which holds
the longest items; the k-th best product found there is a bound that the final k-th cannot fall under.
By Cauchy-Schwarz a block whose longest item times the user's norm is under the bound holds nothing for
that user. As norms fall from block to block, the blocks a user still needs are the next few, and only
those pairs of user and block are made.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.columns import one_row
from trailmark.operators.ranking import with_row_number
from trailmark.session import staged

# Items of one block, and users that meet a block in one task.
BLOCK = 4096
USERS = 16_384


def _norm(v: str) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x))


def _products(k: int):
    """The ``k`` best items of a block for each user, ties to the smaller id."""

    def run(users: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = {"user": [], "item": [], "score": []}
        if len(users) and len(items):
            items = items.sort_values("item")
            ids, rows = items["item"].to_numpy(), np.stack(items["iv"].to_numpy()).astype(np.float64)
            for at in range(0, len(users), 512):
                part = users.iloc[at : at + 512]
                scores = np.stack(part["uv"].to_numpy()).astype(np.float64) @ rows.T
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                out["user"].append(np.repeat(part["user"].to_numpy(), best.shape[1]))
                out["item"].append(ids[best].ravel())
                out["score"].append(np.take_along_axis(scores, best, 1).ravel())
        return pd.DataFrame({c: np.concatenate(v) if v else v for c, v in out.items()})

    return run


def needed_blocks(users: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(item, iv, block) with blocks by falling norm, (user, uv, last) with the last block a user needs, and
    what the first block gave as (user, item, score). All staged."""
    normed = items.select(F.col("id").alias("item"), F.col("features").alias("iv"), _norm("features").alias("norm"))
    placed = with_row_number(normed, [F.desc("norm"), F.asc("item")], "no")
    placed = staged(placed.withColumn("block", F.floor((F.col("no") - 1) / block).cast("int")), "item-blocks")
    people = users.select(F.col("id").alias("user"), F.col("features").alias("uv"), _norm("features").alias("unorm"))
    people = staged(people, "users")
    first = staged(_scored(people.withColumn("block", F.lit(0)), placed.where("block = 0"), k, people.count()), "first")
    bound = first.groupBy("user").agg(F.count("*").alias("m"), F.min("score").alias("kth"))
    # a row per block: the longest item of each; a hair longer for rounding
    tops = placed.groupBy("block").agg((F.max("norm") * (1 + 1e-9) + 1e-12).alias("longest"))
    ladder = tops.agg(F.sort_array(F.collect_list(F.struct("block", "longest"))).alias("ladder"))
    ladder = one_row(ladder)("ladder")
    known = people.join(bound, "user", "left").withColumn("ladder", ladder)
    reach = F.filter("ladder", lambda b: b["longest"] * F.col("unorm") >= F.col("kth"))
    # blocks stand in order of their longest item, so the ones needed come first
    last = F.when(F.coalesce("m", F.lit(0)) < k, F.size("ladder") - 1).otherwise(F.size(reach) - 1)
    return placed, staged(known.select("user", "uv", last.alias("last")), "reach"), first


def _scored(pairs: DataFrame, items: DataFrame, k: int, rows: int) -> DataFrame:
    """``pairs`` (user, uv, block), dealt by block and by parts of a block's users, met by the block's items."""
    blocks = max(1, items.agg(F.count_distinct("block")).first()[0])
    parts = max(1, -(-rows // (blocks * USERS)))
    left = pairs.select("user", "uv", "block", F.pmod(F.xxhash64("user"), F.lit(parts)).cast("int").alias("part"))
    right = items.select(
        "item", "iv", F.col("block").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("share")
    )
    kinds = dict(left.dtypes) | dict(right.dtypes)
    return left.groupBy("block", "part").cogroup(right.groupBy("of", "share")).applyInPandas(
        _products(k), f"user {kinds['user']}, item {kinds['item']}, score double"
    )


def largest_products(users: DataFrame, items: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(user, item, score, rank): for each row of ``users`` the ``k`` rows of ``items`` with the largest inner
    product, ties to the smaller item. Both are (id, features). Exact in double precision."""
    placed, reach, first = needed_blocks(users, items, k, block)
    rest = reach.where("last >= 1").select("user", "uv", F.explode(F.sequence(F.lit(1), "last")).alias("block"))
    later = _scored(rest, placed.where("block >= 1"), k, reach.agg(F.sum("last")).first()[0] or 0)
    order = Window.partitionBy("user").orderBy(F.desc("score"), "item")
    ranked = first.unionByName(later).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def skipped_share(reach: DataFrame, blocks: int) -> float:
    """The share of pairs of user and block that were not scored."""
    rows, needed = reach.agg(F.count("*"), F.sum(F.col("last") + 1)).first()
    return 1 - needed / (rows * blocks) if rows and blocks else 0.0
