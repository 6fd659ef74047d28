"""Recommenders: implicit ratings, ALS, item and user collaborative filtering, popularity."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from trailmark.functions.columns import RATING_WEIGHTS, half_up, labelled, long, one_row, ratio, weighted
from trailmark.operators.hotkeys import join_spread
from trailmark.operators.ranking import running_sums, with_row_number
from trailmark.operators.retrieval import largest_products
from trailmark.operators.similarity import cosine, cosine_neighbors, nearest_to_part
from trailmark.session import cut, shared_dir, staged


# --- ratings --------------------------------------------------------------------------------------


def implicit_ratings(ub: DataFrame, weights=None) -> DataFrame:
    """Summed behaviour weight per user and item."""
    return (
        ub.groupBy("user_id", "item_id")
        .agg(F.sum(weighted(weights or RATING_WEIGHTS)).alias("rating"))
        .filter(F.col("rating") > 0)
    )


def active_buyer_ratings(ub: DataFrame, min_buys: int = 2, top: int | None = None, weights=None) -> DataFrame:
    """Ratings of users with ``min_buys`` purchases or more; ``top`` keeps the busiest, None all."""
    users = (
        ub.filter(F.col("behavior_type") == "buy")
        .groupBy("user_id")
        .agg(F.count("*").alias("buys"))
        .filter(F.col("buys") >= min_buys)
    )
    if top is not None:
        users = users.orderBy(F.desc("buys"), "user_id").limit(top)
    return implicit_ratings(ub.join(users.select("user_id"), "user_id", "left_semi"), weights)


def matrix_sparsity(ratings: DataFrame) -> DataFrame:
    by_user = ratings.groupBy("user_id").agg(F.count("*").alias("n"))
    by_item = ratings.select("item_id").distinct()
    one = by_user.agg(F.count("user_id").alias("users"), F.coalesce(F.sum("n"), F.lit(0)).alias("cells")).select(
        "users", one_row(by_item.agg(F.count("item_id").alias("n")))("n").alias("items"), "cells"
    )
    return one.withColumn(
        "sparsity",
        half_up(1 - F.col("cells") / (F.col("users").cast("double") * F.col("items")), 6),
    )


# --- ALS ------------------------------------------------------------------------------------------


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): ids 0..n-1 in id order, numbered without passing the ids through the driver."""
    ids = df.select(column).distinct()
    return with_row_number(ids, [F.asc(column)], name).withColumn(name, (F.col(name) - 1).cast("int"))


def index_ids(ratings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ratings with int ids for ALS, and the two id maps."""
    ratings = cut(ratings)
    users = cut(dense_index(ratings, "user_id", "user_idx"))
    items = cut(dense_index(ratings, "item_id", "item_idx"))
    indexed = join_spread(cut(join_spread(ratings, users, "user_id")), items, "item_id")
    return indexed, users, items


def split_ratings(ratings: DataFrame, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``is_train`` from a hash of the pair, so the split does not depend on partitioning."""
    key = F.concat_ws("_", F.col("user_id"), F.col("item_id"), F.lit(seed))
    bucket = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % 10_000
    return ratings.withColumn("is_train", bucket < int(train_share * 10_000))


def als_fit(train: DataFrame, **params):
    """Implicit-feedback ALS on (user_idx, item_idx, rating)."""
    shared_dir(train.sparkSession)
    settings = {
        "rank": 10,
        "maxIter": 10,
        "regParam": 0.1,
        "alpha": 40.0,
        "implicitPrefs": True,
        "nonnegative": True,
        "coldStartStrategy": "drop",
        "checkpointInterval": 2,
        "seed": 42,
        **params,
    }
    als = ALS(userCol="user_idx", itemCol="item_idx", ratingCol="rating", **settings)
    return als.fit(train)


def als_evaluate(model, test: DataFrame) -> DataFrame:
    """RMSE and MAE over the test pairs with both sides known; one row."""
    error = F.col("prediction") - F.col("rating")
    scored = model.transform(test).filter(~F.isnan("prediction"))
    return scored.agg(
        F.count("*").alias("test_pairs"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )


def als_recommend(model, users: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` items of every user with the original ids and the rank, scored by the model's factors
    without meeting every item (``retrieval``). Equal scores go to the smaller item number."""
    recs = largest_products(model.userFactors, model.itemFactors, n).select(
        F.col("user").alias("user_idx"),
        F.col("item").alias("item_idx"),
        "score",
        long(F.col("rank")).alias("rank_no"),
    )
    # a best seller is in many lists
    named = join_spread(recs.join(users, "user_idx"), items, "item_idx")
    return named.select("user_id", "item_id", "score", "rank_no")


def recommendations_for(recs: DataFrame, user_id: int) -> DataFrame:
    return recs.filter(F.col("user_id") == user_id).orderBy("rank_no")


def write_recommendations(recs: DataFrame, similar: DataFrame, metrics: DataFrame, folder: str) -> None:
    """CSV of recommendations and similarities, and the one-row metrics as JSON."""
    recs.write.mode("overwrite").option("header", True).csv(f"{folder}/recommendations")
    similar.write.mode("overwrite").option("header", True).csv(f"{folder}/item_similarity")
    metrics.write.mode("overwrite").json(f"{folder}/metrics")


# --- similar items from latent factors ----------------------------------------------------------------

# Points per slice of a cell, the longest block one task multiplies with another.
CELL_SLICE = 2048


def _top_of_block(q: pd.DataFrame, t: pd.DataFrame, n: int) -> pd.DataFrame:
    """The n best targets of each query row within one pair of slices."""
    if q.empty or t.empty:
        return pd.DataFrame({"id": [], "neighbor": [], "similarity": []})
    sims = np.vstack(q["vec"].to_numpy()) @ np.vstack(t["vec"].to_numpy()).T
    sims[q["id"].to_numpy()[:, None] == t["id"].to_numpy()[None, :]] = -2.0
    ids = t["id"].to_numpy()
    order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, : n + 1]
    out = pd.DataFrame(
        {
            "id": np.repeat(q["id"].to_numpy(), order.shape[1]),
            "neighbor": ids[order].ravel(),
            "similarity": np.take_along_axis(sims, order, axis=1).ravel(),
        }
    )
    out = out[out["similarity"] > -1.5]
    return out.groupby("id", sort=False).head(n)


_NEIGHBOR = "id int, neighbor int, similarity double"


def _best(rows: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor")
    return rows.withColumn("rank_no", F.row_number().over(order)).filter(F.col("rank_no") <= n)


def factor_neighbors(factors: DataFrame, n: int = 10, max_cells: int = 1024) -> DataFrame:
    """Exact ``n`` most similar vectors by cosine of (id int, features array).

    A nearest-neighbour join in metric space: every vector belongs to the cell of its closest pivot,
    a first search inside its own slice gives an upper bound on the angle of its n-th neighbour, and
    the triangle inequality leaves out every cell that lies further away. Slices meet as matrix
    products inside a task that returns n rows per vector; pairs are never rows of a join.
    Pivots and cell radii are at most ``max_cells`` rows. A zero vector has no direction: it is
    nobody's neighbour, and its one row has neither neighbour nor rank.
    """
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x))
    measured = factors.select("id", F.col("features").cast("array<double>").alias("features")).withColumn("norm", norm)
    empty = F.lit(None).cast
    alone = measured.filter(~(F.col("norm") > 0)).select(
        "id", empty("int").alias("neighbor"), empty("double").alias("similarity"), empty("int").alias("rank_no")
    )
    unit = cut(
        measured.filter(F.col("norm") > 0)
        .select("id", F.transform("features", lambda x: x / F.col("norm")).alias("vec"))
    )
    total = unit.count()
    cells = max(1, min(max_cells, int(np.ceil(np.sqrt(total)))))
    sample = unit.orderBy(F.xxhash64("id"), "id").limit(cells).collect()
    if not sample:
        return alone
    pivots = np.array([r["vec"] for r in sample])

    def assign(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            sims = np.vstack(pdf["vec"].to_numpy()) @ pivots.T
            cell = sims.argmax(axis=1)
            angle = np.arccos(np.clip(sims[np.arange(len(pdf)), cell], -1, 1))
            yield pdf.assign(cell=cell.astype("int32"), angle=angle)

    placed = unit.mapInPandas(assign, "id int, vec array<double>, cell int, angle double")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("c"), F.max("angle").alias("radius"))
    sizes = cut(sizes)
    cell_rows = sizes.collect()
    radius = np.full(cells, -1.0)
    for r in cell_rows:
        radius[r["cell"]] = r["radius"]
    slices = F.broadcast(sizes.select("cell", F.ceil(F.col("c") / CELL_SLICE).alias("parts")))
    points = cut(
        placed.join(slices, "cell")
        .withColumn("slice", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        .select("id", "vec", "cell", "slice")
    )

    def own_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        return _top_of_block(pdf, pdf, n)

    near = points.groupBy("cell", "slice").applyInPandas(own_slice, _NEIGHBOR)
    bound = near.groupBy("id").agg(F.count("*").alias("m"), F.min("similarity").alias("s"))
    queries = points.join(bound, "id", "left").withColumn(
        "limit", F.when(F.col("m") >= n, F.acos(F.least(F.lit(1.0), F.col("s")))).otherwise(F.lit(4.0))
    )

    def reachable(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            angle = np.arccos(np.clip(np.vstack(pdf["vec"].to_numpy()) @ pivots.T, -1, 1))
            hit = (angle - radius[None, :] <= pdf["limit"].to_numpy()[:, None] + 1e-6) & (radius >= 0)
            row, cell = np.nonzero(hit)
            out = pdf.iloc[row][["id", "vec", "cell", "slice"]]
            yield out.assign(target=cell.astype("int32"))

    asked = cut(
        queries.select("id", "vec", "cell", "slice", "limit").mapInPandas(
            reachable, "id int, vec array<double>, cell int, slice int, target int"
        )
    )
    # targets go only to the query slices that asked for their cell
    wanted = asked.select("cell", "slice", "target").distinct()
    keys = ["cell", "slice", "target", "tslice"]
    targets = cut(
        points.select("id", "vec", F.col("cell").alias("target"), F.col("slice").alias("tslice"))
        .join(wanted, "target")
        .select("id", "vec", *keys)
    )
    parts = slices.select(F.col("cell").alias("target"), "parts")
    numbers = F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))
    queries = cut(
        asked.join(parts, "target").withColumn("tslice", F.explode(numbers)).select("id", "vec", *keys)
    )

    def meet(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        return _top_of_block(q, t, n)

    found = (
        queries.groupBy(*keys)
        .cogroup(targets.groupBy(*keys))
        .applyInPandas(meet, _NEIGHBOR)
    )
    return _best(found, n).unionByName(alone)


def item_factor_similarity(model, items: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` similar items by ALS item factors, with the original ids."""
    similar = factor_neighbors(model.itemFactors, n)
    other = items.select(F.col("item_id").alias("similar_item"), F.col("item_idx").alias("neighbor"))
    return (
        similar.join(items, similar["id"] == items["item_idx"])
        .join(other, "neighbor", "left")
        .select("item_id", "similar_item", "similarity", long("rank_no").alias("rank_no"))
    )


# --- item-based CF ------------------------------------------------------------------------------------


def purchases_of(ub: DataFrame) -> DataFrame:
    """Distinct (user, item) purchases."""
    return ub.filter(F.col("behavior_type") == "buy").select("user_id", "item_id").distinct()


def item_cf_similarity(buys: DataFrame, k: int = 10, **tuning) -> DataFrame:
    """Per item its ``k`` most similar items by common buyers."""
    return cosine_neighbors(buys, "item_id", "user_id", k, **tuning).select(
        "item_id",
        F.col("neighbor").alias("similar_item"),
        F.col("together").alias("common_buyers"),
        "similarity",
        "rank_no",
    )


def item_cf_recommend(
    history: DataFrame, buys: DataFrame, k: int = 10, depth: int = 64, **tuning
) -> DataFrame:
    """Top ``k`` items not owned, scored by the highest similarity to any owned item.

    ``history`` and ``buys`` are distinct (user_id, item_id). Each owned item brings its ``depth``
    best neighbours rather than all partners, so a best-selling item adds a bounded list. A cut list
    of an item still holds ``k`` entries the user does not own, all better than what was cut off, if
    the user owns at most depth - k items, so the result of these users is exact. Users who own more
    are looked at from the side of the candidates (``_collector_scores``).
    """
    depth = max(depth, 2 * k)
    lists = _neighbor_lists(buys, depth, tuning)
    known = lists.select("item_id").distinct()
    history = cut(history.select("user_id", "item_id"))
    history = cut(join_spread(history, known, "item_id"))
    sizes = history.groupBy("user_id").agg(F.count("*").alias("m"))
    collectors = cut(sizes.filter(F.col("m") > depth - k).select("user_id"))
    if collectors.isEmpty():
        return _best_items(_owned_side_scores(history, lists), history, k)
    small = history.join(collectors, "user_id", "left_anti")
    result = _best_items(_owned_side_scores(small, lists), small, k)
    history = cut(history.join(collectors, "user_id", "left_semi"))
    while True:
        top, left = _collector_scores(history, lists, k, depth)
        if left.isEmpty():
            return result.unionByName(top)
        result = result.unionByName(cut(top.join(left, "user_id", "left_anti")))
        history = cut(history.join(left, "user_id", "left_semi"))
        depth *= 8
        lists = _neighbor_lists(buys, depth, tuning)


def _neighbor_lists(buys: DataFrame, depth: int, tuning: dict) -> DataFrame:
    return cut(
        item_cf_similarity(buys, depth, **tuning).select("item_id", "similar_item", "similarity")
    )


def _owned_side_scores(history: DataFrame, lists: DataFrame) -> DataFrame:
    return (
        join_spread(history, lists, "item_id")
        .groupBy("user_id", F.col("similar_item").alias("candidate"))
        .agg(F.max("similarity").alias("score"))
    )


def _best_items(scores: DataFrame, history: DataFrame, k: int) -> DataFrame:
    owned = history.select("user_id", F.col("item_id").alias("candidate"))
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "candidate")
    return (
        scores.join(owned, ["user_id", "candidate"], "left_anti")
        .withColumn("rank_no", long(F.row_number().over(order)))
        .filter(F.col("rank_no") <= k)
        .select("user_id", F.col("candidate").alias("item_id"), "score", "rank_no")
    )


def _collector_scores(
    history: DataFrame, lists: DataFrame, k: int, depth: int
) -> tuple[DataFrame, DataFrame]:
    """Top ``k`` of users with many items, and the users whose result is not yet certain.

    Similarity is symmetric: the best owned item of a candidate is the first owned one in the
    candidate's own list. A candidate found that way has its exact score. What may be missing are
    items with a cut list without any owned entry, and their score is at most the end of that list;
    a user is certain if every cut list that ends at or above the user's k-th score belongs to an
    item that is owned or was found. Ends are compared in thousandths, rounded to the safe side.
    """
    owned = history.select("user_id", F.col("item_id").alias("similar_item"))
    found = cut(
        lists.join(owned, "similar_item")
        .groupBy("user_id", F.col("item_id").alias("candidate"))
        .agg(F.max("similarity").alias("score"))
    )
    top = cut(_best_items(found, history, k))
    ends = (
        lists.groupBy("item_id")
        .agg(F.count("*").alias("m"), F.min("similarity").alias("last"))
        .filter(F.col("m") >= depth)
        .select("item_id", F.floor(F.col("last") * 1000).alias("bin"))
    )
    ends = cut(ends)
    floor_of = (
        history.select("user_id")
        .distinct()
        .join(top.groupBy("user_id").agg(F.count("*").alias("m"), F.min("score").alias("kth")), "user_id", "left")
        .select(
            "user_id",
            F.when(F.col("m") >= k, F.floor(F.col("kth") * 1000)).otherwise(0).alias("bin"),
        )
    )
    floor_of = cut(floor_of)
    # similarities lie in [0, 1], so there are at most 1001 bins
    bins = ends.groupBy("bin").agg(F.count("*").alias("c"))
    grid = ends.sparkSession.range(1001).select(F.col("id").alias("bin"))
    upward = Window.orderBy(F.desc("bin"))
    at_least = grid.join(F.broadcast(bins), "bin", "left").select(
        "bin", F.sum(F.coalesce("c", F.lit(0))).over(upward).alias("total")
    )
    covered = (
        found.select("user_id", F.col("candidate").alias("item_id"))
        .unionByName(history)
        .distinct()
        .join(ends, "item_id")
        .join(floor_of.withColumnRenamed("bin", "floor"), "user_id")
        .groupBy("user_id")
        .agg(F.count_if(F.col("bin") >= F.col("floor")).alias("covered"))
    )
    left = (
        floor_of.join(F.broadcast(at_least), "bin")
        .join(covered, "user_id", "left")
        .filter(F.coalesce("covered", F.lit(0)) < F.col("total"))
        .select("user_id")
    )
    return top, cut(left)


# --- user-based CF ------------------------------------------------------------------------------------


def active_matrix(ub: DataFrame, min_cnt: int = 2, last: str | None = None) -> DataFrame:
    """Purchases of users and of items with ``min_cnt`` or more; with ``last`` the last value of that column
    of each purchase."""
    buys = purchases_of(ub)
    if last is not None:
        pairs = ub.filter(F.col("behavior_type") == "buy").groupBy("user_id", "item_id")
        buys = pairs.agg(F.max(last).alias(last))
    buys = staged(buys, "buys")

    def busy(column):
        return buys.groupBy(column).agg(F.count("*").alias("c")).filter(F.col("c") >= min_cnt).select(column)

    return buys.join(busy("user_id"), "user_id", "left_semi").join(busy("item_id"), "item_id", "left_semi")


def user_similarity(matrix: DataFrame, k: int = 10, **tuning) -> DataFrame:
    """Per user the ``k`` most similar users by cosine over common items."""
    return cosine_neighbors(matrix, "user_id", "item_id", k, **tuning).select(
        "user_id",
        F.col("neighbor").alias("similar_user"),
        F.col("together").alias("common_items"),
        "similarity",
        "rank_no",
    )


# Users whose lists one task adds up at a time, and how far sums of equal rounded scores may lie apart.
SCORED_USERS = 256
SCORE_STEP = 2_000


def _best_sums(n: int, kinds: pa.Schema):
    """Sums over the lists of some users' neighbours, without items of the users' own lists (no ``units``);
    of each user the ``n`` largest and what rounding may put beside them."""

    def run(rows: pa.Table) -> pa.Table:
        lists = rows["items"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        lengths = lists.value_lengths().to_numpy()
        users, owner = np.unique(rows["user_id"].to_numpy(), return_inverse=True)
        items, item = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        units = np.repeat(rows["units"].fill_null(-1).to_numpy(), lengths)
        cell = np.repeat(owner, lengths) * len(items) + item
        order = np.argsort(cell, kind="stable")
        cell, units = cell[order], units[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
        if not len(first):
            return kinds.empty_table()
        total = np.add.reduceat(np.maximum(units, 0), first)
        new = np.minimum.reduceat(units, first) >= 0
        total, cell = total[new], cell[first][new]
        user = cell // len(items)
        order = np.lexsort((-total, user))
        total, cell, user = total[order], cell[order], user[order]
        begin = np.searchsorted(user, user)
        last = np.minimum(begin + n, np.searchsorted(user, user, "right")) - 1
        keep = total >= total[last] - SCORE_STEP
        columns = users[user[keep]], items[cell[keep] % len(items)], total[keep]
        return pa.table([pa.array(c, type=f.type) for c, f in zip(columns, kinds)], schema=kinds)

    return run


def _neighbor_scores(matrix: DataFrame, nearest: DataFrame, owned: DataFrame, n: int) -> DataFrame:
    """(user_id, item_id, score): summed similarity of the users in ``nearest`` who have the item in
    ``matrix``, for items that the user does not have in ``owned``; the ``n`` best of each user, or more.
    Both are rows (user_id, item_id), or lists (user_id, items) that are written already.

    What is shuffled is a list per neighbour, not a row per neighbour and item, and sums are taken where a
    user's lists meet.
    """

    def lists(rows: DataFrame) -> DataFrame:
        if "items" in rows.columns:
            return rows
        return staged(rows.groupBy("user_id").agg(F.collect_list("item_id").alias("items")), "lists")

    theirs = lists(matrix)
    mine = theirs if owned is matrix else lists(owned)
    # similarities have nine digits, so the sum is taken over integers and has no order
    units = F.floor(F.col("similarity") * 1e9 + 0.5).cast("long").alias("units")
    met = nearest.select("user_id", F.col("similar_user").alias("other"), units)
    met = met.join(theirs.withColumnRenamed("user_id", "other"), "other").select("user_id", "units", "items")
    met = met.unionByName(mine.select("user_id", F.lit(None).cast("long").alias("units"), "items"))
    buckets = max(1, -(-mine.count() // SCORED_USERS))
    item = StructField("item_id", theirs.schema["items"].dataType.elementType)
    out = StructType([matrix.schema["user_id"], item, StructField("total", LongType())])
    sums = met.groupBy(F.pmod(F.xxhash64("user_id"), F.lit(buckets)).alias("bucket")).applyInArrow(
        _best_sums(n, to_arrow_schema(out)), out
    )
    return sums.select("user_id", "item_id", half_up(F.col("total") / 1e9, 6).alias("score"))


def _top_per_user(scores: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return scores.withColumn("rank_no", long(F.row_number().over(order))).filter(F.col("rank_no") <= n)


def user_cf_recommend(matrix: DataFrame, k: int = 10, n: int = 5) -> DataFrame:
    """Items of the ``k`` most similar users, by summed similarity, not owned, top ``n``."""
    matrix = cut(matrix)
    return _top_per_user(_neighbor_scores(matrix, user_similarity(matrix, k), matrix, n), n)


# --- popularity -----------------------------------------------------------------------------------------


def popularity_recommend(ratings: DataFrame, k: int = 10, head: int = 1024) -> DataFrame:
    """For every user the ``k`` most popular items (by summed rating) the user has not touched.

    Popular items are numbered once. A user who owns m of the first ``head`` finds k free ones among
    the first m + k, so only owned numbers inside the head are gathered per user, a list of at most
    ``head``. Users who own nearly the whole head are finished from the full numbering.
    """
    head = max(head, 2 * k)
    ratings = cut(ratings.select("user_id", "item_id", "rating"))
    ranked = cut(
        with_row_number(
            ratings.groupBy("item_id").agg(F.sum("rating").alias("popularity")),
            [F.desc("popularity"), F.asc("item_id")],
            "no",
        ).select("item_id", "popularity", F.col("no").cast("int").alias("no"))
    )
    items = ranked.count()
    first = ranked.filter(F.col("no") <= head)
    owned = (
        ratings.join(F.broadcast(first.select("item_id", "no")), "item_id", "left")
        .groupBy("user_id")
        .agg(F.collect_set("no").alias("taken"))
    )
    owned = cut(owned)
    enough = F.size("taken") + k <= head if items > head else F.lit(True)
    last = F.least(F.size("taken") + k, F.lit(items))
    free = F.slice(F.array_except(F.sequence(F.lit(1), last), "taken"), 1, k)
    picks = owned.filter(enough).select("user_id", F.posexplode(free).alias("p", "no"))
    result = picks.join(F.broadcast(first), "no").select(
        "user_id", "item_id", "popularity", long(F.col("p") + 1).alias("rank_no")
    )
    rest = owned.filter(~enough).select("user_id")
    if items <= head or rest.isEmpty():
        return result
    return result.unionByName(_popular_for_collectors(ratings, ranked, rest, k, head, items))


def _popular_for_collectors(ratings, ranked, users, k: int, block: int, items: int) -> DataFrame:
    """Free items of users who own most popular ones, block by block of the numbering."""
    mine = ratings.join(users, "user_id", "left_semi").join(ranked.select("item_id", "no"), "item_id")
    blocks = mine.groupBy("user_id", F.floor((F.col("no") - 1) / block).alias("b")).agg(
        F.collect_set("no").alias("taken")
    )
    user = Window.partitionBy("user_id").orderBy("b")
    low, high = F.col("b") * block + 1, F.least((F.col("b") + 1) * block, F.lit(items))
    open_before = F.coalesce(
        F.sum(block - F.size("taken")).over(user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # blocks without any owned item are missing; the first missing one is free as a whole
    runs = blocks.withColumn("seq", F.row_number().over(user) - 1).withColumn("before", open_before)
    solid = runs.filter(F.col("b") == F.col("seq"))
    inside = solid.filter(F.col("before") < k).select(
        "user_id",
        F.explode(F.array_except(F.sequence(low.cast("int"), high.cast("int")), "taken")).alias("no"),
    )
    start = solid.groupBy("user_id").agg((F.max("b") + 1).alias("b"))
    fresh = start.filter(F.col("b") * block < items).select(
        "user_id",
        F.explode(
            F.sequence(low.cast("int"), F.least(F.col("b") * block + k, F.lit(items)).cast("int"))
        ).alias("no"),
    )
    order = Window.partitionBy("user_id").orderBy("no")
    top = (
        inside.unionByName(fresh)
        .withColumn("rank_no", long(F.row_number().over(order)))
        .filter(F.col("rank_no") <= k)
    )
    return top.join(ranked, "no").select("user_id", "item_id", "popularity", "rank_no")


# --- evaluation -------------------------------------------------------------------------------------------


def _with_hidden(matrix: DataFrame) -> DataFrame:
    """(user_id, items, hidden): each user's list in ``matrix`` (user_id, item_id, date) and its last purchase
    by date, then item; none is hidden from a list of one."""
    last = F.max(F.struct("date", "item_id"))["item_id"].alias("last")
    lists = staged(matrix.groupBy("user_id").agg(F.collect_list("item_id").alias("items"), last), "baskets")
    return lists.select("user_id", "items", F.when(F.size("items") >= 2, F.col("last")).alias("hidden"))


def _honest_neighbors(baskets: DataFrame, k: int) -> DataFrame:
    """The ``k`` users nearest to each user's remaining purchases, over the others' full rows."""
    rows = baskets.select(F.col("user_id").alias("i"), F.explode("items").alias("u"), "hidden")
    asked = F.coalesce(F.col("u") != F.col("hidden"), F.lit(False)).alias("asked")
    return nearest_to_part(rows.select("i", "u", asked), k).select(
        F.col("i").alias("user_id"), F.col("j").alias("similar_user"), cosine("together", "n", "nj").alias("similarity")
    )


def leave_one_out_eval(ub: DataFrame, k: int = 10, neighbors: int = 10, min_cnt: int = 2) -> DataFrame:
    """Hide each user's last purchase (by date, then item) and look for it in the top ``k``.

    The hidden purchase is gone from the user's own row, from its length and from the item's buyers,
    for that user alone; all other rows stay. User CF and popularity are scored on the same users;
    the report names user CF unless it has no hit at all. One row.
    """
    # a row per user serves as purchases, training rows and hidden items: nothing is shuffled to tell them apart
    baskets = _with_hidden(active_matrix(ub, min_cnt, last="date"))
    evaluated = baskets.filter(F.col("hidden").isNotNull())
    hidden = evaluated.select("user_id", F.col("hidden").alias("item_id"))
    train = evaluated.select("user_id", F.filter("items", lambda x: x != F.col("hidden")).alias("items"))
    cf = _top_per_user(
        _neighbor_scores(baskets.drop("hidden"), _honest_neighbors(baskets, neighbors), train, k), k
    )
    # place of each hidden item with one buyer less among all items by buyers, then by id
    buyers = baskets.select(F.explode("items").alias("item_id")).groupBy("item_id").agg(F.count("*").alias("c"))
    buyers = staged(buyers, "buyers")
    wanted = hidden.select("item_id").distinct().join(buyers, "item_id")
    line = buyers.select("c", "item_id", F.lit(1).alias("real")).unionByName(
        wanted.select((F.col("c") - 1).alias("c"), "item_id", F.lit(0).alias("real"))
    )
    line = running_sums(line, [F.desc("c"), F.asc("item_id"), F.desc("real")], {"before": "real"})
    # the item itself, with its full count, stands before its own lowered place
    places = line.filter("real = 0").select("item_id", "c", (F.col("before") - 1).alias("before"))
    # Spark sizes an explode like its input: never broadcast
    owned = train.select("user_id", F.explode("items").alias("item_id")).hint("merge")
    taken = owned.join(buyers, "item_id").groupBy("user_id").agg(
        F.collect_list(F.struct("c", "item_id")).alias("taken")
    )
    ahead = F.filter(
        "taken",
        lambda x: (x["c"] > F.col("c")) | ((x["c"] == F.col("c")) & (x["item_id"] < F.col("item_id"))),
    )
    place = (
        hidden.join(places, "item_id")
        .join(taken, "user_id")
        .select("user_id", (F.col("before") - F.size(ahead) + 1).alias("place"))
    )
    hits = hidden.join(
        cf.select("user_id", "item_id", "rank_no"), ["user_id", "item_id"], "left"
    ).join(place, "user_id")
    sizes = cf.groupBy("user_id").agg(F.count("*").alias("recs"))
    one = (
        hits.join(sizes, "user_id", "left")
        .agg(
            F.count("*").alias("evaluated_users"),
            F.count_if(F.col("rank_no").isNotNull()).alias("usercf_hits"),
            F.count_if(F.col("place") <= k).alias("popularity_hits"),
            half_up(
                F.avg(
                    F.when(F.col("rank_no").isNotNull(), 1 / F.col("recs")).otherwise(0.0)
                ),
                6,
            ).alias("usercf_precision"),
        )
    )
    won = F.col("usercf_hits") > 0
    return one.select(
        "evaluated_users",
        "usercf_hits",
        "popularity_hits",
        "usercf_precision",
        ratio("usercf_hits", "evaluated_users", 6).alias("usercf_recall"),
        ratio("popularity_hits", "evaluated_users", 6).alias("popularity_recall"),
        labelled((won, "usercf"), otherwise="popularity_fallback").alias("method"),
        ratio(
            F.when(won, F.col("usercf_hits")).otherwise(F.col("popularity_hits")),
            "evaluated_users",
            6,
        ).alias("hit_rate"),
    )
