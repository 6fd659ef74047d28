"""Top pairs and cosine neighbours, exact, without a dense matrix or a row per pair.

Pairs are counted in blocks (``overlap``). ``top_pairs`` wants the n most frequent pairs: a lower bound L on
the n-th count comes from a few popular items, and items with fewer than L buyers cannot be in a top
pair. ``nearest`` wants the k best partners of every item. For the few hottest baskets items are grouped by
which of them they occur in; all items of one group offer the same overlap, so only the k+1 with the
fewest buyers can be anybody's best partners through those baskets alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trailmark.functions.columns import half_up, long
from trailmark.operators.overlap import ASKED, LISTED, LONG, MOST_BITS, bits, bits_of, closest, frequent, overlaps
from trailmark.operators.ranking import with_row_number
from trailmark.session import staged

# Basket rows per slice on the build side of the pair join.
SLICE = 256


def expand_pairs(rows: DataFrame, basket: str, node: list[str], first: str) -> DataFrame:
    """Pairs (a_*, b_*) within a basket with a.first < b.first, counted over baskets.

    The left rows of a basket are hashed over ceil(size / SLICE) slices and the right rows copied to
    each, so the work of one basket is spread and a join group never exceeds SLICE x size.
    """
    sizes = rows.groupBy(basket).agg(F.ceil(F.count("*") / SLICE).alias("_parts"))
    sized = rows.join(sizes, basket)
    left = sized.select(
        basket,
        F.pmod(F.xxhash64(*node), F.col("_parts")).alias("_slice"),
        *[F.col(c).alias(f"a_{c}") for c in node],
    )
    right = sized.select(
        basket,
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_slice"),
        *[F.col(c).alias(f"b_{c}") for c in node],
    )
    joined = left.join(
        right,
        (left[basket] == right[basket])
        & (left["_slice"] == right["_slice"])
        & (F.col(f"a_{first}") < F.col(f"b_{first}")),
    )
    return joined.groupBy(*[f"a_{c}" for c in node], *[f"b_{c}" for c in node]).agg(
        F.count("*").alias("together")
    )


def _largest_baskets(rows: DataFrame, basket: str, above: int, most: int) -> list:
    """Ids of at most ``most`` baskets with more than ``above`` rows, largest first."""
    if most <= 0:
        return []
    big = (
        rows.groupBy(basket)
        .agg(F.count("*").alias("s"))
        .filter(F.col("s") > above)
        .orderBy(F.desc("s"), basket)
        .limit(most)
    )
    return [r[0] for r in big.collect()]


def _numbered(rows: DataFrame, basket: str, large: list) -> DataFrame | None:
    """(u, no) of the largest baskets, a list limited where it was collected."""
    if not large:
        return None
    kind = rows.schema[basket].dataType.simpleString()
    return rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(large)], f"u {kind}, no int")


def top_pairs(
    rows: DataFrame,
    basket: str,
    node: list[str],
    first: str,
    n: int,
    seeds: int = 64,
    large_basket: int = 1000,
    max_large: int = 8,
    **tuning,
) -> DataFrame:
    """The ``n`` pairs that share the most baskets. ``rows`` is distinct on basket and node, and ``first``
    is the first column of ``node``; the two sides of a pair differ in it.

    Ties are ordered by the node columns of a, then b.
    """
    if node[0] != first:
        raise ValueError("first must be the first column of node")
    rows = staged(rows.select(basket, *node), "baskets")
    buyers = staged(rows.groupBy(*node).agg(F.count("*").alias("_buyers")), "buyers")
    popular = buyers.orderBy(F.desc("_buyers"), *node).limit(seeds)
    seed_rows = rows.join(F.broadcast(popular.select(*node)), node, "left_semi")
    best = expand_pairs(seed_rows, basket, node, first).orderBy(F.desc("together")).limit(n)
    found = best.agg(F.count("*").alias("c"), F.min("together").alias("m")).first()
    bound = found["m"] if found["c"] == n else 1

    # numbers in the order of the node columns stand for the nodes; a node's ``n`` is its distance from the
    # first node of the same first column
    kept = buyers.filter(F.col("_buyers") >= bound).select(*node)
    nodes = staged(with_row_number(kept, [F.asc(c) for c in node], "no").select("no", *node), "nodes")
    links = rows.join(nodes, node).select(F.col("no").alias("i"), F.col(basket).alias("u"))
    links = staged(links, "links")
    # a pair that shares only baskets without a list shares fewer than ``bound``
    large = _largest_baskets(links, "u", large_basket, min(max_large, bound - 1))
    behind = F.col("no") - F.min("no").over(Window.partitionBy(first))
    side = (links, nodes.select(F.col("no").alias("i"), behind.alias("n")))
    pairs = overlaps(side, side, frequent(bound, n), _numbered(links, "u", large), later=True, **tuning)
    pairs = pairs.filter((F.col("i") < F.col("j")) & (F.col("i") - F.col("n") != F.col("j") - F.col("nj")))
    counted = pairs.groupBy("i", "j").agg((F.sum("light") + F.max("shared")).alias("together"))
    top = counted.orderBy(F.desc("together"), "i", "j").limit(n)
    for side, no in (("a", "i"), ("b", "j")):
        names = nodes.select(F.col("no").alias(no), *[F.col(c).alias(f"{side}_{c}") for c in node])
        top = names.join(F.broadcast(top), no)  # n rows
    keys = [f"a_{c}" for c in node] + [f"b_{c}" for c in node]
    return top.select(*keys, "together").orderBy(F.desc("together"), *keys).limit(n)


def _closeness():
    return F.col("together") * F.col("together") / F.col("nj")


def nearest(
    left: DataFrame, right: DataFrame, k: int, hot: int = 8, hot_basket: int = 1000, long: int = LONG, **tuning
) -> DataFrame:
    """(i, n, j, nj, together, rank): the ``k`` items of ``right`` nearest to each item of ``left``, by
    together^2 / nj, the square of the cosine but for a factor that is the item's own, then by id. An
    item is not its own neighbour. Both are distinct (i, u).
    """
    both = left is right
    if not isinstance(left.schema["i"].dataType, IntegralType):
        return _nearest_numbered(left, right, k, hot=hot, hot_basket=hot_basket, long=long, **tuning)
    left = staged(left, "left")
    right = left if both else staged(right, "right")
    return _nearest(left, right, None, k, hot, hot_basket, long, tuning)


def nearest_to_part(
    rows: DataFrame, k: int, hot: int = 8, hot_basket: int = 1000, long: int = LONG, **tuning
) -> DataFrame:
    """``nearest`` of the rows with ``asked`` among all of ``rows`` (i, u, asked), distinct on (i, u): a row
    is written and shuffled once, not once for each side."""
    if not isinstance(rows.schema["i"].dataType, IntegralType):
        part, every = rows.where("asked").select("i", "u"), rows.select("i", "u")
        return nearest(part, every, k, hot=hot, hot_basket=hot_basket, long=long, **tuning)
    rows = staged(rows, "rows")
    entries = rows.select("i", "u", F.when(F.col("asked"), LISTED + ASKED).otherwise(LISTED).alias("kind"))
    left, right = rows.where("asked").select("i", "u"), rows.select("i", "u")
    return _nearest(left, right, entries, k, hot, hot_basket, long, tuning)


def _nearest(
    left: DataFrame, right: DataFrame, entries: DataFrame | None, k: int, hot: int, hot_basket: int, long: int, tuning: dict
) -> DataFrame:
    both = left is right
    count = F.count("*").alias("n")
    items = staged(left.groupBy("i").agg(count), "items")
    others = items if both else staged(right.groupBy("i").agg(count), "items")
    large = _numbered(right, "u", _largest_baskets(right, "u", hot_basket, min(hot, MOST_BITS)))
    links = overlaps((left, items), (right, others), closest(k, long), large, entries=entries, **tuning)
    if large is not None:
        links = links.unionByName(_links_in_hot_baskets((left, items), (right, others), large, k))
    counted = links.groupBy("i", "n", "j", "nj").agg((F.sum("light") + F.max("shared")).alias("together"))
    order = Window.partitionBy("i").orderBy(F.desc(_closeness()), F.asc("j"))
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _nearest_numbered(left: DataFrame, right: DataFrame, k: int, **tuning) -> DataFrame:
    """``nearest`` of items that are no whole numbers: by their places in the order of the ids."""
    ids = left.select("i").unionByName(right.select("i")).where("i IS NOT NULL").distinct()
    numbers = staged(with_row_number(ids, [F.asc("i")], "no"), "numbers")
    first = left.join(numbers, "i").select(F.col("no").alias("i"), "u")
    second = first if left is right else right.join(numbers, "i").select(F.col("no").alias("i"), "u")
    found = nearest(first, second, k, **tuning)
    for c in ("i", "j"):
        found = found.withColumnRenamed(c, "no").join(numbers.withColumnRenamed("i", c), "no").drop("no")
    return found.select("i", "n", "j", "nj", "together", "rank")


def cosine(together, n, nj):
    """The cosine of two binary rows, to nine digits."""
    return half_up(F.col(together) / F.sqrt(F.col(n) * F.col(nj).cast("double")), 9)


def cosine_neighbors(rows: DataFrame, item: str, basket: str, k: int, **tuning) -> DataFrame:
    """(item, neighbor, together, similarity, rank_no): the ``k`` most similar items of each item.

    Similarity is the cosine of the binary item x basket rows: together / sqrt(n_item x n_neighbor).
    Partners of one item are ranked by together^2 / n_neighbor, the square of the cosine but for a
    factor they share, both here and where candidates are pruned, so the answer does not depend on
    ``tuning``; equal ones are ordered by the neighbour's id. Only the similarity that is shown is rounded,
    to nine digits. ``rows`` is distinct on (item, basket).
    """
    rows = rows.select(F.col(item).alias("i"), F.col(basket).alias("u"))
    return nearest(rows, rows, k, **tuning).select(
        F.col("i").alias(item),
        F.col("j").alias("neighbor"),
        "together",
        cosine("together", "n", "nj").alias("similarity"),
        long(F.col("rank")).alias("rank_no"),
    )


def _links_in_hot_baskets(left, right, large: DataFrame, k: int) -> DataFrame:
    """Partners through the largest baskets alone, k+1 candidates per group of items in the same ones.

    There are at most 2^hot - 1 groups, so everything between groups is small; only the last join
    (items to the candidates of their group) is as long as the item list.
    """
    (rows, items), (others, other_items) = left, right
    mine = bits(rows, large)
    theirs = mine if rows is others else bits(others, large)
    per_group = Window.partitionBy("rmask").orderBy("nj", "j")
    members = theirs.join(other_items, "i").select(
        F.col("mask").alias("rmask"), F.col("i").alias("j"), F.col("n").alias("nj")
    )
    reps = staged(members.withColumn("_r", F.row_number().over(per_group)).filter(F.col("_r") <= k + 1).drop("_r"), "reps")
    groups = mine.select("mask").distinct()
    shared = (
        groups.select("mask", F.explode(bits_of(F.col("mask"))).alias("_b"))
        .join(reps.select("*", F.explode(bits_of(F.col("rmask"))).alias("_b")), "_b")
        .groupBy("mask", "j", "nj")
        .agg(F.count("*").alias("together"))
    )
    per_mask = Window.partitionBy("mask").orderBy(F.desc(_closeness()), F.asc("j"))
    candidates = (
        shared.withColumn("_r", F.row_number().over(per_mask))
        .filter(F.col("_r") <= k + 1)
        .select("mask", "j", "nj", F.col("together").alias("shared"))
    )
    return (
        mine.join(F.broadcast(candidates), "mask")
        .filter(F.col("i") != F.col("j"))
        .join(items, "i")
        .select("i", "n", "j", "nj", F.lit(0).cast("long").alias("light"), "shared")
    )
