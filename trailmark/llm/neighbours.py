"""Approximate nearest neighbours by collision counting.

Every random line has its own sorted array of projections. Around a query's projection a window
grows round by round (virtual rehashing: the width is the only thing that changes, nothing is hashed
again). A vector that falls into the windows of enough lines is verified with the exact measure.

Largest inner product becomes nearest distance by one more dimension that gives all vectors of a
shard the same norm; queries are scaled to norm one.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.common import staged, table

LINES = 64
THRESHOLD = 0.5  # share of lines that must collide
SURE = 1.28  # standard deviations: a neighbour at the last distance is met 9 times out of 10
FIRST, FINE = 0.05, 1.05  # half width of the first window, and the step of the grid of widths
COARSE, NEAR = 8, 4  # grid steps of a round before and after a query has found its k
SHARD, SHARD_BYTES = 32_768, 1 << 26  # vectors indexed together, and bytes of them
BLOCK = 4_096  # queries answered together
BATCH = 128  # queries whose windows are looked up together


def _index(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    norms = np.einsum("ij,ij->i", x, x)
    top = float(np.sqrt(norms.max()))
    lifted = np.concatenate([x, np.sqrt(np.maximum(top * top - norms, 0))[:, None]], 1) / top
    lines = np.random.default_rng(x.shape[1]).normal(size=(lifted.shape[1], LINES))
    places = np.ascontiguousarray((lifted @ lines).T)
    order = np.argsort(places, axis=1)
    return lines, order, np.take_along_axis(places, order, 1), top


def nearest(rows: np.ndarray, x: np.ndarray, qrows: np.ndarray, q: np.ndarray, k: int, ties: np.ndarray):
    """(query row, places in ``x``, scores) of the ``k`` best found for each query, its own row excluded;
    equal scores in order of ``ties``.

    Rounds are coarse until k are verified. Their worst then says how far the windows must go for a
    better one to be met, and rounds stop exactly there; a better k-th found on the way stops them sooner.
    Only what enters the windows in a round is counted, or what is outside where that is less.
    """
    lines, order, places, top = _index(x)
    n = len(rows)
    lengths = np.sqrt(np.einsum("ij,ij->i", q, q))
    at = (q / lengths[:, None]) @ lines[:-1]
    need = int(np.ceil(THRESHOLD * LINES))
    chance = THRESHOLD + SURE * np.sqrt(THRESHOLD * (1 - THRESHOLD) / LINES)
    reach = NormalDist().inv_cdf((1 + chance) / 2)  # window over distance at which that chance holds
    widths = FIRST * FINE ** np.arange(int(np.ceil(np.log(2.01 * reach / FIRST) / np.log(FINE))) + 1)
    for first in range(0, len(q), BATCH):
        here = at[first : first + BATCH, :, None]
        low = np.stack([np.searchsorted(places[j], here[:, j] - widths) for j in range(LINES)], 2).astype(np.int32)
        high = np.stack([np.searchsorted(places[j], here[:, j] + widths) for j in range(LINES)], 2).astype(np.int32)
        for i in range(len(here)):
            query, length, own = q[first + i], lengths[first + i], rows == qrows[first + i]
            count = np.zeros(n, np.int64)
            seen = own.copy()
            found, scores = np.zeros(0, np.int64), np.zeros(0)
            r, a, b, within = 0, low[i, 0], low[i, 0], 0
            while True:
                lo, hi = low[i, r], high[i, r]
                inside = int((hi - lo).sum())
                if inside - within <= n * LINES - inside:
                    parts = [order[j, lo[j] : a[j]] for j in range(LINES)] + [order[j, b[j] : hi[j]] for j in range(LINES)]
                    count += np.bincount(np.concatenate(parts), minlength=n)
                else:  # fewer are outside than enter
                    parts = [order[j, : lo[j]] for j in range(LINES)] + [order[j, hi[j] :] for j in range(LINES)]
                    count = LINES - np.bincount(np.concatenate(parts), minlength=n)
                a, b, within = lo, hi, inside
                new = np.flatnonzero((count >= need) & ~seen)
                seen[new] = True
                found = np.concatenate([found, new])
                scores = np.concatenate([scores, x.take(new, axis=0) @ query])
                last = len(widths) - 1
                if len(found) >= k:
                    worst = np.partition(scores, -k)[-k]
                    far = reach * np.sqrt(max(0.0, 2 - 2 * worst / (top * length)))
                    last = min(last, int(np.searchsorted(widths, far)))
                if r >= last:
                    break
                r = min(last, r + (NEAR if len(found) >= k else COARSE))
            if len(found) < k:  # fewer than k vectors in the shard's windows: verify the rest
                rest = np.flatnonzero(~seen)
                found, scores = np.concatenate([found, rest]), np.concatenate([scores, x[rest] @ query])
            best = np.lexsort((ties[found], -scores))[:k]
            yield qrows[first + i], found[best], scores[best]


def _answer(k: int):
    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"row": [], "query_id": [], "vec_id": [], "score": []}
        if len(vectors) and len(queries):
            # equal scores: by id, rows without one last
            vectors = vectors.sort_values(["id", "row"], na_position="last")
            x = np.stack(vectors["v"].to_numpy()).astype(np.float64)
            q = np.stack(queries["v"].to_numpy()).astype(np.float64)
            ids, qids = vectors["id"].astype("Int64").array, dict(zip(queries["row"], queries["id"]))
            rows, qrows = vectors["row"].to_numpy(), queries["row"].to_numpy()
            for row, near, score in nearest(rows, x, qrows, q, k, np.arange(len(x))):
                out["row"].append(np.full(len(near), row))
                out["query_id"].append(np.full(len(near), qids[row]))
                out["vec_id"].append(ids[near])
                out["score"].append(score)
        if not out["row"]:
            return pd.DataFrame(out)
        done = {c: np.concatenate(v) for c, v in out.items() if c != "vec_id"}
        return pd.DataFrame(done | {"vec_id": pd.concat([pd.Series(v) for v in out["vec_id"]], ignore_index=True)})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of ``vectors`` (vec_id, embedding) with the
    largest inner product found for each row that ``is_query`` marks, itself excluded.

    Every row is a candidate, whether other rows share its id or it has none. Rows of one id that are marked
    are queries of their own, and candidates of one another; their answers carry the same query_id.
    Vectors that are null, empty, zero or hold null or non-finite numbers take no part. Vectors are
    compared only with vectors of their own length. Ties go to the smaller id, rows without an id last; an
    empty table gives no rows. Vectors are indexed in shards and queries answered in blocks, both by a
    hash of the row, so no task grows with the data; each shard sends k rows a query to the last ranking.
    """
    v = F.col("embedding").cast("array<double>")
    sound = (
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    rows = vectors.where(F.col("embedding").isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("id"),
        v.alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    # written once: a row keeps its number whatever is computed again
    rows = staged(rows, "vectors").withColumn("dim", F.size("v"))
    total, size, asked = rows.agg(F.count("*"), F.sum("dim"), F.count_if("q")).first()
    shards = max(1, -(-total // SHARD), -(-(size or 0) * 8 // SHARD_BYTES))
    blocks = max(1, -(-asked // BLOCK))

    def cell(name: str, of: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(of)).cast("int").alias(name)

    def every(name: str, of: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(name)

    left = rows.select("row", "id", "v", "dim", cell("shard", shards, 1), every("block", blocks))
    right = rows.where("q").select("row", "id", "v", "dim", cell("block", blocks, 2), every("shard", shards))
    key = ["dim", "shard", "block"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        _answer(k), "row long, query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for each vector whose id 20 divides, among all other vectors."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
