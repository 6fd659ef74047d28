"""Exact retrieval by norm blocks against all products, and against the library's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import recommend, retrieval


def table(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, features array<float>")


def brute(users, items, k):
    u, v = (np.float32(x).astype(np.float64) for x in (users, items))
    out = {}
    for i, scores in enumerate(u @ v.T):
        order = np.lexsort((np.arange(len(scores)), -np.round(scores, 12)))[:k]
        out[i] = [(int(j), round(float(scores[j]), 9)) for j in order]
    return out


@pytest.mark.parametrize("block", [7, 50, 4096])
@pytest.mark.parametrize("kind", ["long tail", "unit", "negative", "few"])
def test_matches_all_products(spark, monkeypatch, kind, block):
    monkeypatch.setattr(retrieval, "USERS", 20)
    rng = np.random.default_rng(1)
    users, items = rng.normal(size=(60, 6)), rng.normal(size=(300, 6))
    if kind == "long tail":
        items *= rng.pareto(1.5, size=(300, 1))
    elif kind == "unit":
        items /= np.linalg.norm(items, axis=1)[:, None]
    elif kind == "negative":
        users, items = -np.abs(users), np.abs(items)
    else:
        items = np.concatenate([items[:3], np.zeros((1, 6)), items[:1]])
    users[0] = 0
    got = {}
    out = retrieval.largest_products(table(spark, users), table(spark, items), 5, block)
    for r in out.orderBy("user", "rank").collect():
        got.setdefault(r["user"], []).append((r["item"], round(r["score"], 9)))
    assert got == brute(users, items, 5)


def test_most_blocks_are_skipped_where_norms_fall(spark):
    rng = np.random.default_rng(2)
    items = rng.normal(size=(2000, 8)) * (1 + np.arange(2000))[:, None] ** -0.7
    placed, reach, _ = retrieval.needed_blocks(table(spark, rng.normal(size=(40, 8))), table(spark, items), 5, 100)
    assert placed.select("block").distinct().count() == 20
    assert retrieval.skipped_share(reach, 20) > 0.8


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id int, features array<float>")
    one = table(spark, [[1.0, 2.0]])
    assert retrieval.largest_products(none, one, 3).count() == 0
    assert retrieval.largest_products(one, none, 3).count() == 0


def test_equals_the_librarys_recommendations(spark):
    rng = np.random.default_rng(3)
    rows = [(int(u), int(i), float(1 + (u * i) % 3)) for u in range(40) for i in rng.choice(60, 8, replace=False)]
    model = recommend.als_fit(spark.createDataFrame(rows, "user_idx int, item_idx int, rating float"), maxIter=3)
    ids = [spark.range(n).select(F.col("id").cast("int").alias(f"{s}_idx"), F.col("id").alias(f"{s}_id")) for s, n in (("user", 40), ("item", 60))]
    got = {(r["user_id"], r["rank_no"]): r["score"] for r in recommend.als_recommend(model, *ids, n=5).collect()}
    want = {}
    for r in model.recommendForAllUsers(5).collect():
        want |= {(r["user_idx"], n + 1): x["rating"] for n, x in enumerate(r["recommendations"])}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-4, abs=1e-6) for k in want)
