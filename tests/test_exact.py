"""The scalable algorithms against brute force, and independence of the partitioning."""

import datetime
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmark.operators import hotkeys, overlap, ranking, recommend, similarity


@pytest.fixture(scope="module")
def baskets(spark):
    """Skewed baskets: three users hold a large share of the items."""
    rng = random.Random(7)
    rows = set()
    for u in range(3):
        for i in rng.sample(range(200), 120 - 20 * u):
            rows.add((u, i))
    for u in range(3, 80):
        for _ in range(rng.randint(1, 9)):
            rows.add((u, int(200 * rng.random() ** 2)))
    return sorted(rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long")


def brute_pairs(rows):
    by_user = defaultdict(list)
    for u, i in rows:
        by_user[u].append(i)
    return Counter(p for items in by_user.values() for p in itertools.combinations(sorted(items), 2))


@pytest.mark.parametrize("large_basket,seeds", [(10, 64), (1000, 64), (5, 4), (10, 2)])
def test_top_pairs(spark, baskets, large_basket, seeds):
    counts = brute_pairs(baskets)
    want = sorted(((p, c) for p, c in counts.items()), key=lambda x: (-x[1], x[0]))[:15]
    got = similarity.top_pairs(
        frame(spark, baskets), "user_id", ["item_id"], "item_id", 15, seeds=seeds, large_basket=large_basket
    ).collect()
    assert [((r["a_item_id"], r["b_item_id"]), r["together"]) for r in got] == want


def test_pairs_are_counted_over_slices(spark, baskets, monkeypatch):
    monkeypatch.setattr(similarity, "SLICE", 7)
    got = similarity.expand_pairs(frame(spark, baskets), "user_id", ["item_id"], "item_id").collect()
    assert {(r["a_item_id"], r["b_item_id"]): r["together"] for r in got} == dict(brute_pairs(baskets))


def brute_neighbors(rows, k):
    n = Counter(i for _, i in rows)
    together = brute_pairs(rows)
    links = defaultdict(list)
    for (a, b), c in together.items():
        sim = math.floor(c / math.sqrt(n[a] * float(n[b])) * 1e9 + 0.5)
        links[a].append((-sim, b, c))
        links[b].append((-sim, a, c))
    return {i: [(b, c) for _, b, c in sorted(v)[:k]] for i, v in links.items()}, n, together


@pytest.mark.parametrize("hot,hot_basket", [(8, 30), (2, 30), (8, 5), (0, 1000)])
def test_cosine_neighbors(spark, baskets, hot, hot_basket):
    want, n, _ = brute_neighbors(baskets, 6)
    got = defaultdict(list)
    rows = similarity.cosine_neighbors(
        frame(spark, baskets), "item_id", "user_id", 6, hot=hot, hot_basket=hot_basket
    ).orderBy("item_id", "rank_no").collect()
    for r in rows:
        got[r["item_id"]].append((r["neighbor"], r["together"]))
        assert r["similarity"] == pytest.approx(r["together"] / math.sqrt(n[r["item_id"]] * n[r["neighbor"]]), abs=1e-8)
    assert dict(got) == want


@pytest.mark.parametrize("depth,hot_basket", [(2, 30), (20, 1000), (64, 1000)])
def test_item_cf_recommend(spark, baskets, depth, hot_basket):
    _, n, together = brute_neighbors(baskets, 1)
    owned = defaultdict(set)
    for u, i in baskets:
        owned[u].add(i)
    sim = defaultdict(dict)
    for (a, b), c in together.items():
        sim[a][b] = sim[b][a] = math.floor(c / math.sqrt(n[a] * float(n[b])) * 1e9 + 0.5) / 1e9
    want = set()
    for u, items in owned.items():
        score = defaultdict(float)
        for i in items:
            for j, s in sim[i].items():
                if j not in items:
                    score[j] = max(score[j], s)
        for rank, (j, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]):
            want.add((u, j, s, rank + 1))
    df = frame(spark, baskets)
    got = recommend.item_cf_recommend(df, df, k=5, depth=depth, hot_basket=hot_basket)
    assert {(r["user_id"], r["item_id"], r["score"], r["rank_no"]) for r in got.collect()} == want


@pytest.mark.parametrize("head", [10, 16, 1024])
def test_popularity(spark, baskets, head):
    ratings = [(u, i, 1 + (u * i) % 3) for u, i in baskets]
    # one user owns almost everything that is popular
    pop = Counter()
    for _, i, r in ratings:
        pop[i] += r
    collector = [(999, i, 1) for i, _ in sorted(pop.items(), key=lambda x: (-x[1], x[0]))[:90]]
    ratings += collector
    pop = Counter()
    for _, i, r in ratings:
        pop[i] += r
    order = [i for i, _ in sorted(pop.items(), key=lambda x: (-x[1], x[0]))]
    owned = defaultdict(set)
    for u, i, _ in ratings:
        owned[u].add(i)
    want = set()
    for u, items in owned.items():
        for rank, i in enumerate([i for i in order if i not in items][:5]):
            want.add((u, i, pop[i], rank + 1))
    df = spark.createDataFrame(ratings, "user_id long, item_id long, rating long")
    got = recommend.popularity_recommend(df, k=5, head=head)
    assert {tuple(r) for r in got.select("user_id", "item_id", "popularity", "rank_no").collect()} == want


def test_factor_neighbors(spark, monkeypatch):
    monkeypatch.setattr(recommend, "CELL_SLICE", 16)
    rng = np.random.default_rng(3)
    vecs = np.abs(rng.normal(size=(150, 4)))
    vecs[10] = 0.0
    vecs[20:40] = vecs[20]
    df = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "id int, features array<float>"
    )
    got = defaultdict(list)
    for r in recommend.factor_neighbors(df, n=5, max_cells=9).orderBy("id", "rank_no").collect():
        got[r["id"]].append(r["similarity"])
    unit = vecs.astype("float32").astype(float)
    keep = [i for i in range(150) if i != 10]
    unit = unit[keep] / np.linalg.norm(unit[keep], axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    assert got.pop(10) == [None]  # a zero vector keeps its row
    assert sorted(got) == keep
    for row, i in enumerate(keep):
        assert got[i] == pytest.approx(sorted(sims[row], reverse=True)[:5], abs=1e-9)


@pytest.mark.parametrize("n", [3, 5, 1003])
@pytest.mark.parametrize("parts", [1, 7])
def test_ntiles_equal_the_window(spark, n, parts):
    rng = random.Random(n)
    rows = [(i, rng.choice([0, 0, 1, 2, rng.randint(0, 50)]), rng.random()) for i in range(n)]
    df = spark.createDataFrame(rows, "user_id long, a long, b double")
    got = ranking.with_ntiles(
        df.repartition(parts), "user_id", {"x": ("a", False, 5), "y": ("b", True, 10)}
    )
    want = df.select(
        "user_id", "a", "b",
        F.ntile(5).over(Window.orderBy("a", "user_id")).cast("long").alias("x"),
        F.ntile(10).over(Window.orderBy(F.desc("b"), "user_id")).cast("long").alias("y"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_row_number_and_running_sums(spark):
    rows = [(i, (i * 37) % 11, i % 5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, a long, v long").repartition(5)
    order = [F.desc("a"), F.asc("id")]
    got = ranking.with_row_number(df, order, "rn")
    want = df.withColumn("rn", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sums = ranking.running_sums(df, order, {"s": "v"})
    want = df.withColumn("s", F.sum("v").over(Window.orderBy(*order)))
    assert sorted(map(tuple, sums.collect())) == sorted(map(tuple, want.collect()))


def test_interpolated_quantiles(spark):
    values = [3, 3, 3, 9, 12, 12, 40, 41, 41, 100, 250]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = tuple(ranking.interpolated_quantiles(df, "v", [0.2, 0.4, 0.6, 0.8]).first())
    assert got == pytest.approx(tuple(np.quantile(values, [0.2, 0.4, 0.6, 0.8])))


def test_join_spread(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 == 0 else i) for i in range(300)], "id long, k long")
    lookup = spark.createDataFrame([(k, str(k)) for k in range(0, 300, 2)] + [(1, "x"), (1, "y")], "k long, t string")
    want = sorted(map(tuple, rows.join(lookup, "k").select("id", "k", "t").collect()))
    assert sorted(map(tuple, hotkeys.join_spread(rows, lookup, "k", hot=4).select("id", "k", "t").collect())) == want


RING = [(u, i) for u in range(5) for i in (u, (u + 1) % 5)]


def test_leave_one_out_hides_the_purchase(spark):
    """On a ring nobody's remaining purchase leads to the hidden one by the nearest user alone."""
    day = datetime.date(2024, 1, 1)
    rows = [(u, i, 1, "buy", day + datetime.timedelta(days=i)) for u, i in RING]
    ub = spark.createDataFrame(rows, "user_id long, item_id long, category_id long, behavior_type string, date date")
    got = recommend.leave_one_out_eval(ub, k=10, neighbors=1).first()
    assert got["evaluated_users"] == 5 and got["usercf_hits"] == 0


def test_leave_one_out_writes_purchases_once_a_user(spark, monkeypatch):
    """Purchases, training rows and hidden items are one table: none is written or shuffled to be told apart.
    A purchase counts at its last date; of equal dates the larger item is hidden, of one purchase none."""
    names = []
    for module in (recommend, similarity, overlap):
        monkeypatch.setattr(module, "staged", lambda df, name, f=module.staged: names.append(name) or f(df, name))
    day = datetime.date(2024, 1, 1)
    # user 1's last purchase is item 3, bought again; user 4 has one purchase, user 5 none with a date
    buys = [(1, 3, 0), (1, 1, 4), (1, 2, 4), (1, 3, 5), (2, 1, 0), (2, 2, 0), (2, 3, 1), (3, 1, 9), (3, 3, 9), (4, 3, 1)]
    rows = [(u, i, 1, "buy", day + datetime.timedelta(days=d)) for u, i, d in buys]
    rows += [(5, 1, 1, "buy", None), (5, 2, 1, "buy", None), (None, 1, 1, "buy", day), (1, None, 1, "buy", day)]
    ub = spark.createDataFrame(rows, "user_id long, item_id long, category_id long, behavior_type string, date date")
    baskets = recommend._with_hidden(recommend.active_matrix(ub, 1, last="date"))
    assert {r["user_id"]: (sorted(r["items"]), r["hidden"]) for r in baskets.collect()} == {
        1: ([1, 2, 3], 3), 2: ([1, 2, 3], 3), 3: ([1, 3], 3), 4: ([3], None), 5: ([1, 2], 2)
    }
    names.clear()
    assert recommend.leave_one_out_eval(ub, min_cnt=1).first()["evaluated_users"] == 4
    assert not {"left", "right", "entries", "lists"} & set(names) and names.count("baskets") == 1


def test_neighbours_do_not_depend_on_the_switch(spark):
    """Partners with nearly equal buyer counts, met in one basket that is hot or not."""
    n = {1: 3001, 2: 3000, 3: 3000, 4: 3000}
    rows = [(i, -1) for i in n] + [(i, 10_000 * i + b) for i, c in n.items() for b in range(c - 1)]
    df = spark.createDataFrame(rows, "item_id long, user_id long")
    answers = set()
    for hot, size in ((0, 1000), (1, 1), (8, 2), (8, 1000)):
        out = similarity.cosine_neighbors(df, "item_id", "user_id", 1, hot=hot, hot_basket=size).collect()
        answers.add(tuple(sorted((r["item_id"], r["neighbor"], r["rank_no"]) for r in out)))
    assert answers == {((1, 2, 1), (2, 3, 1), (3, 2, 1), (4, 2, 1))}


def test_zero_factor_keeps_its_row(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 1.0])], "id int, features array<float>")
    got = {r["id"]: r["neighbor"] for r in recommend.factor_neighbors(df, n=1).collect()}
    assert got == {0: 2, 1: None, 2: 0}


def test_similarity_reads_every_row(spark):
    """No cap: all users and items with two or more purchases are in the matrix."""
    rows = [(u, (u + k) % 1200, 1, "buy") for u in range(1200) for k in range(3)]
    ub = spark.createDataFrame(rows, "user_id long, item_id long, category_id long, behavior_type string")
    assert recommend.active_matrix(ub).count() == len(rows)
    assert recommend.active_buyer_ratings(ub).select("user_id").distinct().count() == 1200


def test_neighbour_scores_shuffle_no_row_per_item(spark):
    """Sums over the neighbours' lists, without owned items; equal rounded scores stay side by side."""
    rng = random.Random(6)
    owned = sorted({(u, rng.randrange(40)) for u in range(30) for _ in range(8)})
    near = [(u, v, s) for u in range(30) for v, s in ((v, rng.choice([0.5, 0.250000001, 0.25])) for v in rng.sample(range(30), 4))]
    matrix = spark.createDataFrame(owned, "user_id long, item_id long")
    met = spark.createDataFrame(near, "user_id long, similar_user long, similarity double")
    scores = recommend._neighbor_scores(matrix, met, matrix, 3)
    assert "item_id" not in " ".join(x for x in scores._jdf.queryExecution().toString().splitlines() if "hashpartitioning" in x.split("[")[0])
    lists = defaultdict(set)
    for u, i in owned:
        lists[u].add(i)
    want = defaultdict(lambda: defaultdict(float))
    for u, v, s in near:
        for i in lists[v] - lists[u]:
            want[u][i] += s
    want = {(u, i, x + 1) for u, c in want.items() for x, i in enumerate(sorted(c, key=lambda i: (-round(c[i], 6), i))[:3])}
    got = recommend._top_per_user(scores, 3).collect()
    assert {(r["user_id"], r["item_id"], r["rank_no"]) for r in got} == want
