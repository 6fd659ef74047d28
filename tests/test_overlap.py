"""Block-wise overlaps against brute force: every path of the counting, and baskets of thousands."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.operators import overlap, similarity


def baskets_of(rows):
    out = defaultdict(set)
    for i, u in rows:
        out[u].add(i)
    return out


def brute_nearest(left, right, k):
    full = Counter(i for i, _ in right)
    held = baskets_of(right)
    met = defaultdict(Counter)
    for i, u in left:
        for j in held[u]:
            if j != i:
                met[i][j] += 1
    out = set()
    for i, partners in met.items():
        best = sorted(partners, key=lambda j: (-(partners[j] ** 2 / full[j]), j))[:k]
        out |= {(i, j, partners[j], r + 1) for r, j in enumerate(best)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "i long, u long")


def skewed(seed, items=150, users=60):
    rng = random.Random(seed)
    rows = {(i, u) for u in range(4) for i in rng.sample(range(items), rng.randint(items // 3, items))}
    rows |= {(int(items * rng.random() ** 2), u) for u in range(4, users) for _ in range(rng.randint(1, 12))}
    rows |= {(1000 + i, 1) for i in range(30)} | {(2000 + i, u) for i in range(20) for u in (0, 1, 2)}
    return sorted(rows)


PATHS = [
    dict(hot=0),  # all lists counted in whole
    dict(hot=0, long=5),  # nearly all lists are long ones
    dict(hot=0, long=40),
    dict(hot=2, hot_basket=20, long=20),  # bits and long lists
    dict(hot=8, hot_basket=10, long=3),
    dict(hot=0, visits=500),  # baskets with blocks of their own
    dict(hot=0, busy=200, visits=500),  # items counted in parts
    dict(hot=3, hot_basket=20, busy=100, long=10),
]


@pytest.mark.parametrize("tuning", PATHS, ids=str)
def test_nearest_matches_brute_force(spark, tuning):
    rows = skewed(1)
    got = similarity.nearest(frame(spark, rows), frame(spark, rows), 5, **tuning).collect()
    assert {(r["i"], r["j"], r["together"], r["rank"]) for r in got} == brute_nearest(rows, rows, 5)


@pytest.mark.parametrize("tuning", PATHS[:1] + PATHS[3:4] + PATHS[6:], ids=str)
def test_two_sides_match_brute_force(spark, tuning):
    """The left side lacks some purchases, has baskets that the right side lacks, and new items."""
    right = skewed(2)
    left = [x for k, x in enumerate(right) if k % 7] + [(5, 999), (777, 0), (777, 3), (888, 999)]
    got = similarity.nearest(frame(spark, left), frame(spark, right), 4, **tuning).collect()
    assert {(r["i"], r["j"], r["together"], r["rank"]) for r in got} == brute_nearest(left, right, 4)
    own = Counter(i for i, _ in left)
    assert all(r["n"] == own[r["i"]] for r in got)


@pytest.mark.parametrize("tuning", PATHS[:1] + PATHS[3:4] + PATHS[6:], ids=str)
def test_part_of_the_rows_is_asked(spark, tuning):
    """The left side is the rows that are marked; there are no entries of both sides to put together."""
    right = skewed(6)
    left = {x for k, x in enumerate(right) if k % 5}
    rows = spark.createDataFrame([(*x, x in left) for x in right], "i long, u long, asked boolean")
    got = similarity.nearest_to_part(rows, 4, **tuning).collect()
    assert {(r["i"], r["j"], r["together"], r["rank"]) for r in got} == brute_nearest(left, right, 4)
    text = rows.select(F.format_string("%05d", "i").alias("i"), "u", "asked")
    got = similarity.nearest_to_part(text, 4, **tuning).collect()
    assert {(int(r["i"]), int(r["j"]), r["together"], r["rank"]) for r in got} == brute_nearest(left, right, 4)


@pytest.mark.parametrize("tuning", [{}, dict(max_large=2, large_basket=10), dict(busy=100), dict(visits=300)], ids=str)
def test_top_pairs_match_brute_force(spark, tuning):
    rows = skewed(3)
    counts = Counter()
    for held in baskets_of(rows).values():
        s = sorted(held)
        counts.update((a, b) for x, a in enumerate(s) for b in s[x + 1 :] if a // 2 != b // 2)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:20]
    # nodes are (item, category) with two categories to an item
    df = frame(spark, rows).select("u", F.floor(F.col("i") / 2).alias("item"), (F.col("i") % 2).alias("cat"))
    got = similarity.top_pairs(df, "u", ["item", "cat"], "item", 20, seeds=4, **tuning).collect()
    pairs = [((r["a_item"] * 2 + r["a_cat"], r["b_item"] * 2 + r["b_cat"]), r["together"]) for r in got]
    assert pairs == want


def test_fewer_pairs_than_asked(spark):
    got = similarity.top_pairs(frame(spark, [(1, 1), (2, 1), (3, 2)]), "u", ["i"], "i", 5).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1)]
    assert similarity.nearest(frame(spark, [(1, 1)]), frame(spark, [(1, 1)]), 5).count() == 0
    none = spark.createDataFrame([], "i long, u long")
    assert similarity.nearest(none, none, 5).count() == 0
    assert similarity.top_pairs(none, "u", ["i"], "i", 5).count() == 0


def test_ids_may_be_text(spark):
    rows = skewed(4)
    got = similarity.nearest(
        *[frame(spark, rows).select(F.format_string("%05d", "i").alias("i"), F.col("u").cast("string").alias("u"))] * 2, 3
    ).collect()
    assert {(int(r["i"]), int(r["j"]), r["together"], r["rank"]) for r in got} == brute_nearest(rows, rows, 3)


def test_two_hundred_baskets_of_five_thousand(spark):
    """2.5 thousand million pairs: none becomes a row. Items of one basket have the basket's rarest, then
    smallest items as partners; a few are in two baskets."""
    rows = spark.range(200 * 5000).select(F.col("id").alias("i"), F.floor(F.col("id") / 5000).alias("u"))
    rows = rows.unionByName(spark.range(0, 1_000_000, 1000).select(F.col("id").alias("i"), F.lit(199).cast("long").alias("u")))
    rows = rows.distinct()
    out = similarity.nearest(rows, rows, 3, hot=8).where("i % 25000 = 12346").collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r["i"]].append((r["j"], r["together"]))
    assert got == {i: [(5000 * (i // 5000) + d, 1) for d in (1, 2, 3)] for i in range(12346, 1_000_000, 25000)}


@pytest.mark.parametrize("tuning", [dict(), dict(hot=3, hot_basket=20, busy=100)], ids=str)
def test_baskets_may_lie_in_several_packed_rows(spark, tuning):
    """Rows are packed a few at a time, with negative ids among them."""
    rows = [(i - 70, u) for i, u in skewed(5)]
    got = similarity.nearest(frame(spark, rows), frame(spark, rows), 5, held=7, **tuning).collect()
    assert {(r["i"], r["j"], r["together"], r["rank"]) for r in got} == brute_nearest(rows, rows, 5)


def test_lists_travel_packed():
    """A block gets one row for all its lists, with as many bytes a number as the largest one needs."""
    rng = np.random.default_rng(1)
    i = np.concatenate([np.sort(rng.choice(60_000, 40, replace=False)) for _ in range(500)])
    rows = pa.table({
        "u": np.repeat(np.arange(500), 40), "i": i, "nj": np.full(len(i), 30),
        "kind": np.full(len(i), overlap.LISTED + overlap.ASKED), "to_block": i % 10,
    })
    for later, most in ((False, 4), (True, 3)):
        pack, _ = overlap._packing(later, 1 << 20)
        out = pa.Table.from_batches(pack(iter(rows.to_batches())))
        assert sorted(out["to_block"].to_pylist()) == list(range(10))
        sent = sum(overlap._numbers(r["sizes"], r["lists"]).sum() for r in out.to_pylist())
        assert out.nbytes < most * sent + 6 * len(i)
        assert (sent < 0.85 * 500 * 10 * 40) == later


def test_packed_bytes_take_as_many_bits_as_they_need():
    """Small numbers and the high bytes of gaps take less than a byte each; numbers come back as they were."""
    rng = np.random.default_rng(2)
    n, gaps = rng.poisson(40, 30_000), rng.geometric(1 / 180_000, 30_000)
    for values, most in ((n, 0.75), (gaps, 2.8), (np.zeros(30_000, int), 0.0), (np.full(30_000, 7), 0.01)):
        planes = overlap._planes(values)
        assert len(planes) <= most * len(values)
        assert (overlap._numbers(planes, len(values)) == values).all()
    mixed = np.array([0, -1, 5, np.iinfo(np.int64).min, np.iinfo(np.int64).max])
    assert (overlap._numbers(overlap._planes(mixed), 5) == mixed).all()
    assert overlap._planes(mixed[:0]) == b"" and len(overlap._numbers(b"", 0)) == 0


def test_lists_go_to_few_blocks(spark):
    """A list is sent to the blocks of the items it is the largest of, not to all blocks."""
    rows = frame(spark, [(i, i // 500) for i in range(5000)])
    items = rows.groupBy("i").agg(F.count("*").alias("n"))

    def work(block, lists, own, n, mask):
        assert len(block.baskets) == 1
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)

    overlap.overlaps((rows, items), (rows, items), work, visits=100_000).collect()
