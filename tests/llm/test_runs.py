"""Periodic runs against brute force over all periods, and their edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.llm import registry, runs

SF = "/root/testdata/sf0.001"


def has_period(w, q):
    return all(w[i] == w[i - q] for i in range(q, len(w)))


def brute(words):
    """Every maximal stretch of every period; those whose smallest period is shorter go."""
    out, n = [], len(words)
    for q in range(1, n):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            s, length = i - q, j - i + q
            if length >= max(6, 4 * q) and not any(has_period(words[s:j], d) for d in range(1, q)):
                out.append((s, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def altered(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), max_size=4))
def test_runs_of_few_words(texts):
    assert runs.find_runs(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_nested_repeats(seed):
    rng = random.Random(seed)
    text = [rng.choice("abc") for _ in range(3)]
    while len(text) < 150:
        a = rng.randrange(len(text))
        piece = text[a : a + rng.randint(1, 12)]
        text += piece * rng.randint(1, 7) + [rng.choice("abcd")] * rng.randint(0, 2)
    assert runs.find_runs([text, text[1:], []]) == [brute(text), brute(text[1:]), []]


def test_one_word_fills_a_long_text():
    n = 200_000
    assert runs.find_runs([["a"] * n, ["a", "b"] * n, ["a"] * 5]) == [[(0, n, 1)], [(0, 2 * n, 2)], []]
    words = [str(i) for i in range(30_000)] * 4
    assert runs.find_runs([words]) == [[(0, 120_000, 30_000)]]
    assert runs.find_runs([words[:-1]]) == [[]]


def test_query_matches_brute_force(spark):
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r["doc_id"]: r for r in registry.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows)
    found_any = 0
    for row in rows:
        words = altered(row["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))
        if len(words) > 1500:
            continue  # too long for the brute force; the next loop has them
        found, r = brute(words), got[row["doc_id"]]
        best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        found_any += bool(found)
        assert r["n_runs"] == len(found) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept(words, found)).encode()).hexdigest()
    assert found_any >= 10
    for row in rows:
        words = altered(row["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", row["text"] or ""))
        found = runs.find_runs([words])[0]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert got[row["doc_id"]]["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()


def test_edges(spark):
    loop = "x y " * 4
    rows = [
        (1, None, 7), (2, "", 7), (3, " \t\n", 7), (4, loop, 7), (4, loop, 7), (None, loop + "é", 8),
        (6, "a b " * 6, 9), (7, "w " * 100_000, 9),
    ]  # a no-break space is part of a word
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("a.b", runs.F.lit(1))
    out = runs.periodic_runs(docs.withColumnRenamed("runs", "period"), ["doc_id", "a.b", "period"]).collect()
    by = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out)
    assert by == sorted([
        ("1", [], ""), ("2", [], ""), ("3", [], ""), ("4", [(0, 8, 2)], "x y"), ("4", [(0, 8, 2)], "x y"),
        ("None", [(0, 8, 2)], "x y é"), ("6", [(0, 6, 1)], "a b"), ("7", [(0, 100_000, 1)], "w"),
    ])
    assert {r["a.b"] for r in out} == {1}
    none = runs.run_digests(docs.limit(0), ["doc_id"])
    assert none.count() == 0
    digest = {r["doc_id"]: r for r in runs.run_digests(docs, ["doc_id"]).collect()}
    assert digest[1]["n_runs"] == 0 and digest[1]["start"] is None
    assert digest[1]["runs_sha256"] == digest[1]["collapsed_sha256"] == hashlib.sha256(b"").hexdigest()


def test_planted_ends(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))) for i in range(300)]
    rows += [(None, "a b"), (0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = docs.select("doc_id", "text", runs.planted(runs.F.col("doc_id"), runs.F.col("text")).alias("t")).collect()
    for r in got:
        assert (r["t"] or "").split() == altered(r["doc_id"], (r["text"] or "").split())
