"""The training-data operators against brute force, and their defined results on edge cases."""

import hashlib
import random
import re
import string
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import compare, connect
from trailmark.llm import (
    bpe, common, exact_dedup, licenses, lmscore, mixing, neighbours, quality, registry, simhash, substrings, toxicity,
)
from trailmark.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row int, digest string, ab int"
RNG = random.Random(5)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(n))


SHARED = prose(70, 1)
EDGE = [
    (1, "Hello World", "en", "a", 1, 0.1, 1, "x", 1),
    (2, "hello world", "en", "a", 1, 0.1, 1, "x", 1),
    (3, "HELLO WÖRLD", None, None, None, None, None, None, None),
    (4, "hello wörld", "de", "b", 1, 0.1, 1, "x", 1),
    (5, None, "de", "b", 1, 0.1, 1, "x", 1),
    (6, "", "de", "b", 1, 0.1, 1, "x", 1),
    (6, "", "de", "b", 1, 0.1, 1, "x", 1),
    (None, "no id", "de", "b", 1, 0.1, 1, "x", 1),
    (8, " \t\n", "de", "b", 1, 0.1, 1, "x", 1),
    (9, prose(20_000, 2), "en", "a", 1, 0.1, 1, "x", 1),
    (10, prose(30, 3) + " " + SHARED + " " + prose(30, 4), "en", "a", 1, 0.1, 1, "x", 1),
    (11, prose(45, 5) + " " + SHARED + " " + prose(12, 6), "en", "c", 1, 0.1, 1, "x", 1),
    (12, "Released under the MIT License. cc by mit\nlicense", "en", "c", 1, 0.1, 1, "x", 1),
    (13, "日本語 🙂 it's 2²   end", "ja", "c", 1, 0.1, 1, "x", 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumnRenamed("ab", "a.b").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA).withColumnRenamed("ab", "a.b")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 14)], "doc_id long, quality int, toxic int")


def least_reachable(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- exact dedup ----------------------------------------------------------------------------------


def test_exact_dedup_matches_sql(spark):
    con = connect(SF)
    assert compare(registry.QUERIES["op10_exact_dedup"](spark, SF), con, registry.CHECKS["op10_exact_dedup"]) == []


def test_exact_dedup_broadcasts_no_documents(spark, monkeypatch):
    """Digests and groups are as many as documents: no join broadcasts them, however small their files."""
    docs = spark.createDataFrame([(i, f"text {i % 70}") for i in range(100)], "doc_id long, text string")
    seen = []
    stage = exact_dedup.staged
    monkeypatch.setattr(exact_dedup, "staged", lambda df, name: seen.append((name, joins_of(df))) or stage(df, name))
    assert exact_dedup.exact_dedup(docs, exact_dedup.by_hash()).where("kept").count() == 70
    met = {kind for name, joins in seen if name in ("groups", "members", "suspects", "collisions") for kind, _ in joins}
    assert met == {"SortMergeJoin"}


def test_exact_dedup_edges(edge, none):
    got = exact_dedup.exact_dedup(edge, exact_dedup.by_hash(3)).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["keep_id"], by[1]["kept"], by[2]["kept"]) == (2, False, True)
    assert by[3]["keep_id"] == 3 and by[4]["keep_id"] == 4  # Ö is not lowered
    assert by[5]["keep_id"] == 6 and by[5]["group_size"] == 3
    assert sorted(r["kept"] for r in got if r["doc_id"] == 6) == [False, True]
    assert by[None]["kept"]
    assert exact_dedup.exact_dedup(none, F.lit(0)).count() == 0


def test_exact_dedup_survives_colliding_digests(edge):
    """A digest of one bit: only the byte check tells texts apart."""
    weak = lambda t: hashlib.sha256(t).digest()[:1] if len(t) > 5 else b"\0"
    got = exact_dedup.exact_dedup(edge, exact_dedup.by_hash(2), weak).collect()
    want = exact_dedup.exact_dedup(edge, F.lit(0)).collect()
    plain = lambda rows: sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in rows)
    one = lambda t: b"\0"
    assert plain(got) == plain(want)
    assert plain(exact_dedup.exact_dedup(edge, F.lit(0), one).collect()) == plain(want)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 20_000])
def test_fuse_filter(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64)
    made = exact_dedup.build_fuse(keys)
    assert exact_dedup.in_fuse(keys, *made).all()
    other = np.random.default_rng(n + 1).integers(0, 1 << 63, 50_000).astype(np.uint64)
    assert exact_dedup.in_fuse(other, *made).mean() < 0.008


# --- SimHash --------------------------------------------------------------------------------------


def near(prints, distance=simhash.DISTANCE):
    v = np.array(prints, dtype=np.int64).view(np.uint64)
    d = np.bitwise_count(v[:, None] ^ v[None]) <= distance
    return [(i, j) for i, j in zip(*np.nonzero(d)) if i < j]


def test_simhash_matches_brute_force(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    ids = sorted(docs)
    prints = [simhash.fingerprint(docs[i].encode()) for i in ids]
    want = least_reachable(ids, [(ids[i], ids[j]) for i, j in near(prints)])
    got = registry.QUERIES["op3_simhash_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == {i: p % (1 << 64) for i, p in zip(ids, prints)}


def test_fingerprint_uses_the_session_hash(spark):
    one = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert simhash.fingerprint(b"A  b\tc") == one
    assert simhash.fingerprint(b"") == 0 and simhash.fingerprint(b" \n") == 0


@pytest.mark.parametrize("bucket", [256, 2])
def test_links_with_crowded_buckets(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    base = rng.integers(-(1 << 62), 1 << 62, 20)
    prints = sorted({int(b) ^ int(np.bitwise_or.reduce(1 << rng.integers(0, 62, rng.integers(0, 5)), initial=0)) for b in np.repeat(base, 20)})
    got = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    assert {frozenset(r) for r in got} == {frozenset((prints[i], prints[j])) for i, j in near(prints)}


def joins_of(df):
    """The join operators of the plan of ``df`` as it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.findall(r"(\w+Join)\b.*?(Inner|LeftOuter|LeftAnti|LeftSemi)", plan)


@pytest.mark.parametrize("bucket", [256, 4])
def test_links_broadcast_no_explode(spark, monkeypatch, tmp_path, bucket):
    """Small files explode to 34 probes a fingerprint: they are not broadcast, whatever Spark takes their size for."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    prints = {(rng.randrange(1 << 20) << 32) | rng.randrange(40) for _ in range(400)}
    spark.createDataFrame([(p,) for p in prints], "fp long").write.parquet(str(tmp_path / "prints"))
    met = joins_of(simhash.links(spark.read.parquet(str(tmp_path / "prints"))))
    assert ("SortMergeJoin", "Inner") in met and ("BroadcastHashJoin", "Inner") not in met


def test_simhash_edges(edge, none):
    got = {r["doc_id"]: r for r in simhash.simhash_dedup(edge).collect()}
    assert got[5]["component_id"] == got[6]["component_id"] == got[8]["component_id"] == 5
    assert got[1]["component_id"] == got[2]["component_id"] == 1 and got[4]["component_id"] == 4
    assert simhash.simhash_dedup(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r["id"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- classifiers ----------------------------------------------------------------------------------


def test_toxicity_learns_and_meets_misspellings():
    rng = random.Random(1)
    common = prose(400, 100).split()
    talk = lambda n: " ".join(rng.choices(common, k=n))
    insults = ["blockhead", "blockheads", "nincompoop"]
    clean = [talk(rng.randint(5, 60)) for _ in range(150)]
    toxic = [f"{talk(15)} {rng.choice(insults)} {talk(15)}" for _ in range(100)]
    model = toxicity.fit([t.encode() for t in clean + toxic], np.array([0] * 150 + [1] * 100))
    s = model.scores([b"what a blokhead", b"a nincompoopp here", talk(40).encode(), b""])
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.5 and s[3] < 0.5


def test_classifier_queries(spark):
    for name in ("op1_toxicity", "op4_quality"):
        got = registry.QUERIES[name](spark, SF)
        assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
        rows = got.collect()
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_classifier_edges(edge, none, labels):
    for docs, marks in ((edge, labels), (edge, labels.limit(0)), (none, labels)):
        assert toxicity.score(docs, toxicity.train(docs, marks), ["doc_id"]).count() == docs.count()
        assert quality.score(docs, quality.train(docs, marks), ["doc_id"]).count() == docs.count()


def test_classifiers_keep_the_odds_of_all_labels(spark):
    """Equal texts tell nothing, so scores are the share of the label whatever the sample's ratio is."""
    docs = spark.createDataFrame([(i, "the same few words") for i in range(2000)], "doc_id long, text string")
    marks = docs.select("doc_id", (F.col("doc_id") % 20 == 0).cast("int").alias("toxic")).withColumn("quality", F.col("toxic"))
    share = marks.where(~common.held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    for module in (toxicity, quality):
        for rows in ({0: 30, 1: 30}, {0: 200, 1: 40}, {0: 5000, 1: 5000}):
            model = module.train(docs, marks, rows)
            got = module.score(docs, model, ["doc_id"]).first()["score"]
            assert got == pytest.approx(share, abs=2e-3), (module.__name__, rows)


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0) & (x[:, 3] < 0.5)).astype(float)
    rules, bias = quality.fit(x, y)
    want = 1 / (1 + np.exp(-(bias + sum(w * quality._holds(x, r) for r, w in rules))))
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], quality.STATISTICS)
    got = frame.select(quality.compiled((rules, bias)).alias("s")).toPandas()["s"]
    assert np.allclose(got, want) and ((want > 0.5) == (y == 1)).mean() > 0.95


# --- neighbours -----------------------------------------------------------------------------------


def exact_neighbours(rows, k):
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = [(-float(np.dot(v, w)), j) for j, w in rows if j != i]
            out[i] = [j for _, j in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("shard,scaled", [(32_768, False), (130, True)])
def test_neighbours_recall(spark, monkeypatch, shard, scaled):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24))
    x *= rng.uniform(0.2, 3, (600, 1)) if scaled else 1 / np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, list(map(float, v))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = exact_neighbours([(i, np.array(v)) for i, v in rows], 20)
    assert all(len(got[q]) == 20 for q in want)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_neighbours_verify_few_of_clustered_vectors():
    """Recall over several groups, and how much of the shard is verified, by the product's own count."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 32))
    x = centres[rng.integers(0, 200, 8000)] + 0.1 * rng.normal(size=(8000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, 8000, 100)
    hits = 0
    for row, near, _ in neighbours.nearest(np.arange(8000), x, asked, x[asked], 10, np.arange(8000)):
        products = x @ x[row]
        products[row] = -9
        hits += len(set(near) & set(np.argsort(-products)[:10]))
    assert hits >= 0.9 * 10 * len(asked)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]),
            (6, [inf, 1.0]), (7, [None, 1.0]), (8, [2.0, 0.0]), (9, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    # both rows of id 0 are queries, and candidates of one another; the row without an id is a candidate
    each = [(0, 1, 1, 2.0), (0, 2, 8, 2.0), (0, 3, 0, 1.0), (0, 4, None, 1.0), (0, 5, 20, 0.0)]
    last = [(20, 1, None, 1.0), (20, 2, 0, 0.0), (20, 3, 0, 0.0), (20, 4, 1, 0.0), (20, 5, 8, 0.0)]
    assert got == [r for r in each for _ in range(2)] + last
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


# --- mixing ---------------------------------------------------------------------------------------


def test_rake_meets_all_margins(spark):
    rng = random.Random(4)
    rows = [(s, lang, t, rng.randint(1, 900)) for s in "abcd" for lang in ("en", "de") for t in range(3)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    sources = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 0.4)], "source string, share double")
    got = mixing.rake(cells, sources, {"en": 0.7, "de": 0.3}, {0: 0.2, 1: 0.3, 2: 0.5}).toPandas()
    got["w"] = got["tokens"] * got["ratio"] / got["tokens"].sum()
    for column, want in (("source", dict(zip("abcd", (0.1, 0.2, 0.3, 0.4)))), ("lang", {"en": 0.7, "de": 0.3}), ("topic", {0: 0.2, 1: 0.3, 2: 0.5})):
        assert got.groupby(column)["w"].sum().to_dict() == pytest.approx(want, abs=1e-6)


def test_probabilities_keep_the_asked_share(spark):
    cells = spark.createDataFrame([("a", "x", 0, 900, 0.3), ("b", "x", 0, 100, 7.3)], "source string, lang string, topic int, tokens long, ratio double")
    got = mixing.probabilities(cells, 0.5).toPandas()
    assert (got["tokens"] * got["probability"]).sum() == pytest.approx(500, rel=1e-2) and got["probability"].max() <= 1


def test_mixing_edges(spark, edge, none):
    rows = mixing.with_topics(edge, ["doc_id", "source", "lang"])
    cells = mixing.probabilities(mixing.rake(mixing.cells_of(rows)))
    got = mixing.sampled(rows, cells).collect()
    assert len(got) == len(EDGE) and all(0 <= r["mix__probability"] <= 1 for r in got)
    rows = mixing.with_topics(none, ["doc_id", "source", "lang"])
    assert mixing.sampled(rows, mixing.probabilities(mixing.rake(mixing.cells_of(rows)))).count() == 0


@pytest.mark.parametrize("wanted", [None, {"a": 0.5, "b": 0.5}])
def test_mix_meets_targets_above_a_cells_tokens(spark, tmp_path, monkeypatch, wanted):
    """Two sources of 90 and 10 %: the small one's target is more than a sample of 80 % can hold."""
    rows = [(i, prose(20, i), "en", "b" if i % 10 == 0 else "a") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    if wanted is None:
        norm = 0.9**mixing.TEMPER + 0.1**mixing.TEMPER
        targets, aims = None, {"a": 0.9**mixing.TEMPER / norm, "b": 0.1**mixing.TEMPER / norm}
    else:
        targets, aims = spark.createDataFrame(list(wanted.items()), "source string, share double"), wanted
    rake = mixing.rake
    monkeypatch.setattr(mixing, "rake", lambda cells: rake(cells, targets))
    got = registry.QUERIES["op5_mix_sources"](spark, str(tmp_path)).toPandas()
    mass = got["n_tokens"] * got["copies"]
    assert mass.sum() == pytest.approx(mixing.KEPT * got["n_tokens"].sum(), rel=1e-9)
    assert (mass.groupby(got["source"]).sum() / mass.sum()).to_dict() == pytest.approx(aims, abs=1e-6)
    topics = got.groupby("topic")["n_tokens"].sum() ** mixing.TEMPER
    assert (mass.groupby(got["topic"]).sum() / mass.sum()).to_dict() == pytest.approx((topics / topics.sum()).to_dict(), abs=1e-6)
    taken = got["n_tokens"] * got["repeats"]
    assert (taken.groupby(got["source"]).sum() / taken.sum()).to_dict() == pytest.approx(aims, abs=0.03)
    assert (got["kept"] == (got["repeats"] > 0)).all() and got["probability"].max() <= 1
    mixed = corpus_pipeline.mix(spark, docs, "").toPandas()
    assert mixed["doc_id"].value_counts().to_dict() == got[got["kept"]].set_index("doc_id")["repeats"].to_dict()


def test_realised_shares(spark):
    rows = [("a", "en", 0, 10, 2), ("a", None, 1, 10, 0), ("b", None, 1, 5, 4)]
    taken = spark.createDataFrame(rows, "source string, lang string, mix__topic int, mix__tokens long, mix__repeats long")
    got = {(r["margin"], r["value"]): r["share"] for r in mixing.realised(taken).collect()}
    assert got == {("source", "a"): 0.5, ("source", "b"): 0.5, ("lang", "en"): 0.5, ("lang", "(none)"): 0.5,
                   ("topic", "0"): 0.5, ("topic", "1"): 0.5}


def test_token_counts():
    got = mixing.topics([b"", b" a  bb\nc ", "é ü".encode(), b"x" * 200])
    assert got["mix__tokens"].tolist() == [0, 3, 2, 1]


# --- licenses -------------------------------------------------------------------------------------


def test_scanner_finds_every_block_over_the_threshold():
    rng = random.Random(6)
    vocabulary = [w for _, t in licenses.TEMPLATES for w in t.split()] + prose(40, 7).split()
    counts = {w.encode(): rng.randint(0, 50) for w in vocabulary}
    scanner = licenses.Scanner(licenses.TEMPLATES, counts, 0.8)
    for seed in range(40):
        words = [rng.choice(vocabulary).encode() for _ in range(rng.randint(0, 200))]
        label, text = rng.choice(licenses.TEMPLATES)
        at = rng.randint(0, len(words))
        words[at:at] = text.encode().split()[rng.randint(0, 3):]
        want = set()
        for start in range(0, max(1, len(words)), licenses.STRIDE):
            block = set(words[start : start + licenses.BLOCK])
            for name, template in licenses.TEMPLATES:
                tokens = set(template.encode().split())
                if len(block & tokens) / len(tokens) >= 0.8:
                    want.add((start, name, len(block & tokens) / len(tokens)))
        assert set(scanner.blocks(words)) == want


def test_license_scan_base(edge, none):
    got = {r["doc_id"]: r for r in licenses.scan(edge, ["doc_id"]).collect()}
    r = got[12]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (9, 3, 3, 7, "cc-by,mit")
    assert got[5]["n_words"] == 0 and got[5]["first_word"] is None and got[5]["labels"] == ""
    assert licenses.scan(none, ["doc_id"]).count() == 0


# --- substrings -----------------------------------------------------------------------------------


def test_repeated_passages_are_found(edge, none):
    got = substrings.repeated_passages(edge).collect()
    assert {r["doc_id"] for r in got} == {10, 11}
    assert {r["doc_id"] for r in got if r["kept"]} == {10}
    for r in got:
        text = next(t for i, t, *_ in EDGE if i == r["doc_id"]).encode()
        assert text[r["start"] : r["start"] + r["n_bytes"]].decode() in SHARED
    cut = {r["doc_id"]: r["text"] for r in substrings.cut_repeats(edge, substrings.repeated_passages(edge)).collect()}
    assert len(cut[11]) < len(EDGE[11][1]) and cut[10] == EDGE[10][1]
    assert substrings.repeated_passages(none).count() == 0


def test_passages_held_piecewise_by_others_are_found(spark):
    """Half of a passage stands in a third document too: both holders of the whole are found, and what one
    document keeps is cut from the others only."""
    rows, trios = [], []
    for i in range(30):
        words, n = prose(60, 700 + i), 3 * i
        trios.append((n, n + 1, n + 2))
        rows.append((n, prose(30, 800 + n) + " " + " ".join(words.split()[:30]) + " " + prose(30, 900 + n)))
        rows += [(n + c, prose(30, 800 + n + c) + " " + words + " " + prose(30, 900 + n + c)) for c in (1, 2)]
    docs = spark.createDataFrame(rows + [(1000 + i, prose(100, 5000 + i)) for i in range(20)], "doc_id long, text string")
    passages = substrings.repeated_passages(docs)
    got = passages.collect()
    assert {i for t in trios for i in t[1:]} <= {r["doc_id"] for r in got} <= {i for t in trios for i in t}
    assert all(r["kept"] == (r["first_doc"] == r["doc_id"]) for r in got)
    cut = {r["doc_id"]: r["text"] for r in substrings.cut_repeats(docs, passages).collect()}
    texts = dict(rows)
    for _, b, c in trios:
        # the second half is kept by the first whole holder alone
        kept = [r for r in got if r["doc_id"] == b and r["kept"]]
        assert kept and all(texts[b].encode()[r["start"] : r["start"] + r["n_bytes"]].decode() in cut[b] for r in kept)
        assert len(cut[b]) < len(texts[b]) and len(cut[c]) < len(texts[c])


def test_passages_of_51_words_are_found(spark):
    rows = [
        (2 * i + c, " ".join((prose(20 + i % 40, 3000 + 2 * i + c), prose(51, 9000 + i), prose(30, 6000 + 2 * i + c))))
        for i in range(200) for c in range(2)
    ]
    clean = [(1000 + i, prose(200, 20_000 + i)) for i in range(30)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string")
    found = {r["doc_id"] for r in substrings.repeated_passages(docs).collect()}
    # both ends lie in chunks that differ: a passage with few cuts inside may stay under MIN_WORDS
    assert len(found & set(range(400))) >= 394 and not found & {i for i, _ in clean}


def test_cuts_do_not_depend_on_neighbours_or_shifts():
    text = prose(400, 8).encode()
    alone = [d for *_, d in substrings.chunks([text])][0]
    shifted = b"".join(d for *_, d in substrings.chunks([b"other", b"inserted words " + text]))
    pieces = lambda d: {d[i : i + 8] for i in range(0, len(d), 8)}
    assert len(pieces(alone) - pieces(shifted)) <= 1
    big = list(substrings.chunks([b"a" * 300_000]))
    assert sum(int(x[2].sum()) for x in big) >= 299_000  # sizes


# --- language models ------------------------------------------------------------------------------


def test_lm_score_prefers_the_target(spark):
    # two kinds of text over different words
    rows = [(i, prose(60, i % 3)) for i in range(40)] + [(100 + i, prose(60, 50 + i % 3)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = lmscore.train(docs, docs.where("doc_id < 100").select("doc_id"), size=300)
    got = {r["doc_id"]: r["score"] for r in lmscore.score(docs, models, ["doc_id"]).collect()}
    assert max(got[i] for i in range(40)) < min(got[100 + i] for i in range(40))


def test_vocabulary_takes_the_most_frequent(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i))) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = lmscore.vocabulary(docs, 16)
    assert len(known) == 16 and {b"w0", b"w1"} <= set(known) and sorted(known.values()) == list(range(2, 18))


def test_lm_edges(edge, none):
    models = lmscore.train(edge, edge.select("doc_id"), size=50)
    got = {r["doc_id"]: r for r in lmscore.score(edge, models, ["doc_id"]).collect()}
    assert got[5]["n_tokens"] == 0 and got[5]["score"] == 0.0
    assert lmscore.score(none, lmscore.train(none, none.select("doc_id"), size=5), ["doc_id"]).count() == 0


def brute_losses(counted, targets, texts, weight=lmscore.WEIGHT):
    """Both losses of ``texts`` by exact counts of ``counted`` (id, text)."""
    split = lambda t: t.lower().split()
    types = len({w for _, t in counted for w in split(t)}) + 1
    sums = {}
    for name, of in (("background", counted), ("target", [r for r in counted if r[0] in targets])):
        steps = [p for _, t in of for p in zip([None, *split(t)], split(t))]
        pairs, contexts, words = Counter(steps), Counter(a for a, _ in steps), Counter(b for _, b in steps)
        sums[name] = lambda t, pairs=pairs, contexts=contexts, words=words, total=len(steps): -sum(
            np.log((pairs[p] + weight * (words[p[1]] + 1) / (total + types)) / (contexts[p[0]] + weight))
            for p in zip([None, *split(t)], split(t))
        ) / max(1, len(split(t)))
    return [(sums["background"](t), sums["target"](t)) for t in texts]


@pytest.mark.parametrize("busy", [1, 1 << 9, 1 << 17])
def test_lm_counts_every_word_and_bigram(spark, monkeypatch, busy):
    """More words and bigrams than the lists of fixed size once held; busy keys change nothing."""
    monkeypatch.setattr(lmscore, "BUSY", busy)
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(60_000) if rng.random() < 0.8 else rng.randrange(4)}" for _ in range(500))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    models = lmscore.train(docs, docs.where("doc_id < 60").select("doc_id"))
    other = [(1, "w1 w2 never seen w59999"), (None, "w3"), (None, None)]
    more = spark.createDataFrame(other, "doc_id long, text string")
    for frame, given in ((docs, rows), (more, other)):
        got = lmscore.score(frame, models, ["doc_id", "text"]).collect()
        want = brute_losses(rows, set(range(60)), [t or "" for _, t in given])
        assert len(got) == len(given)
        by = {r["text"]: (r["loss_background"], r["loss_target"]) for r in got}
        assert all(by[t] == pytest.approx(w, abs=1e-9) for (_, t), w in zip(given, want))


@pytest.mark.parametrize("kind", ["packed", "joined", "text"])
def test_lm_target_ids(spark, monkeypatch, kind):
    """Target ids sent to all tasks, or joined as there are too many or they are no numbers; texts in several
    flushes and buckets; repeated and missing ids."""
    monkeypatch.setattr(lmscore, "TARGET_IDS", 0 if kind == "joined" else 1 << 23)
    monkeypatch.setattr(lmscore, "FLUSH", 500)
    rng = random.Random(4)
    rows = [(i // 2 if i % 7 else None, " ".join(f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(rng.randrange(90)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if kind == "text":
        docs = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id")))
    good = docs.where("right(doc_id, 1) in ('1', '3')").select("doc_id")
    targets = {i for i in range(60) if i % 10 in (1, 3)}
    got = lmscore.score(docs, lmscore.train(docs, good.unionByName(good)), ["text"]).collect()
    want = {t: w for (_, t), w in zip(rows, brute_losses(rows, targets, [t for _, t in rows]))}
    assert sorted(r["text"] for r in got) == sorted(t for _, t in rows)
    assert all((r["loss_background"], r["loss_target"]) == pytest.approx(want[r["text"]], abs=1e-9) for r in got)


@pytest.mark.parametrize("top", [3, 1 << 20, 1 << 40])  # the last does not fit one number with the others
def test_lm_orders_by_one_number(top):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 40, 5000), rng.integers(0, top, 5000)
    assert lmscore._order(a, b).tolist() == np.lexsort((b, a)).tolist()
    assert lmscore._order(a[:0], b[:0]).tolist() == []


def test_lm_numbers_words_once_for_all_flushes(monkeypatch):
    monkeypatch.setattr(lmscore, "FLUSH", 4)
    hashed = []
    real = lmscore._hash
    monkeypatch.setattr(lmscore, "_hash", lambda w: hashed.append(w) or real(w))
    batch = pa.RecordBatch.from_pydict({"lm__mark": pa.array([1, None], pa.int64())})
    texts = [[b"a B a", b"b c"], [b"", b"c a"], [b"B", b"x"]]
    for known, start in ((None, ["a", "b", "c", "x"]), (frozenset([b"a", b"b"]), ["a", "b"])):
        hashed.clear()
        got = list(lmscore._flushes(((batch, t) for t in texts), known, lmscore._packed(np.array([1]))))
        assert [w.decode() for w in hashed] == start
        words = [real(w) if known is None or w in known else lmscore.OTHER for t in texts for x in t for w in x.lower().split()]
        assert np.concatenate([h[w] for _, h, _, w, _, _ in got]).tolist() == words
        befores = np.concatenate([h[b] for _, h, b, _, _, _ in got])
        assert (befores == lmscore.START).tolist() == [True, False, False, True, False, True, False, True, True]
        assert np.concatenate([t for *_, t in got]).tolist() == [True] * 3 + [False] * 4 + [True, False]


def test_lm_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    docs = [(i, (t or "").encode()) for i, t in docs]  # words are split and lowered as bytes
    good = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{SF}/labels.parquet' WHERE quality = 1").fetchall()}
    want = dict(zip([i for i, _ in docs], brute_losses(docs, good, [t for _, t in docs])))
    got = registry.QUERIES["op8_lm_score"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r["loss_background"], r["loss_target"]) == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert r["score"] == r["loss_target"] - r["loss_background"]


# --- byte-level BPE -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coders():
    ours = bpe.encoder(bpe.vocabulary())
    return ours, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


def test_bpe_equals_the_library(coders):
    ours, theirs = coders
    parts = ["a", "the", "ing", "é", "ß", "日本", "'s", "'ll", " ", "\n", "  ", "\t", "0", "²", "Ⅷ", " ", "\x1c", "_",
             "#", "🙂", "अ", "<|endoftext|>", "ɏ", "×", "Ж"]
    for _ in range(4000):
        text = "".join(RNG.choice(parts) for _ in range(RNG.randint(0, 25)))
        assert ours.encode(text) == theirs.encode_ordinary(text), text
        assert ours.decode(ours.encode(text)) == text.encode()
    for text in ("a" * 30_000, "ab" * 5000, "the" * 4000, "!" * 9000):
        assert ours.encode(text) == theirs.encode_ordinary(text)


def test_bpe_query(spark, coders):
    _, theirs = coders
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    for r in registry.QUERIES["op9_byte_bpe"](spark, SF).collect():
        ids = theirs.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_bpe_edges(edge, none):
    path = bpe.vocabulary()
    got = bpe.decode(bpe.encode(edge, ["doc_id", "text"], path), path).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in got) and len(got) == len(EDGE)
    assert bpe.encode_digests(none, ["doc_id"], path).count() == 0


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark):
    """Each stage's rows follow from its operator's decisions over the rows of the stage before."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    calm = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    ids = sorted(rows)
    want = {i for i, s in zip(ids, model.scores([rows[i].encode() for i in ids])) if s < 0.5}
    assert {r["doc_id"] for r in calm.collect()} == want and calm.columns == columns

    single = corpus_pipeline.drop_exact_copies(spark, calm, SF).cache()
    by_text = {}
    for i in sorted(want):
        by_text["".join(c.lower() if c in string.ascii_uppercase else c for c in rows[i])] = i
    assert {r["doc_id"] for r in single.collect()} == set(by_text.values()) and single.columns == columns

    ids = sorted(by_text.values())
    links = near([simhash.fingerprint(rows[i].encode()) for i in ids])
    roots = least_reachable(ids, [(ids[a], ids[b]) for a, b in links])
    apart = corpus_pipeline.drop_near_copies(spark, single, SF).cache()
    assert {r["doc_id"] for r in apart.collect()} == set(roots.values()) and apart.columns == columns

    mixed = corpus_pipeline.mix(spark, apart, SF).cache()
    left = {r["doc_id"] for r in mixed.collect()}
    assert left <= set(roots.values()) and 0.5 < len(left) / len(set(roots.values())) <= 1 and mixed.columns == columns

    done = corpus_pipeline.encode(spark, mixed, SF).collect()
    coder = bpe.encoder(bpe.vocabulary())
    assert all(coder.decode(r["tokens"]) == rows[r["doc_id"]].encode() for r in done)


def test_pipeline_edges(spark, edge, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge, none):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "lang", "source", "tokens"]
    kept = corpus_pipeline.drop_exact_copies(spark, edge, "").collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["10", "11", "12", "13", "2", "3", "4", "6", "8", "9", "None"])


def test_pipeline_names_rows_by_id_and_text(spark):
    long = prose(300, 8)
    rows = [(1, "one text"), (1, "another text"), (1, "One text"), (2, "another text"), (None, "another text"),
            (None, "no id"), (None, "no id"), (3, long + " end"), (None, long + " end."), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k"))
    once = corpus_pipeline.drop_exact_copies(spark, docs, "").cache()
    found = Counter((r["doc_id"], (r["text"] or "").lower()) for r in once.collect())
    assert found == Counter([(1, "one text"), (2, "another text"), (None, "no id"), (3, long + " end"),
                             (None, long + " end."), (4, "")])
    prints = [simhash.fingerprint(t.encode()) for t in (long + " end", long + " end.")]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    for given in (docs, once):
        left = corpus_pipeline.drop_near_copies(spark, given, "").collect()
        assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in left) == sorted(
            [("1", "one text"), ("2" if given is once else "1", "another text"), ("None", "no id"),
             ("3", long + " end"), ("4", "")]
        )
