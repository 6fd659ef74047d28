"""Token alignment against a brute-force version on whole texts, the hash, and edge cases."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from trailmark.llm import alignment, registry

SF = "/root/testdata/sf0.001"
PATHS = alignment.sides()


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    level = alignment._byte_level()
    a_bytes = {i: bytes(level.get(c, 63) for c in t) for t, i in a.get_vocab().items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        """[(A ids, B ids)] of a whole text, by byte offsets."""
        if not text:
            return []
        left = a.encode(" " + text, add_special_tokens=False).ids
        right = b.encode(text)
        whole = (" " + text).encode()
        la, lb = [a_bytes[i] for i in left], [piece(i) for i in right]
        if b"".join(la) != whole or b"".join(lb) != whole:
            return []
        ends_a, ends_b = np.cumsum([len(x) for x in la]), np.cumsum([len(x) for x in lb])
        out, i, j = [], 0, 0
        for cut in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            i2, j2 = np.searchsorted(ends_a, cut, "right"), np.searchsorted(ends_b, cut, "right")
            out.append((left[i:i2], right[j:j2]))
            i, j = i2, j2
        return out

    return groups


def brute(groups_of, texts):
    every = [groups_of(t) for t in texts]
    counts = Counter(k for g in every for k in {(x, y) for a, b in g for x in a for y in b})
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    rows = []
    for g in every:
        links = [(x, y) for a, b in g for x in a for y in b]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links),
            sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links), written,
        ))
    return rows, counts, most


def values(r, last):
    return tuple(r[c] for c in alignment.COLUMNS) + (r[last],)


BITS = [
    "a", " ", "  ", "\n", "\t", "▁", " ", "​", "　", "don't", "'s", "é", "é", "日本", "🙂",
    "<|endoftext|>", "</s>", "<0x41>", "\x00", "\x1c", "\x85", "1234", "foo bar", "\r\n", "ﬁ", "᠎", " ",
]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join))
def test_segments_give_the_tokens_of_whole_texts(plain, text):
    coder = alignment.aligner(*PATHS)
    split = coder.split(text.encode())
    assert "".join(split) == (" " + text if text else "")
    found = {}

    def learn(new):
        made = coder.align(new)
        found.update((s, w if good else None) for s, w, good in zip(new, made.written, made.spelt))

    assert list(alignment._segments([text.encode()], coder, {}, learn)) == [[split]]
    written = [found[s] for s in split]
    want = "".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) + ";" for a, b in plain(text))
    assert ("" if None in written else "".join(written)) == want


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 100_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).choice(1 << 31, n, replace=False)
    made = alignment.MinimalHash.build(keys)
    assert sorted(made.slots(keys).tolist()) == list(range(n))
    again, stored = alignment._read_hash({"sizes": made.sizes, "bits": made.bits.tobytes(), "keys": b""})
    assert (again.slots(keys) == made.slots(keys)).all()
    assert made.slots(keys + (1 << 32)).max(initial=-1) < max(n, 1)
    if n > 2:
        with pytest.raises(ValueError):
            alignment.MinimalHash.build(np.array([1, 1, 2]))


def test_query_matches_brute_force(spark, plain):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows, _, _ = brute(plain, [d["text"] for d in docs])
    got = {r["doc_id"]: values(r, "groups_sha256") for r in registry.QUERIES["op13_token_alignment"](spark, SF).collect()}
    want = {d["doc_id"]: (*r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[0] else "") for d, r in zip(docs, rows)}
    assert got == want


EDGE = [
    (1, "the cat sat", 1), (2, "the cat sat", 1), (2, "the cat sat", 1), (3, None, 1), (4, "", 1), (None, "the dog", 1),
    (5, "a▁b is not spelt", 1), (6, " ", 1), (7, "\n\n", 1), (8, "the " * 20_000, 1), (9, "=" * 5000 + "日本" * 500, 1),
    (10, "<|endoftext|> </s> the", 1), (11, "x  y   z ", 1),
]


@pytest.mark.parametrize("hot", [alignment.HOT, 8, 0])
def test_edges_with_and_without_broadcast(spark, plain, hot):
    """Counts come from the broadcast, from the join, or from both; shards and the tree change nothing."""
    frame = spark.createDataFrame(EDGE, "doc_id long, text string, n_a int").withColumnRenamed("n_a", "key")
    frame = frame.withColumn("a.b", alignment.F.lit(1)).repartition(5)
    rows, counts, most = brute(plain, [t for _, t, _ in EDGE])
    counted = alignment.pair_counts(frame, shard_keys=50, rows=1, held=40)
    width = alignment.aligner(*PATHS).width
    want = sorted((x * width + y, n, n == most[x]) for (x, y), n in counts.items())
    assert sorted(map(tuple, counted.collect())) == want
    out = alignment.align(frame, ["doc_id", "a.b", "key"], hot=hot, counted=counted)
    got = sorted((str(r["doc_id"]), values(r, "groups")) for r in out.collect())
    assert got == sorted((str(d[0]), r) for d, r in zip(EDGE, rows))


def test_large_groups_count_pairs_together(monkeypatch):
    coder = alignment.aligner(*PATHS)
    texts = [" " + "=" * 3000 + "日本" * 50, " ü日", " 本 日"]
    one = coder.align(texts)
    monkeypatch.setattr(alignment, "LARGE", 1)
    two = coder.align(texts)

    def links(x):
        out = Counter()
        for k, n, o in zip(x.key.tolist(), x.times.tolist(), x.owner.tolist()):
            out[k, o] += n
        return out

    assert links(one) == links(two)
    assert one.n_links.tolist() == two.n_links.tolist() == [sum(n for (_, o), n in links(two).items() if o == i) for i in range(3)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(none, ["doc_id"]).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None)], "doc_id long, text string"), ["doc_id"]).first()["n_a"] == 0


def test_bytes_that_are_not_utf8():
    assert alignment.aligner(*PATHS).split(b"\xff\xfe") == []
