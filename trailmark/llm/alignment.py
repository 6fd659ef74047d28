"""Alignment of two tokenizers' tokens, and how many documents hold each linked pair of ids.

Byte offsets at which tokens of both sides end cut a text into groups; tokens of one group are linked.

1. Every document is aligned; tasks count the distinct pairs of their documents before anything is
   written. The distinct pairs of the corpus are dealt by their A id to shards, and every shard gets a
   minimal perfect hash. Counts are added up in dense vectors that the hash indexes: one per shard and
   part of the tasks, which are summed as a tree.
2. Every document is aligned again and looks its pairs up: the most frequent pairs, HOT at most, in
   hashed tables that are broadcast, with the key stored in each slot to verify that the pair is the
   one asked for; pairs that are not there in a join with the table of all counts. A pair in that join
   stands in fewer documents than any broadcast one, so no key of the join is hot.

The hash is the cascade of Limasset et al., "Fast and scalable minimal perfect hashing for massive
key sets" (2017).

Neither tokenizer makes a token that goes on from a character other than white space to a space, so a
text is aligned in segments that begin at such spaces, and workers remember the segments they meet.
A vocabulary with such a piece has its texts aligned whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import flat_texts, map_texts, slices, staged, table

A_SIDE = "byte_bpe_50k.json"
B_SIDE = "piece_bpe_32k.model"
# Pairs in one shard, on average; counts that one vector is added up from; vectors summed at once.
SHARD = 1 << 17
ROWS = 1 << 20
FAN = 16
# Pairs whose counts are broadcast: at most 14 MB.
HOT = 1 << 20
# Pairs that a task counts, and segments of up to LONG characters that a worker remembers.
HELD = 400_000
REMEMBERED = 500_000
LONG = 64

# Links of a group from which on equal pairs are counted together.
LARGE = 10_000

# Characters that every tokenizer's pattern takes alike: tab, line feed, carriage return, printable ASCII
# and Latin letters up to U+024F. A plain segment has no others and ends with no white space.
_PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-ɏ]*[!-~À-ÖØ-öø-ɏ]").fullmatch
# White space to any of the tokenizers; other characters may be in here as well, at no harm.
_WIDE = r"\s\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁤　﻿"
_SEGMENT = re.compile(rf"[{_WIDE}]*[^{_WIDE}]+(?:(?! )[{_WIDE}]+[^{_WIDE}]*)*|[{_WIDE}]+")


def _byte_level() -> dict[str, int]:
    """Bytes by the printable characters that byte-level vocabularies write them as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Two tokenizers, and the alignment of segments."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        level = _byte_level()
        self.a_bytes = {
            i: bytes(level[c] for c in t) if all(c in level for c in t) else t.encode()
            for t, i in self.a.get_vocab(with_added_tokens=True).items()
        }
        self.quick = _by_ranks(a_path, self.a_bytes)
        self.b = SentencePieceProcessor(model_file=b_path)
        self.width = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.width)]
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.space = [pieces.index("▁")]
        apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.segments = _SEGMENT.findall if apart else lambda text: [text]
        a_size = max(self.a_bytes) + 1
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(a_size)])
        self.b_sizes = np.array(list(map(len, self.b_bytes)))

        def decimals(n: int, mark: str) -> np.ndarray:
            return np.array([f"{i}{mark}" for i in range(n)], object)

        # links of segments, by pair key, that the first pass has met in this worker
        self.memo: dict[str, tuple[int, ...] | None] = {}
        # a side's ids inside a group, and the last one of its group
        self.a_text = decimals(a_size, ","), decimals(a_size, "|")
        self.b_text = decimals(self.width, ","), decimals(self.width, ";")

    def split(self, raw: bytes) -> list[str]:
        """Segments of space + text, each beginning with a space; none if the text is empty or not UTF-8."""
        try:
            return self.segments(" " + raw.decode()) if raw else []
        except UnicodeDecodeError:
            return []

    def encode(self, texts: list[str]) -> tuple[list[int], np.ndarray, list[list[int]]]:
        """The ids of A for segments that are all plain or all not, end to end, their number by segment,
        and the ids of B by segment."""
        b = self.b.encode([t[1:] for t in texts], num_threads=1)
        b = [ids if len(t) > 1 else self.space for t, ids in zip(texts, b)]
        if self.quick and _PLAIN(texts[0]):
            # one text of all: every segment but the first begins with a space after another character
            joined = "".join(texts)
            sizes = map(len, texts) if joined.isascii() else (len(t.encode()) for t in texts)
            a = self.quick(joined)
            to = np.searchsorted(np.cumsum(self.a_sizes[a]), np.cumsum(np.fromiter(sizes, np.int64)), "right")
            return a, np.diff(to, prepend=0), b
        listed = [self.a.encode(t, add_special_tokens=False).ids for t in texts]
        return list(chain.from_iterable(listed)), np.array(list(map(len, listed)), np.int64), b

    def align(self, texts: list[str], written: bool = True) -> Aligned:
        """Of segments that are all plain or all not."""
        a, n_a, b = self.encode(texts)
        n_b = np.array(list(map(len, b)), np.int64)
        b = list(chain.from_iterable(b))
        raw = "".join(texts).encode()
        spelt = np.ones(len(texts), bool)
        bytes_a, bytes_b = (b"".join(map(t.__getitem__, x)) for t, x in ((self.a_bytes, a), (self.b_bytes, b)))
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        owner_a, owner_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        sizes_a = _sums(owner_a, self.a_sizes[a], len(texts))
        if bytes_a != raw or bytes_b != raw or (sizes_a != _sums(owner_b, self.b_sizes[b], len(texts))).any():
            parts_a, parts_b = (
                [b"".join(map(t.__getitem__, x)) for x in np.split(ids, np.cumsum(n)[:-1])]
                for t, ids, n in ((self.a_bytes, a, n_a), (self.b_bytes, b, n_b))
            )
            spelt = np.array([x == t.encode() == y for x, t, y in zip(parts_a, texts, parts_b)])
            a, b = a[spelt[owner_a]], b[spelt[owner_b]]
            n_a, n_b = n_a * spelt, n_b * spelt
        # both sides spell the same bytes: their ends agree wherever a segment ends
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        other = np.searchsorted(ends_b, ends_a)
        last_a = ends_b[other] == ends_a if len(a) else np.zeros(0, bool)
        last_b = np.zeros(len(b), bool)
        last_b[other[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        owner = np.repeat(np.arange(len(texts)), n_a)[last_a]  # of each group
        links = in_a * in_b
        key, times, of = self._links(a, b, group_a, in_a, in_b, start_a, start_b)
        out = Aligned(
            spelt, n_a, n_b, np.bincount(owner, minlength=len(texts)),
            _sums(owner, links, len(texts)), key, times, owner[of], [],
        )
        if written:
            tokens = np.empty(len(a) + len(b), object)
            at_a = np.arange(len(a)) + start_b[group_a]
            at_b = np.arange(len(b)) + (start_a + in_a)[group_b]
            for at, ids, last, (inside, final) in (
                (at_a, a, last_a, self.a_text), (at_b, b, last_b, self.b_text),
            ):
                tokens[at[~last]] = inside[ids[~last]]
                tokens[at[last]] = final[ids[last]]
            listed, to = tokens.tolist(), np.cumsum(n_a + n_b).tolist()
            out.written.extend("".join(listed[x:y]) for x, y in zip([0, *to], to))
        return out

    def _links(self, a, b, group_a, in_a, in_b, start_a, start_b):
        """Key, times and group of the links; a pair of a very large group is listed once."""
        large = in_a * in_b > LARGE
        partners = np.where(large, 0, in_b)[group_a]  # of each A token
        left = np.repeat(np.arange(len(a)), partners)
        step = np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners)
        key = a[left] * self.width + b[start_b[group_a[left]] + step]
        found = [(key, np.ones(len(key), np.int64), group_a[left])]
        for g in np.flatnonzero(large).tolist():
            x, n = np.unique(a[start_a[g] : start_a[g] + in_a[g]], return_counts=True)
            y, m = np.unique(b[start_b[g] : start_b[g] + in_b[g]], return_counts=True)
            pairs = (x[:, None] * self.width + y).ravel()
            found.append((pairs, np.outer(n, m).ravel(), np.full(len(pairs), g)))
        return (np.concatenate(x) for x in zip(*found))


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, values)
    return out


class Aligned(NamedTuple):
    """By segment: whether both sides spell it, tokens of A and of B, groups, links; by link or by
    several links of a pair: pair key (A id times the size of B's vocabulary, plus B id), how many, and
    the segment; by segment its groups written out, each ended by a semicolon."""

    spelt: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    key: np.ndarray
    times: np.ndarray
    owner: np.ndarray
    written: list[str]


def _by_ranks(path: str, tokens: dict[int, bytes]):
    """A quicker encoder for plain segments, where the file's merges are in the order of their ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(x + y) for x, y in pairs]
    if made != list(range(256, 256 + len(pairs))) or any(len(tokens[i]) != 1 for i in range(256)):
        return None
    ranks = {tokens[i]: i for i in range(256 + len(pairs))}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


@cache
def aligner(a_path: str, b_path: str) -> Aligner:
    """One per worker process; the files are part of the installed tokenizers on every machine."""
    made = Aligner(a_path, b_path)
    # its tables hold no cycles; walking them again and again takes time
    gc.freeze()
    gc.set_threshold(1_000_000)
    return made


def sides(a: str = A_SIDE, b: str = B_SIDE) -> tuple[str, str]:
    return os.path.realpath(public_tokenizers.path(a)), os.path.realpath(public_tokenizers.path(b))


# --- minimal perfect hashing ------------------------------------------------------------------------


def _mix(x: np.ndarray, level: int) -> np.ndarray:
    x = x + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalHash:
    """A one-to-one map of its n keys to 0 .. n-1. Level by level, keys that have a place of the level's
    bits to themselves keep it, the others go on; a key's slot is the rank of its bit."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.first = np.cumsum([0, *sizes])
        counts = np.bitwise_count(bits).astype(np.int64)
        self.rank = np.cumsum(counts) - counts

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalHash:
        """Of distinct non-negative ``keys``."""
        rest = keys.astype(np.uint64)
        sizes, bits = [], []
        while len(rest):
            if len(sizes) > 200:
                raise ValueError("keys repeat")
            size = 64 * (2 * len(rest) // 64 + 1)
            at = (_mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, any slot or -1 for keys that it was not built of."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        keys = keys.astype(np.uint64)
        for level, size in enumerate(self.sizes):
            at = (_mix(keys[left], level) % np.uint64(size)).astype(np.int64) + self.first[level]
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            there = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[there]] = (self.rank[at >> 6] + below)[there]
            left = left[~there]
        return out


def _hashed(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard's hash, and its keys by slot."""
    keys = frame["key"].to_numpy(np.int64)
    made = MinimalHash.build(keys)
    ordered = np.empty_like(keys)
    ordered[made.slots(keys)] = keys
    return pd.DataFrame(
        {"shard": [frame["shard"].iat[0]], "sizes": [made.sizes], "bits": [made.bits.tobytes()], "keys": [ordered.tobytes()]}
    )


HASHED = "shard int, sizes array<long>, bits binary, keys binary"


def _read_hash(row) -> tuple[MinimalHash, np.ndarray]:
    bits = np.frombuffer(row["bits"], "<u8")
    return MinimalHash([int(s) for s in row["sizes"]], bits), np.frombuffer(row["keys"], np.int64)


# --- first pass: counts of all pairs ----------------------------------------------------------------


def _segments(texts: list[bytes], coder: Aligner, memo: dict, learn) -> Iterator[list[list[str]]]:
    """The segments of each text, for slices of the texts. ``learn`` puts the slice's new segments into
    ``memo``, where long ones stay for the slice alone."""
    for x, y in slices(texts):
        if len(memo) >= REMEMBERED:
            memo.clear()
        split = [coder.split(t) for t in texts[x:y]]
        new = [s for s in dict.fromkeys(chain.from_iterable(split)) if s not in memo]
        plain = [bool(_PLAIN(s)) for s in new]
        for kind in (True, False):
            if some := [s for s, p in zip(new, plain) if p is kind]:
                learn(some)
        yield split
        for s in new:
            if len(s) > LONG:
                memo.pop(s, None)


def _task_counts(docs: DataFrame, paths: tuple[str, str], held: int) -> DataFrame:
    """(key, docs, part): how many documents of a task hold each pair, in one row per pair and task, or
    more where a task meets more than ``held`` pairs."""

    def work(batches) -> Iterator[dict]:
        coder = aligner(*paths)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        counts: Counter = Counter()

        def learn(new: list[str]) -> None:
            made = coder.align(new, written=False)
            keys = made.key[np.argsort(made.owner, kind="stable")].tolist()
            to = np.cumsum(np.bincount(made.owner, minlength=len(new))).tolist()
            for s, good, x, y in zip(new, made.spelt.tolist(), [0, *to], to):
                coder.memo[s] = tuple(keys[x:y]) if good else None

        def taken() -> dict:
            n = len(counts)
            out = {
                "key": np.fromiter(counts.keys(), np.int64, n),
                "docs": np.fromiter(counts.values(), np.int64, n),
                "part": np.full(n, part, np.int32),
            }
            counts.clear()
            return out

        for _, texts in batches:
            for split in _segments(texts, coder, coder.memo, learn):
                for segments in split:
                    keys = [coder.memo[s] for s in segments]
                    if None not in keys:
                        counts.update(set(chain.from_iterable(keys)))
                    if len(counts) >= held:
                        yield taken()
        if counts:
            yield taken()

    return flat_texts(docs, [], "key long, docs long, part int", work)


def _add_up(key: tuple, partial: pd.DataFrame, hashes: pd.DataFrame) -> pd.DataFrame:
    """The dense vector of one part of a shard's counts; none where the part counted nothing."""
    if not len(partial):
        return pd.DataFrame({"shard": [], "salt": [], "counts": []})
    made, keys = _read_hash(hashes.iloc[0])
    vector = np.zeros(len(keys), np.int64)
    np.add.at(vector, made.slots(partial["key"].to_numpy(np.int64)), partial["docs"].to_numpy(np.int64))
    return pd.DataFrame({"shard": [key[0]], "salt": [key[1]], "counts": [vector.tobytes()]})


def _sum(key: tuple, vectors: pd.DataFrame) -> pd.DataFrame:
    total = np.sum([np.frombuffer(v, np.int64) for v in vectors["counts"]], axis=0)
    return pd.DataFrame({"shard": [key[0]], "salt": [key[1]], "counts": [total.tobytes()]})


def _unpacked(width: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for keys, counts in zip(frame["keys"], frame["counts"]):
                keys, counts = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
                _, a = np.unique(keys // width, return_inverse=True)
                most = np.zeros(a.max(initial=0) + 1, np.int64)
                np.maximum.at(most, a, counts)  # a shard has all pairs of its A ids
                yield pd.DataFrame({"key": keys, "docs": counts, "best": counts == most[a]})

    return run


def pair_counts(
    docs: DataFrame, paths: tuple[str, str] | None = None, shard_keys: int = SHARD, rows: int = ROWS, held: int = HELD
) -> DataFrame:
    """(key, docs, best) of every pair of ids that a document links: how many documents (rows of
    ``docs``) hold it linked, and whether no pair of the same A id has more. The key is the A id times
    the size of B's vocabulary, plus the B id. Staged."""
    paths = paths or sides()
    width = aligner(*paths).width
    partial = staged(_task_counts(docs, paths, held), "pair-parts")
    keys = staged(partial.select("key").distinct(), "pair-keys")
    shards = max(1, ceil(keys.count() / shard_keys))

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.withColumn("shard", F.pmod(F.floor(F.col("key") / width), F.lit(shards)).cast("int"))

    hashes = staged(dealt(keys).groupBy("shard").applyInPandas(_hashed, HASHED), "pair-hashes")
    salts = max(1, ceil(partial.count() / (shards * rows)))
    salted = dealt(partial).withColumn("salt", F.pmod("part", F.lit(salts)).cast("int"))
    copies = hashes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    ddl = "shard int, salt int, counts binary"
    vectors = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(_add_up, ddl)
    while salts > 1:
        salts = ceil(salts / FAN)
        vectors = vectors.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int"))
        vectors = vectors.groupBy("shard", "salt").applyInPandas(_sum, ddl)
    both = vectors.select("shard", "counts").join(hashes.select("shard", "keys"), "shard")
    return staged(both.mapInPandas(_unpacked(width), "key long, docs long, best boolean"), "pair-counts")


# --- second pass ------------------------------------------------------------------------------------


def _table_of(frame: pd.DataFrame) -> pd.DataFrame:
    """A shard of the broadcast: hash, keys, counts and marks by slot."""
    out = _hashed(frame)
    made, _ = _read_hash(out.iloc[0])
    order = np.argsort(made.slots(frame["key"].to_numpy(np.int64)))
    out["docs"] = [frame["docs"].to_numpy(np.int64)[order].tobytes()]
    out["best"] = [frame["best"].to_numpy(bool)[order].tobytes()]
    return out


class PairTable:
    """Counts of the pairs that are broadcast."""

    def __init__(self, rows: list, width: int, shards: int):
        self.width, self.shards = width, shards
        self.memo: dict[str, tuple | None] = {}  # what a worker knows of segments
        self.tables = {
            r["shard"]: (*_read_hash(r), np.frombuffer(r["docs"], np.int64), np.frombuffer(r["best"], bool))
            for r in rows
        }

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each key, 0 for those that are not here, and whether it is its A id's highest."""
        docs, best = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        shard = keys // self.width % self.shards
        for s in np.unique(shard):
            if s in self.tables:
                made, stored, counts, marks = self.tables[s]
                at = np.flatnonzero(shard == s)
                slot = made.slots(keys[at])
                good = (slot >= 0) & (stored[slot] == keys[at])
                docs[at[good]], best[at[good]] = counts[slot[good]], marks[slot[good]]
        return docs, best


def _hot_table(counted: DataFrame, width: int, most: int) -> tuple[PairTable, int]:
    """The pairs in at least so many documents, ``most`` of them at most, and that number."""
    power = F.floor(F.log2("docs")).cast("int")  # of doubles: a count near a power may fall either side
    power = power + F.when(F.pow(F.lit(2.0), power + 1) <= F.col("docs"), 1).otherwise(0)
    power = power - F.when(F.pow(F.lit(2.0), power) > F.col("docs"), 1).otherwise(0)
    sizes = {r["p"]: r["count"] for r in counted.groupBy(power.alias("p")).count().collect()}  # 64 rows at most
    least, taken = max(sizes, default=0) + 1, 0
    for p in sorted(sizes, reverse=True):
        if taken + sizes[p] > most:
            break
        least, taken = p, taken + sizes[p]
    shards = max(1, ceil(taken / SHARD))
    shard = F.pmod(F.floor(F.col("key") / width), F.lit(shards)).cast("int").alias("shard")
    hot = counted.where(F.col("docs") >= F.lit(1 << least)).select("key", "docs", "best", shard)
    rows = hot.groupBy("shard").applyInPandas(_table_of, HASHED + ", docs binary, best binary").collect()
    return PairTable(rows, width, shards), 1 << least


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _second(paths: tuple[str, str], pairs, digest: bool):
    """Aligns texts again, and looks up what the broadcast table has; the rest is listed as ``cold``."""

    def work(texts: list[bytes]) -> dict[str, list]:
        coder, known = aligner(*paths), pairs.value
        coder.memo.clear()  # of the first pass
        groups = "groups_sha256" if digest else "groups"
        out: dict[str, list] = {n: [] for n in (*COLUMNS, groups, "cold")}
        for split in _segments(texts, coder, known.memo, lambda new: _remember(new, coder, known)):
            for segments in split:
                rows = [known.memo[s] for s in segments]
                if not rows or None in rows:
                    values, written, cold = (0,) * 6, "", []
                else:
                    *numbers, texts_, colds = zip(*rows)
                    values = tuple(map(sum, numbers))
                    joined = "".join(texts_)[:-1]
                    written = hashlib.sha256(joined.encode()).hexdigest() if digest else joined
                    rest: Counter = Counter()
                    for c in filter(None, colds):
                        for k, n in c:
                            rest[k] += n
                    cold = [{"key": k, "times": n} for k, n in rest.items()]
                for n, v in zip((*COLUMNS, groups, "cold"), (*values, written, cold)):
                    out[n].append(v)
        return out

    return work


def _remember(new: list[str], coder: Aligner, pairs: PairTable) -> None:
    """Alignments of new segments, with the sums over their links; one look-up for all of them."""
    made = coder.align(new)
    docs, best = pairs.find(made.key)
    sums = _sums(made.owner, docs * made.times, len(new))
    bests = _sums(made.owner, best * made.times, len(new))
    cold: dict[int, list] = {}
    for i in np.flatnonzero(docs == 0).tolist():
        cold.setdefault(int(made.owner[i]), []).append((int(made.key[i]), int(made.times[i])))
    numbers = (x.tolist() for x in (made.spelt, made.n_a, made.n_b, made.n_groups, made.n_links, bests, sums))
    for k, (s, text, good, *row) in enumerate(zip(new, made.written, *numbers)):
        pairs.memo[s] = (*row, text, cold.get(k)) if good else None


def align(
    docs: DataFrame,
    keep: list[str],
    paths: tuple[str, str] | None = None,
    digest: bool = False,
    hot: int = HOT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """The columns ``keep`` of every document with n_a and n_b (its tokens), n_groups, n_links, n_best
    (links whose pair has its A id's highest count), count_sum (the counts of its links added up) and
    ``groups``, written ``a1,a2|b1;a3|b2,b3``, or with ``digest`` their SHA-256 as groups_sha256.

    ``counted`` is what ``pair_counts`` gave for the same documents. Texts that are null, empty, not UTF-8,
    or not spelt by the tokens of a side have no tokens: zeros and ''. Repeated rows are documents of
    their own. An empty table gives no rows. ``keep`` may not name a column that is added.
    """
    paths = paths or sides()
    if counted is None:
        counted = pair_counts(docs, paths)
    table_, least = _hot_table(counted, aligner(*paths).width, hot)
    shared = docs.sparkSession.sparkContext.broadcast(table_)  # ``hot`` pairs at most
    groups = "groups_sha256" if digest else "groups"
    added = ", ".join(f"{c} long" for c in COLUMNS) + f", {groups} string, cold array<struct<key:long,times:long>>"
    found = map_texts(docs, keep, added, _second(paths, shared, digest))
    names = [F.col(f"`{c}`") for c in (*keep, *COLUMNS, groups)]
    cold = counted.where(F.col("docs") < least)
    if least == 1:  # every pair was broadcast
        return found.select(*names)
    found = staged(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    late = (
        found.select("row", F.inline("cold"))
        .join(cold, "key")
        .groupBy("row")
        .agg(F.sum(F.col("best").cast("long") * F.col("times")).alias("late_best"), F.sum(F.col("docs") * F.col("times")).alias("late_sum"))
    )
    joined = found.join(late.hint("merge"), "row", "left")
    plus = {c: F.col(c) + F.coalesce(F.col(n), F.lit(0)) for c, n in (("n_best", "late_best"), ("count_sum", "late_sum"))}
    return joined.select(*[plus[c].alias(c) if c in plus else F.col(f"`{c}`") for c in (*keep, *COLUMNS, groups)])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tokenizers' tokens of every document, aligned, with corpus-wide counts of their links."""
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], digest=True)
