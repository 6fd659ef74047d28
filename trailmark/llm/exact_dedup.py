"""Exact dedup of batches against immutable snapshots, screened by static binary-fuse filters.

Every batch is an immutable snapshot once it is in. A batch's digests are grouped among themselves
first. A filter per (snapshot, digest bucket) screens the digests of later batches; only positives
are joined to the snapshot's exact bucket. Texts with equal digests are then compared byte by byte,
so a digest collision never joins different texts.

Filters follow Graf and Lemire, "Binary Fuse Filters: Fast and Smaller Than Xor Filters" (2022).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import LOWER, UPPER, fold_case, map_texts, staged, table

# Digests in one bucket of the digest space; the number of buckets grows with the data.
BUCKET_ROWS = 20_000
# Copies that meet their representative's text in one salted group.
SALT_ROWS = 256


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _places(keys: np.ndarray, seed: int, seg_len: int, segs: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots of each key, in three neighbouring segments, and its one-byte fingerprint."""
    h = _mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    first = (h >> np.uint64(44)) % np.uint64(segs)
    mask = np.uint64(seg_len - 1)
    g = _mix(h)
    slots = np.stack(
        [(first + np.uint64(i)) * np.uint64(seg_len) + ((g >> np.uint64(18 * i)) & mask) for i in range(3)]
    )
    return slots.astype(np.int64), ((h ^ (h >> np.uint64(29))) & np.uint64(0xFF)).astype(np.uint8)


def build_fuse(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A filter (seed, segment length, segments, slots) of the distinct ``keys`` (uint64)."""
    keys = np.unique(keys.astype(np.uint64))
    n = max(len(keys), 2)
    # fixed values of the published construction for three hashes
    seg_len = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
    size = n * max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
    segs = max(1, math.ceil(size / seg_len) - 2)
    for seed in range(1, 200):
        if seed % 20 == 0:
            segs += 1 + segs // 8
        slots, prints = _places(keys, seed, seg_len, segs)
        total = (segs + 2) * seg_len
        count = np.bincount(slots.ravel(), minlength=total)
        held = np.zeros(total, np.int64)  # XOR of the keys' numbers in a slot
        numbers = np.arange(len(keys))
        for row in slots:
            np.bitwise_xor.at(held, row, numbers)
        rounds, left = [], len(keys)
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            who, at = np.unique(held[alone], return_index=True)
            rounds.append((who, alone[at]))
            for row in slots[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, who)
            left -= len(who)
        if left:
            continue
        cells = np.zeros(total, np.uint8)
        for who, own in reversed(rounds):
            # the own slot is still zero, so XOR over all three gives the other two
            s = slots[:, who]
            cells[own] = prints[who] ^ cells[s[0]] ^ cells[s[1]] ^ cells[s[2]]
        return seed, seg_len, segs, cells.tobytes()
    raise RuntimeError("no seed peels; keys repeat")


def in_fuse(keys: np.ndarray, seed: int, seg_len: int, segs: int, cells: bytes) -> np.ndarray:
    """Whether each key may be in the filter: never false for one that is."""
    slots, prints = _places(keys.astype(np.uint64), seed, seg_len, segs)
    c = np.frombuffer(cells, np.uint8)
    return (c[slots[0]] ^ c[slots[1]] ^ c[slots[2]]) == prints


def sha256(normal: bytes) -> bytes:
    return hashlib.sha256(normal).digest()


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x[:8].ljust(8, b"\0") for x in digests), dtype=">u8").astype(np.uint64)


def _filters_of(pdf: pd.DataFrame) -> pd.DataFrame:
    seed, seg_len, segs, cells = build_fuse(_keys(pdf["digest"]))
    return pd.DataFrame(
        {"snapshot": [pdf["batch"].iloc[0]], "bucket": [pdf["bucket"].iloc[0]], "seed": [seed],
         "seg_len": [seg_len], "segs": [segs], "cells": [cells]}
    )


def _screen(entries: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    found = []
    if len(entries):
        keys = _keys(entries["digest"])
        for f in filters.itertuples():
            later = (entries["batch"] > f.snapshot).to_numpy()
            hit = later & in_fuse(keys, f.seed, f.seg_len, f.segs, f.cells)
            found.append(pd.DataFrame({"digest": entries["digest"][hit], "snapshot": f.snapshot}))
    return pd.concat(found) if found else pd.DataFrame({"digest": [], "snapshot": []})


def exact_dedup(
    docs: DataFrame, batch: Column, digest: Callable[[bytes], bytes] = sha256, text_key: Column | None = None
) -> DataFrame:
    """For every row of ``docs``: doc_id, keep_id, group_size, kept, digest, and ``text_key`` of the row
    as it is given, where wanted.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. ``batch`` numbers the
    batches in the order they came. Of equal texts the row with the largest doc_id stays (null is the
    smallest). Rows repeated with the same doc_id and text are all counted, and one of them stays.
    Empty tables give no rows; other columns of ``docs`` are not looked at.
    """
    carried = [] if text_key is None else ["text_key"]
    parts = docs.select(
        "doc_id", "text", batch.cast("int").alias("batch"), *([] if text_key is None else [text_key.alias("text_key")])
    )
    rows = map_texts(
        parts, ["doc_id", "batch", *carried], "digest binary", lambda ts: {"digest": [digest(t.lower()) for t in ts]}
    )
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "digests")

    # duplicates inside a batch are grouped on their own, with a map-side combine
    entries = staged(
        rows.groupBy("batch", "digest").agg(
            F.max(F.struct("doc_id", "row")).alias("top"), F.count("*").alias("n")
        ),
        "entries",
    )
    total, last = entries.agg(F.count("*"), F.max("batch")).first()
    buckets = max(1, -(-total // BUCKET_ROWS))
    bucketed = entries.select(
        "batch", "digest", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket")
    )
    filters = bucketed.where(F.col("batch") < F.lit(last)).groupBy("batch", "bucket").applyInPandas(
        _filters_of, "snapshot int, bucket int, seed int, seg_len int, segs int, cells binary"
    )
    positives = (
        bucketed.groupBy("bucket")
        .cogroup(filters.groupBy("bucket"))
        .applyInPandas(_screen, "digest binary, snapshot int")
    )
    # false positives of the filters end here; entries are as many as texts: never broadcast
    across = (
        positives.hint("merge").join(entries.select("digest", F.col("batch").alias("snapshot")), ["digest", "snapshot"])
        .select("digest")
        .distinct()
    )
    repeated = across.unionByName(entries.where("n > 1").select("digest")).distinct()
    groups = staged(
        entries.hint("merge").join(repeated, "digest")
        .groupBy("digest")
        .agg(F.max("top").alias("top"), F.sum("n").alias("n")),
        "groups",
    )
    members = rows.hint("merge").select("doc_id", "row", "digest", *carried).join(
        groups.select("digest", "top", "n"), "digest", "left"
    )
    members = staged(members, "members")
    suspects = members.where("n is not null")

    # byte check: only these texts move (never broadcast: copies may be a third of the corpus), and a hot group meets its representative in salted parts
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    texts = suspects.hint("merge").join(
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")),
        F.col("doc_id").eqNullSafe(F.col("_id")),
    ).select("row", "digest", "top", "n", fold_case(F.col("_text")).alias("normal"))
    if digest is sha256:  # rows that share a doc_id with another text meet only their own
        texts = texts.where(F.sha2("normal", 256) == F.lower(F.hex("digest")))
    texts = staged(texts, "suspects")
    leaders = texts.where(F.col("row") == F.col("top.row")).groupBy("digest", "n").agg(
        F.min("normal").alias("lead")
    )
    leaders = leaders.select("digest", "lead", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    copies = texts.withColumn("salt", F.pmod(F.xxhash64("row"), salts).cast("int"))
    odd = (
        copies.hint("merge").join(leaders, ["digest", "salt"])
        .groupBy("row")
        .agg(F.min(F.when(F.col("normal") != F.col("lead"), F.col("normal"))).alias("other"),
             F.max((F.col("normal") == F.col("lead")).cast("int")).alias("same"))
        .where("same = 0")
        .select("row", "other")
    )
    # texts that differ from their representative although the digest is equal are classes of their own
    odd = staged(odd, "collisions")
    if odd.isEmpty():
        top, size = F.coalesce("top", F.struct("doc_id", "row")), F.coalesce("n", F.lit(1).cast("long"))
        final = members.select("doc_id", "row", "digest", *carried, top.alias("top"), size.alias("n"))
    else:
        classes = members.join(odd, "row", "left")
        heads = classes.groupBy("digest", "other").agg(
            F.max(F.struct("doc_id", "row")).alias("_top"), F.count("*").alias("_n")
        )
        same = F.col("c.digest").eqNullSafe(F.col("h.digest")) & F.col("c.other").eqNullSafe(F.col("h.other"))
        final = classes.alias("c").join(heads.alias("h"), same).select(
            "doc_id", "row", F.col("c.digest").alias("digest"), *carried,
            F.col("_top").alias("top"), F.col("_n").alias("n"),
        )
    return final.select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("top.row")).alias("kept"),
        "digest",
        *carried,
    )


def by_hash(batches: int = 4) -> Column:
    """Batch numbers for a table that names no order of arrival."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(batches))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays; documents come in four batches by a hash of the id."""
    found = exact_dedup(table(spark, sf_dir, "documents"), by_hash())
    return found.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = f"""
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t
    FROM documents
), g AS (
    SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
