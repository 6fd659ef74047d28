"""SimHash near-dedup by multi-index hashing.

A 64-bit fingerprint has two 32-bit segments. Two fingerprints at distance three or less differ by
at most one bit in one of them, so the ball of radius one around each segment, looked up in that
segment's table, meets every link; the complete distance is then verified.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import map_texts, staged, table
from trailmark.llm.components import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
# Fingerprints of one table bucket that are listed together; larger buckets get a longer key.
BUCKET = 256


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 if it has no word."""
    w = text.lower().split()  # bytes: lowers A-Z only and splits at \x20 and \x09-\x0D
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        hashes = [digest(b" ".join(w), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)))]
    h = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[i : i + (1 << 15)], axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">i8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and fp (long) of every row; null text is empty."""
    return map_texts(docs, list(keep), "fp long", lambda ts: {"fp": [fingerprint(t) for t in ts]})


def _ball(value: Column, bits: int) -> Column:
    """``value`` and the values that have one more of its lowest ``bits`` bits set. Of two values one
    bit apart, one has the bit unset, so probing upwards alone finds every pair."""
    flips = F.array(*[F.lit(1 << i) for i in range(bits)])
    unset = F.filter(flips, lambda f: value.bitwiseAND(f) == 0)
    return F.concat(F.array(value), F.transform(unset, lambda f: value.bitwiseOR(f)))


def _part(fp: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).between(1, DISTANCE)


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``prints`` (fp, distinct) at distance 1 to 3.

    A fingerprint has 2 entries and about 34 probes, but Spark sizes an explode like its input and would
    broadcast the probes of a small file: these joins are never broadcast.
    """
    entries = _entries(prints)
    sizes = entries.groupBy("at", "v").agg(F.count("*").alias("n"))
    crowded = staged(sizes.where(F.col("n") > BUCKET).select("at", "v"), "crowded")
    listed = entries.join(crowded, ["at", "v"], "left_anti").groupBy("at", "v").agg(
        F.collect_list("fp").alias("fps")  # BUCKET at most
    )
    lookup = listed.unionByName(crowded.withColumn("fps", F.lit(None).cast("array<long>")))
    probes = entries.select("at", F.col("fp").alias("a"), F.explode(_ball(F.col("v"), 32)).alias("v"))
    met = probes.hint("merge").join(lookup, ["at", "v"])
    plain = met.where("fps is not null").select(
        "a", F.explode(F.filter("fps", lambda x: _close(x, F.col("a")))).alias("b")
    )
    if crowded.isEmpty():
        return plain
    # Crowded buckets: the other segment differs by three bits at most, so one of its 16-bit halves
    # differs by at most one. The key becomes segment, bucket, half and the half's value.
    other = F.lit(32) - F.col("at")
    halves = F.explode(F.array(other, other + 16)).alias("sub")
    inner = entries.hint("merge").join(crowded, ["at", "v"]).select("at", "v", F.col("fp").alias("b"), halves)
    inner = inner.withColumn("sv", F.expr("shiftrightunsigned(b, sub) & 65535L"))
    outer = met.where("fps is null").select("at", "v", "a", halves)
    outer = outer.withColumn("sv", F.expr("shiftrightunsigned(a, sub) & 65535L"))
    # both directions of the flip: the pair may have met by a flip in the other segment already
    flips = F.array(F.lit(0), *[F.lit(1 << i) for i in range(16)])
    outer = outer.select("at", "v", "a", "sub", F.explode(F.transform(flips, lambda f: F.col("sv").bitwiseXOR(f))).alias("sv"))
    deep = outer.hint("merge").join(inner, ["at", "v", "sub", "sv"]).where(_close(F.col("a"), F.col("b"))).select("a", "b")
    return plain.unionByName(deep)


def _entries(prints: DataFrame) -> DataFrame:
    low, high = _part(F.col("fp"), 0, 32), _part(F.col("fp"), 32, 32)
    both = F.array(F.struct(F.lit(0).alias("at"), low.alias("v")), F.struct(F.lit(32).alias("at"), high.alias("v")))
    return prints.select("fp", F.inline(both))


def simhash_dedup(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of ``docs``, and the other columns of ``keep``.

    root is the smallest fingerprint, and component_id the smallest doc_id, reachable over links of
    three bits or fewer; component_id is null where no document of the group has an id. Documents with
    the same fingerprint are linked; texts without words have fingerprint zero like any other value.
    Null text is empty, a null doc_id keeps its row and is never the smallest; repeated rows each
    get their row; an empty table gives none.
    """
    rows = staged(fingerprints(docs, keep), "fingerprints")
    prints = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(staged(links(prints.select("fp")), "links"))
    # as many rows as different fingerprints: never broadcast
    named = prints.hint("merge").join(roots, prints["fp"] == roots["id"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.hint("merge").join(least, "root").select("fp", "root", "component_id")
    return rows.hint("merge").join(named, "fp").select(*keep, "fp", "root", "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest id of its group of near copies."""
    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
