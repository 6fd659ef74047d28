"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes and cuts where it is small, so cuts depend on the 16 bytes before
them and an insertion moves only the cuts around it. Chunks are compared by a 64-bit digest; runs
of chunks that also stand in another document make a repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.common import flat_texts, slices, staged, table

AVERAGE = 24  # bytes between cuts
SHORTEST = 12  # shorter chunks repeat by chance and are not compared
LONGEST = 1 << 16
BRIDGE = 48  # bytes without a repeated chunk that a passage may have inside
MIN_WORDS = 20  # words in the repeated chunks of a passage; its ends lie in chunks that differ

_REACH = 16  # bytes that a 16-bit gear hash remembers
_GEAR = np.random.default_rng(16).integers(0, 1 << 16, 256, dtype=np.uint16)
_GAP = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def gear(buf: np.ndarray) -> np.ndarray:
    """h = 2 h + gear[byte] at every place, modulo 2^16, by doubling the reach four times."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8):
        more = h.copy()
        more[k:] += h[:-k] << np.uint16(k)
        h = more
    return h


def chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(text number, start, size, words before, words, digests) of the chunks of at least SHORTEST bytes.
    A word belongs to the chunk in which it begins."""
    for lo, hi in slices(texts):
        part = texts[lo:hi]
        gap = bytes(_REACH)  # every text starts from the same state
        joined = gap + gap.join(part) + gap
        buf = np.frombuffer(joined, np.uint8)
        small = gear(buf) < (1 << 16) // AVERAGE
        small[1:] &= ~small[:-1]  # a run of one byte is not cut at every byte
        begin = _REACH + np.cumsum([0, *[len(t) + _REACH for t in part[:-1]]])
        end = begin + np.array([len(t) for t in part])
        bounds = np.unique(np.concatenate([np.flatnonzero(small) + 1, begin, end]))
        a, b = bounds[:-1], bounds[1:]
        owner = np.searchsorted(begin, a, "right") - 1
        inside = (owner >= 0) & (b <= end[np.maximum(owner, 0)]) & (b - a >= SHORTEST)
        a, b, owner = a[inside], b[inside], owner[inside]
        pieces = -(-(b - a) // LONGEST)
        if (pieces > 1).any():
            step = np.concatenate([np.arange(n) for n in pieces]) * LONGEST
            a, b, owner = np.repeat(a, pieces) + step, np.repeat(b, pieces), np.repeat(owner, pieces)
            b = np.minimum(a + LONGEST, b)
        if not len(a):
            continue
        space = _GAP[buf]
        heads = np.concatenate([[0], np.cumsum(~space[1:] & space[:-1])])  # word starts up to a place
        digest = xxhash.xxh3_64_digest
        digests = b"".join([digest(joined[i:j]) for i, j in zip(a.tolist(), b.tolist())])
        before = heads[a - 1] - heads[begin[owner] - 1]
        yield lo + owner, a - begin[owner], b - a, before, heads[b - 1] - heads[a - 1], digests


def _rows(batches) -> Iterator[dict]:
    for batch, texts in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for owner, start, size, before, words, digests in chunks(texts):
            h = np.frombuffer(digests, dtype=">i8").astype(np.int64)
            # one number for the place: start, size and words
            place = (start.astype(np.int64) << 31) | (size.astype(np.int64) << 14) | np.minimum(words, (1 << 14) - 1)
            yield {"h": h, "doc_id": ids[owner], "place": place, "before": before}


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start, n_bytes, n_words, first_doc, kept): passages that stand in other documents, as byte
    spans of the UTF-8 text, a passage of which different documents keep parts in a row per part.

    A passage may stand in one other document or piecewise in several. ``n_words`` are the words of the
    whole passage from its first repeated chunk to its last, which must be ``min_words`` or more.
    ``kept`` is true for the document with the smallest id among those that hold the part, which
    keeps its copy. Documents without such a passage have no row. Null texts are empty, documents
    without an id take no part, repeated rows are one document, an empty table gives no rows.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = flat_texts(known, ["doc_id"], "h long, doc_id long, place long, before int", _rows)
    found = staged(found, "chunks")
    # a digest may stand in a third of all documents: two ids per task and digest are shuffled
    shared = (
        found.groupBy("h")
        .agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        .where("first_doc <> last_doc")
        .select("h", "first_doc")
    )
    size, words = F.expr("(place >> 14) & 131071L"), F.expr("place & 16383L")
    met = found.join(shared, "h").select(
        "doc_id",
        F.expr("place >> 31").alias("start"),
        size.alias("size"),
        "before",
        (F.col("before") + words).alias("after"),
        "first_doc",
    )
    met = met.dropDuplicates(["doc_id", "start"]).withColumn("kept", F.col("doc_id") == F.col("first_doc"))
    # whoever else holds a chunk: a passage goes on where its next chunk stands in any other document
    order = Window.partitionBy("doc_id").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    end = F.max(F.col("start") + F.col("size")).over(earlier)
    fresh = F.col("start") - F.coalesce(end, F.lit(-BRIDGE - 1)) > BRIDGE
    turned = fresh | (F.col("kept") != F.lag("kept").over(order))
    runs = met.withColumn("fresh", fresh.cast("int")).withColumn("turned", turned.cast("int"))
    runs = runs.withColumn("run", F.sum("fresh").over(order)).withColumn("piece", F.sum("turned").over(order))
    pieces = runs.groupBy("doc_id", "run", "piece", "kept").agg(
        F.min("start").alias("start"),
        (F.max(F.col("start") + F.col("size")) - F.min("start")).alias("n_bytes"),
        F.min("before").alias("before"),
        F.max("after").alias("after"),
        F.min("first_doc").alias("first_doc"),
    )
    whole = Window.partitionBy("doc_id", "run")
    length = (F.max("after").over(whole) - F.min("before").over(whole)).cast("long")
    # pieces of one passage that different documents keep are rows of their own
    return (
        pieces.withColumn("n_words", length)
        .where(F.col("n_words") >= min_words)
        .select("doc_id", "start", "n_bytes", "n_words", "first_doc", "kept")
    )


def cut_repeats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` without the passages that another document keeps; bytes cut inside a character take
    the whole character. A document's spans are no more than its text is long."""
    spans = passages.where("not kept").groupBy(F.col("doc_id").alias("cut__id")).agg(
        F.sort_array(F.collect_list(F.struct("start", "n_bytes"))).alias("cut__spans")
    )

    @F.pandas_udf("string")
    def without(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, cuts):
            if text is not None and spans is not None:
                raw, parts, at = text.encode(), [], 0
                for s in spans:
                    parts.append(raw[at : max(at, s["start"])])
                    at = max(at, s["start"] + s["n_bytes"])
                text = b"".join([*parts, raw[at:]]).decode(errors="ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    joined = docs.join(spans, docs["doc_id"] == spans["cut__id"], "left")
    return joined.withColumn("text", without("text", "cut__spans")).drop("cut__id", "cut__spans")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of every document that also stands in another document."""
    return repeated_passages(table(spark, sf_dir, "documents"))
