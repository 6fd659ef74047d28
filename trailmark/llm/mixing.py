"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, language, topic) are raked to target shares of sources, languages and
topics; documents are then sampled by the calibrated probability of their cell. Sources may be very
many: their factors live in Spark, and only the language-by-topic table, bounded by its margins,
visits the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.common import map_texts, named, slices, staged, table

PLANES = 3  # a topic is the cell of the document's word bag among three random hyperplanes
LONG_WORD = 8  # bytes; shorter words say more about the language than about the topic
TEMPER = 0.7  # default targets: shares to this power, so that large sources weigh less
KEPT = 0.8  # tokens of the mix, repeats included, as a share of all tokens
ROUNDS = 50
TOLERANCE = 1e-9
MARGIN_CELLS = 100_000  # bound on languages x topics

_GAP = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(64)], dtype=np.uint64)


def topics(texts: list[bytes]) -> dict[str, object]:
    """``mix__topic`` (0 to 2^PLANES - 1) and ``mix__tokens`` (words between white space) of texts."""
    topic = np.zeros(len(texts), np.int32)
    tokens = np.zeros(len(texts), np.int64)
    for lo, hi in slices(texts):
        part = texts[lo:hi]
        buf = np.frombuffer(b" " + b" ".join(part) + b" ", np.uint8)
        gap = _GAP[buf]
        starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        if not len(starts):
            continue
        ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        size = ends - starts
        place = np.arange(len(buf)) - np.repeat(
            np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(buf)]]))
        )
        value = np.where(gap, 0, buf).astype(np.uint64) * _POWERS[place & 63]
        h = np.add.reduceat(value, starts)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])]) + 1
        first = np.searchsorted(starts, bounds)
        tokens[lo:hi] = np.diff(first)
        long = size >= LONG_WORD
        for k in range(PLANES):
            side = np.where(long, ((h >> np.uint64(k)) & np.uint64(1)).astype(np.int64) * 2 - 1, 0)
            total = np.concatenate([[0], np.cumsum(side)])
            topic[lo:hi] |= ((total[first[1:]] - total[first[:-1]]) > 0).astype(np.int32) << k
    return {"mix__topic": topic, "mix__tokens": tokens}


def with_topics(docs: DataFrame, keep: list[str]) -> DataFrame:
    return map_texts(docs, keep, "mix__topic int, mix__tokens long", topics)


def margin(column: str) -> Column:
    """A margin's value; rows without one form a class of their own."""
    return F.coalesce(named(column).cast("string"), F.lit("(none)"))


def _tempered(mass: dict) -> dict:
    raised = {k: v**TEMPER for k, v in mass.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def rake(
    cells: DataFrame,
    source_targets: DataFrame | None = None,
    lang_targets: dict[str, float] | None = None,
    topic_targets: dict[int, float] | None = None,
) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``ratio``: wanted over present share of tokens.

    Targets are shares by margin: (source, share) and two dicts. A margin without targets takes its
    present shares, tempered. Cells without tokens, and margins without a target, get ratio 0.
    Raking stops when no language or topic moves by more than TOLERANCE.
    """
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("ratio", F.lit(0.0))
    by_source = cells.groupBy("source").agg(F.sum("tokens").alias("mass"))
    if source_targets is None:
        norm = by_source.agg(F.sum(F.pow("mass", F.lit(TEMPER)))).first()[0]
        source_targets = by_source.select("source", (F.pow("mass", F.lit(TEMPER)) / norm).alias("share"))
    targeted = staged(cells.where("tokens > 0").join(source_targets, "source"), "cells")
    present = targeted.groupBy("lang", "topic").agg(F.sum("tokens").alias("m")).limit(MARGIN_CELLS + 1).collect()
    if len(present) > MARGIN_CELLS:
        raise ValueError(f"more than {MARGIN_CELLS} pairs of language and topic")
    if lang_targets is None:
        lang_targets = _tempered({x: sum(r["m"] for r in present if r["lang"] == x) for x in {r["lang"] for r in present}})
    if topic_targets is None:
        topic_targets = _tempered({x: sum(r["m"] for r in present if r["topic"] == x) for x in {r["topic"] for r in present}})
    langs, tops = sorted({r["lang"] for r in present}), sorted({r["topic"] for r in present})
    want_l = np.array([lang_targets.get(x, 0.0) for x in langs])
    want_t = np.array([topic_targets.get(x, 0.0) for x in tops])
    b, c = np.ones(len(langs)), np.ones(len(tops))

    def factors() -> DataFrame:
        rows = [(x, y, float(b[i] * c[j])) for i, x in enumerate(langs) for j, y in enumerate(tops)]
        return spark.createDataFrame(rows, "lang string, topic int, f double")

    def weighted() -> DataFrame:
        cell = targeted.join(F.broadcast(factors()), ["lang", "topic"])  # MARGIN_CELLS at most
        per = cell.groupBy("source").agg(F.sum(F.col("tokens") * F.col("f")).alias("s"))
        return cell.join(per, "source").withColumn(
            "w", F.when(F.col("s") > 0, F.col("share") * F.col("f") / F.col("s")).otherwise(0.0)
        )

    for _ in range(ROUNDS):
        got = weighted().groupBy("lang", "topic").agg(F.sum(F.col("tokens") * F.col("w")).alias("m")).collect()
        grid = np.zeros((len(langs), len(tops)))
        for r in got:
            grid[langs.index(r["lang"]), tops.index(r["topic"])] = r["m"]
        if np.abs(grid.sum(1) - want_l).max() < TOLERANCE and np.abs(grid.sum(0) - want_t).max() < TOLERANCE:
            break
        with np.errstate(divide="ignore", invalid="ignore"):
            for _ in range(20):  # languages and topics between themselves, sources held
                up = np.nan_to_num(want_l / grid.sum(1), nan=0.0, posinf=0.0)
                grid, b = grid * up[:, None], b * up
                up = np.nan_to_num(want_t / grid.sum(0), nan=0.0, posinf=0.0)
                grid, c = grid * up, c * up
    done = weighted().select("source", "lang", "topic", (F.col("w") * F.lit(float(total))).alias("ratio"))
    return cells.join(done, ["source", "lang", "topic"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))


def probabilities(raked: DataFrame, kept: float = KEPT) -> DataFrame:
    """``raked`` with ``probability``: the ratio times one rate, at most 1, such that the expected
    tokens are ``kept`` of all, or as many as the positive cells hold. Nothing is taken twice, so cells
    clipped at 1 stay below their targets and the others above; ``repeats`` meets them."""
    total, top, low = raked.agg(
        F.sum("tokens"), F.max("ratio"), F.min(F.when(F.col("ratio") > 0, F.col("ratio")))
    ).first()
    if not total or not top:
        return raked.withColumn("probability", F.lit(0.0))
    lo, hi = kept / top * 1e-3, 1 / low
    for _ in range(3):  # each pass tries 32 rates at once
        rates = np.geomspace(lo, hi, 32)
        sums = raked.agg(
            *[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * float(r))) for r in rates]
        ).first()
        k = int(np.searchsorted(np.array(sums), kept * total))
        lo, hi = rates[max(0, min(k, 31) - 1)], rates[min(k, 31)]
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("ratio") * float(hi)))


def repeats(raked: DataFrame, kept: float = KEPT) -> DataFrame:
    """``raked`` with ``copies``: the ratio times one rate, such that the expected tokens are ``kept``
    of all and every cell has its wanted share of them; and ``probability``, at most 1, of a document
    to be taken at all."""
    total, wanted = raked.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("ratio"))).first()
    rate = kept * total / wanted if wanted else 0.0
    copies = F.col("ratio") * F.lit(float(rate))
    return raked.withColumns({"copies": copies, "probability": F.least(F.lit(1.0), copies)})


def realised(taken: DataFrame) -> DataFrame:
    """(margin, value, share): shares of the tokens in the mix, by source, language and topic, of
    ``sampled`` rows (source, lang, mix__topic, mix__tokens, mix__repeats)."""
    mass = taken.select(
        F.col("mix__tokens") * F.col("mix__repeats"),
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("margin"), value.alias("value"))
            for name, value in (
                ("source", margin("source")), ("lang", margin("lang")), ("topic", F.col("mix__topic").cast("string")),
            )
        ])),
    ).toDF("tokens", "of")
    sums = mass.groupBy("of.margin", "of.value").agg(F.sum("tokens").alias("tokens"))
    total = sums.where("margin = 'topic'").agg(F.sum("tokens")).first()[0]
    share = F.col("tokens") / F.lit(float(total)) if total else F.lit(0.0)
    return sums.select("margin", "value", share.alias("share"))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(
        margin("source").alias("source"), margin("lang").alias("lang"), F.col("mix__topic").alias("topic")
    ).agg(F.sum("mix__tokens").alias("tokens"))


def sampled(rows: DataFrame, cells: DataFrame, seed: int = 5) -> DataFrame:
    """``rows`` with mix__probability, mix__copies, mix__repeats and mix__kept: a hash of the id is the
    draw, so a document's fate does not depend on the order of rows, and rows with one id share it.

    A document is repeated the whole number of its cell's ``copies`` (or ``probability``, if there are
    none), and once more if the draw is below the rest."""
    copies = "copies" if "copies" in cells.columns else "probability"
    chance = cells.select(
        F.col("source").alias("mix__s"), F.col("lang").alias("mix__l"), F.col("topic").alias("mix__t"),
        F.col("probability").alias("mix__probability"), F.col(copies).alias("mix__copies"),
    )
    met = (
        (margin("source") == F.col("mix__s")) & (margin("lang") == F.col("mix__l"))
        & (F.col("mix__topic") == F.col("mix__t"))
    )
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor("mix__copies")
    times = whole + (draw < F.col("mix__copies") - whole).cast("long")
    rows = rows.join(chance, met).drop("mix__s", "mix__l", "mix__t").withColumn("mix__repeats", times)
    return rows.withColumn("mix__kept", F.col("mix__repeats") > 0)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, its probability, whether the mix takes it, and how often: on
    average (copies) and by its draw (repeats).

    Null sources and languages are a class of their own; texts without words have topic 0 and no
    tokens, and if their cell holds no tokens their probability is 0; an empty table gives no rows.
    """
    rows = staged(with_topics(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang"]), "mix")
    cells = staged(repeats(staged(rake(cells_of(rows)), "raked")), "chances")
    return sampled(rows, cells).select(
        "doc_id", "source", "lang", F.col("mix__topic").alias("topic"), F.col("mix__tokens").alias("n_tokens"),
        F.col("mix__probability").alias("probability"), F.col("mix__kept").alias("kept"),
        F.col("mix__copies").alias("copies"), F.col("mix__repeats").alias("repeats"),
    )
