"""A corpus pipeline over ``documents``: toxic documents out, exact and near copies out, sources
mixed to target weights, the rest encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
they were given. A row is named by its id and its text, so different texts under one id, or under
none, are documents of their own; of rows that repeat both, one stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, exact_dedup, mixing, simhash, toxicity
from trailmark.llm.common import map_texts, named, staged, table


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _only(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text key are among ``keepers`` (doc_id, key, rows): one shuffle
    of the documents, and a second grouping only where a row that stays is there several times."""
    keepers = staged(keepers, "keepers")
    marked = docs.withColumn("only__key", _text_key())
    names = keepers.select(F.col("doc_id").alias("only__id"), F.col("key").alias("only__k"))
    same = marked["doc_id"].eqNullSafe(names["only__id"]) & (marked["only__key"] == names["only__k"])
    # as many names as documents stay: never broadcast
    left = marked.join(names.hint("merge"), same, "left_semi")
    if not keepers.where("rows > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", "only__key"])
    return left.drop("only__key")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    shared = spark.sparkContext.broadcast(model)
    scored = map_texts(docs, docs.columns, "toxic__score double", lambda ts: {"toxic__score": shared.value.scores(ts)})
    return scored.where("toxic__score < 0.5").drop("toxic__score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest id."""
    found = exact_dedup.exact_dedup(docs, exact_dedup.by_hash(), text_key=_text_key())
    keepers = found.groupBy("doc_id", F.col("text_key").alias("key")).agg(
        F.max("kept").alias("kept"), F.count("*").alias("rows")
    )
    return _only(docs, keepers.where("kept").drop("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id, then the smallest hash of its text."""
    found = simhash.simhash_dedup(docs.select("doc_id", "text", _text_key().alias("key")), ("doc_id", "key"))
    rows = found.groupBy("root", "doc_id", "key").agg(F.count("*").alias("rows"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "rows")
    least = rows.groupBy("root").agg(F.min(first).alias("first"))
    return _only(docs, least.select("first.doc_id", "first.key", "first.rows"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as raking their token weights to source, language and topic targets asks; a
    row that the mix takes several times is there several times."""
    cells = staged(mixing.cells_of(mixing.with_topics(docs, ["source", "lang"])), "cells")
    chances = staged(mixing.repeats(staged(mixing.rake(cells), "raked")), "chances")
    rows = mixing.sampled(mixing.with_topics(docs, docs.columns), chances)
    taken = rows.where("mix__kept").withColumn("mix__time", F.explode(F.expr("sequence(1L, mix__repeats)")))
    return taken.select(*[named(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of every text."""
    return bpe.encode(docs, ["doc_id", "lang", "source"], bpe.vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]

# SQL can express neither the models nor the fingerprints; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
