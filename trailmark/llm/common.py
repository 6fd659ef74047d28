"""Helpers that several operators share: tables, staging, text batches, labelled samples."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import shared_dir

# Text bytes that one numpy kernel call works on; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 20
# Rows of one Arrow batch that carries texts.
BATCH_ROWS = 1000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: it survives lost executors,
    is read with column pruning, and is never computed twice."""
    path = f"{shared_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers that read texts: at most BATCH_ROWS rows a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def named(column: str) -> Column:
    """A column by its literal name, whatever dots or backticks it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def fold_case(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id, written as text, leaves no remainder by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay within ``limit`` bytes, or single rows."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x) + 1
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    docs: DataFrame,
    keep: list[str],
    added: str,
    work: Callable[[list[bytes]], dict[str, object]],
    text: str = "text",
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with columns that ``work`` derives from the texts.

    ``added`` is their DDL; ``work`` gets the UTF-8 texts of a batch and returns, by column name,
    one value per text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    small_batches(docs.sparkSession)
    names = list(dict.fromkeys([*keep, text]))
    # mapInArrow looks columns up by name, which dots would break: they go by number
    source = docs.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)])
    extra = StructType.fromDDL(added)
    kept = [StructField(c, source.schema[names.index(c)].dataType) for c in keep]
    schema = StructType(kept + extra.fields)
    arrow = to_arrow_schema(extra)
    places = [names.index(c) for c in keep]
    text_at = f"c{names.index(text)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = work(texts_of(batch, text_at))
            arrays = [batch.column(i) for i in places]
            arrays += [pa.array(new[f.name], type=f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *arrow.names])

    return source.mapInArrow(run, schema)


def _marked(labels: DataFrame, label: str, values: Iterable[int]) -> DataFrame:
    """(doc_id, y) of the labels with one of ``values`` that are not held out, an id once."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(*values) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )


def prior_shift(docs: DataFrame, labels: DataFrame, label: str, sample: np.ndarray) -> float:
    """What the log odds of label 1 over 0 are higher by among all labelled documents that are not held
    out than in ``sample``, the labels of a ``labelled_sample``. A model fitted to the sample with
    this added to its intercept gives the same odds however many rows the sample leaves out."""
    taken = np.array([(sample == 0).sum(), (sample == 1).sum()])
    if not taken.all():
        return 0.0
    # as many labels as documents: never broadcast
    rows = docs.select("doc_id").join(_marked(labels, label, (0, 1)).hint("merge"), "doc_id")
    there = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    return float(np.log(there[1] / there[0]) - np.log(taken[1] / taken[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: dict[int, int]) -> DataFrame:
    """At most ``rows[v]`` labelled documents of each label ``v`` that are not held out, as
    (doc_id, text, y). The bound is on the labelled rows that a classifier is fitted to; which rows
    it takes depends on a hash of the id alone. Ids in ``labels`` more than once count once, with
    their larger label."""
    marked = _marked(labels, label, rows)
    picked = None
    for value, most in rows.items():
        part = marked.where(F.col("y") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # bounded by the sum of rows
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def flat_texts(
    docs: DataFrame,
    keep: list[str],
    ddl: str,
    work: Callable[[Iterator[tuple[pa.RecordBatch, list[bytes]]]], Iterator[dict[str, object]]],
    text: str = "text",
) -> DataFrame:
    """Any number of rows from the texts: ``work`` gets a task's batches (with the columns ``keep``)
    and their texts, and yields the columns of ``ddl``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for new in work((b, texts_of(b, text)) for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], type=f.type) for f in arrow], schema=arrow)

    return docs.select(*[named(c) for c in dict.fromkeys([*keep, text])]).mapInArrow(run, schema)
