"""Folds by crc32 of the id, bounded samples of labelled documents, and training on them in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import release


Model = TypeVar("Model")


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text modulo folds; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def bounded(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """About limit rows at most for each value of by, those with the least hashes of their id; however many rows and values
    there are. Null values are a value."""
    counts = rows.groupBy(F.col(by).alias("by_")).agg(share(F.count("*"), limit).alias("least_"))
    hash_ = F.xxhash64(F.col("id"), F.lit("sample")).bitwiseAND(F.lit((1 << 63) - 1))
    return rows.withColumn("hash_", hash_).join(counts, F.col(by).eqNullSafe(F.col("by_"))).where("hash_ <= least_").drop("hash_", "by_", "least_")


def share(n: Column, limit: int) -> Column:
    """The 63-bit number below which limit of n random ones fall."""
    return F.least(F.lit(float(1 << 63)) * (F.lit(float(limit)) / n), F.lit(float((1 << 63) - 1024))).cast("long")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y) of about limit labelled documents of each class outside the held-out fold.

    The sampled labels are bounded by limit, so they are broadcast; other texts are never shuffled. Of rows with the same id,
    one counts: that with the least text.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    known = bounded(known.where(fold("id", folds) != held_out), "y", limit)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return rows.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")


def fit_in_task(sample: DataFrame, fit: Callable[[pa.Table], Model]) -> Model:
    """fit over a bounded sample, ordered by id and text, in one task: the driver gets the model alone, and a lost executor
    costs one retry."""
    kinds = [pa.int32() if f.dataType.typeName() == "integer" else pa.string() for f in sample.drop("id").schema]
    empty = pa.table({name: pa.array([], kind) for name, kind in zip(sample.drop("id").columns, kinds, strict=True)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]).drop_columns("id").cast(empty.schema) for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.concat_tables([empty, *parts]).combine_chunks()))], pa.binary())], names=["model"])

    got = sample.repartition(1).sortWithinPartitions("id", "text").mapInArrow(run, "model binary").collect()
    model = pickle.loads(got[0].model) if got else fit(empty)
    del got
    release(sample.sparkSession)
    return model
