"""Shared helpers: label folds, safe column names, written intermediate tables, batch views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.session import scratch_path

FOLDS = 5
SAMPLE_ROWS = 20_000
BROADCAST_ROWS = 200_000


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 5; fold 0 is held out. A null id counts as the text ``null``."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")), F.lit(FOLDS))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once below the shared folder and read back.

    Cuts lineage: a lost executor costs its running tasks, not the stages before.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it was counted to be small; else joins shuffle it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts of at most ``rows`` labelled documents outside the held-out fold, with their label and fold.

    ``rows`` is the documented bound of the fit. The ids come in an order that depends on the id alone,
    so the sample is the same on every run; being bounded (16 bytes a row), they are broadcast and
    the text table is not shuffled. Rows without id or label take no part.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = ids.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.withColumn("fold", fold()).filter("fold <> 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(ids), "doc_id")


#: Caches of models that a worker process keeps from task to task. Workers outlive a stage; an operator without such a model lets them go.
REMEMBERED: list = []


def forget() -> None:
    for cache in REMEMBERED:
        cache.cache_clear()


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with its ``text`` column as bytes; null reads as empty."""
    forget()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text")).cast(pa.binary())
        yield batch, [value or b"" for value in column.to_pylist()]


class WordIds(dict):
    """64-bit hash of a word, remembered up to a bound so that memory stays flat."""

    def __init__(self, bound: int = 1 << 17, seed: int = 0):
        import xxhash

        super().__init__()
        self.bound, self.seed, self.hash = bound, seed, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = self.hash(word, seed=self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def spread(df: DataFrame) -> DataFrame:
    """One task per core for an input of fewer scan splits than cores; any other is left alone, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
