"""Incremental knowledge-base growth."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kbweave.functions.text import file_name
from kbweave.operators import kb
from kbweave.sources.files import extract_files, usable


def stream_into_kb(
    incoming: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    kb_path: str,
    checkpoint: str,
    name: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Build each micro-batch into rows and append them.

    The batch label comes from the stream's name, the id its checkpoint keeps and the
    batch number: a micro-batch that runs again after a failure replaces its own rows,
    another stream of the same name does not. Rows of another dimension than their
    collection fail the batch.
    """
    started = threading.Event()
    stream: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        started.wait()
        kb.append(build(batch), kb_path, f"{name}-{stream[0]}-{number}", rebalance=True)

    writer = incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    query = writer.start()
    stream.append(query.id)
    started.set()
    return query


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New files below a folder as a stream of ``path, file_name, length, content``."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return files.select("path", file_name(F.col("path")).alias("file_name"), "length", "content")


def usable_files(files: DataFrame) -> DataFrame:
    """Extracted text of a batch of watched files, as a build takes it."""
    return usable(extract_files(files, clean=False))
