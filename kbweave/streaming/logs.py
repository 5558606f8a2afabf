"""Log files as a stream of entries, and their counts by time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kbweave.operators.answers import filter_log
from kbweave.sources.log_follow import follow_logs
from kbweave.sources.streams import join_entries, parse_log_lines

ENTRY_SCHEMA = "ts timestamp, level string, tag string, message string"


def stream_logs(
    spark: SparkSession, path: str, target: str, checkpoint: str, files_per_batch: int = 100, available_now: bool = True, **filters
) -> StreamingQuery:
    """Write the entries of new log files with all their lines, filtered like :func:`filter_log`, as Parquet below ``target``.

    A file arrives complete, as rotated logs do, but is read line by line and split by split. Each micro-batch has a folder
    ``batch=<number>`` of its own, which a batch that runs again replaces.
    """

    def write(entries: DataFrame, number: int) -> None:
        filter_log(entries, **filters).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _started(_new_files(spark, path, files_per_batch), write, checkpoint, available_now)


def stream_growing_logs(
    spark: SparkSession, path: str, target: str, checkpoint: str, idle_seconds: float = 3600, available_now: bool = True, **filters
) -> StreamingQuery:
    """The same for files that grow: each entry is written once, when it is whole (see :func:`follow_logs`)."""

    def write(entries: DataFrame, number: int) -> None:
        filter_log(entries, **filters).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return _started(follow_logs(spark, path, idle_seconds), write, checkpoint, available_now)


def _new_files(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _started(lines: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool) -> StreamingQuery:
    def entries(batch: DataFrame, number: int) -> None:
        placed = batch if "place" in batch.columns else batch.withColumn("place", F.monotonically_increasing_id())
        write(parse_log_lines(join_entries(placed, "file", "block", "place").drop("file")), number)

    writer = lines.writeStream.foreachBatch(entries).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- counts by window ----------------------------------------------------------------

KEYS = ["window_start", "window_end", "level", "tag"]
_COUNTS = "window_start timestamp, window_end timestamp, level string, tag string, entries long"
_TIMES = "latest timestamp, batch int"


def stream_log_counts(
    spark: SparkSession, path: str, target: str, checkpoint: str, width: str = "1 hour", delay: str = "1 hour", files_per_batch: int = 100,
    available_now: bool = True,
) -> StreamingQuery:
    """Count log entries by event-time window, level and tag; read them with :func:`log_counts` and :func:`late_entries`.

    The watermark of a batch is the latest time of all batches before it less ``delay``; a window that ends at or before it is closed.
    An entry of a closed window goes to the side table with its lines instead of being dropped unseen, as a built-in watermark would; one
    without a time goes there too. A batch adds its own partial counts, so there is no state to keep, hot windows are added up before they
    are shuffled, and a batch that runs again finds the same watermark and replaces its own folders.
    """

    def write(entries: DataFrame, number: int) -> None:
        before = _latest(spark, target, number)
        slot = F.window("ts", width)
        placed = entries.withColumns({"window_start": slot["start"], "window_end": slot["end"]})
        closed = F.lit(False) if before is None else F.col("window_end") <= F.lit(before) - F.expr(f"INTERVAL {delay}")
        late = F.col("ts").isNull() | closed
        folder = f"{target}/entries/batch={number}"
        undated = entries.where("ts is null").withColumns({"window_start": F.lit(None).cast("timestamp"), "window_end": F.lit(None).cast("timestamp")})
        rows = placed.where("ts is not null").unionByName(undated.select(*placed.columns))
        rows.withColumn("late", F.coalesce(late, F.lit(False))).write.mode("overwrite").partitionBy("late").parquet(folder)
        stored = spark.read.schema(f"{ENTRY_SCHEMA}, window_start timestamp, window_end timestamp, late boolean").parquet(folder)
        counts = stored.where("not late").groupBy(*KEYS).agg(F.count("*").alias("entries"))
        counts.write.mode("overwrite").parquet(f"{target}/counts/batch={number}")
        stored.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{target}/times/batch={number}")

    return _started(_new_files(spark, path, files_per_batch), write, checkpoint, available_now)


def _latest(spark: SparkSession, target: str, number: int | None = None):
    """The latest time of the batches before ``number``, or of all; None if there is none."""
    if number == 0:
        return None
    times = spark.read.schema(_TIMES).parquet(f"{target}/times")
    times = times if number is None else times.where(F.col("batch") < number)
    return times.agg(F.max("latest")).first()[0]


def log_counts(spark: SparkSession, target: str, delay: str = "1 hour") -> DataFrame:
    """``window_start, window_end, level, tag, entries, closed``: the counts of all batches so far."""
    counts = spark.read.schema(f"{_COUNTS}, batch int").parquet(f"{target}/counts")
    latest = F.lit(_latest(spark, target)).cast("timestamp")
    closed = F.coalesce(F.col("window_end") <= latest - F.expr(f"INTERVAL {delay}"), F.lit(False))
    return counts.groupBy(*KEYS).agg(F.sum("entries").alias("entries")).withColumn("closed", closed)


def late_entries(spark: SparkSession, target: str) -> DataFrame:
    """The entries that came after their window was closed, or have no time."""
    rows = spark.read.schema(f"{ENTRY_SCHEMA}, batch int, late boolean").parquet(f"{target}/entries")
    return rows.where("late").select("ts", "level", "tag", "message")
