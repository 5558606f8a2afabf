"""Streams over files that Spark writes from the tables; results equal the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.operators import kb
from kbweave.operators.ordered_text import assemble_utf8
from kbweave.plans.build import build_from_notes
from kbweave.plans.registry import query, table
from kbweave.plans.registry.chat import ANSWERS_SQL, captured_lines
from kbweave.plans.registry.sources import _LOG_SQL, log_lines
from kbweave.session import scratch_path
from kbweave.sources.streams import sse_content, sse_line
from kbweave.streaming.answers import stream_answers
from kbweave.streaming.ingest import stream_into_kb
from kbweave.streaming.logs import stream_logs
from kbweave.streaming.revisions import rocksdb_state, stream_revisions

_FILES = 4


def _streamed(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """The rows as a file stream of several micro-batches, and a folder for its checkpoint and sink."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    files = max(_FILES, spark.sparkContext.defaultParallelism)
    df.repartition(files).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(f"{path}/in")
    return stream, path


def _finish(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there and read its sink."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_answers", f"SELECT *, true AS complete FROM ({ANSWERS_SQL})")
def stream_answers_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a response arrive in different micro-batches."""
    stream, path = _streamed(captured_lines(spark, sf_dir), "answers")
    return _finish(stream_answers(stream, timeout_ms=None), path)


@query(
    "stream_revisions",
    f"""
WITH told AS ({ANSWERS_SQL})
SELECT *, 1 AS revision, true AS complete FROM told
UNION ALL SELECT response_id, part, '>' || answer, 2, true FROM told WHERE response_id % 5 = 0 AND part = 0
""",
)
def stream_revisions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, then the first lines of two in five responses once more: changed ones give a second revision, equal ones nothing."""
    path = scratch_path(spark, "revisions")
    lines = captured_lines(spark, sf_dir)
    first = lines.where((F.col("seq") == 0) & (F.col("response_id") % 5 < 2))
    changed = sse_line(F.concat(F.lit(">"), F.coalesce(sse_content(F.col("value")), F.lit(""))))
    again = first.withColumn("value", F.when(F.col("response_id") % 5 == 0, changed).otherwise(F.col("value")))
    for number, part in enumerate((lines, again)):
        part.repartition(max(_FILES, spark.sparkContext.defaultParallelism)).write.parquet(f"{path}/in/{number}")
        stream = stream_revisions(spark.readStream.schema(lines.schema).parquet(f"{path}/in/*"))
        with rocksdb_state(spark):
            found = _finish(stream, path)
    return found


@query(
    "stream_ingest",
    """
WITH n AS (SELECT role AS source, trim(text, E' \\n\\t\\r') AS t, conv_id * 1000 + turn AS note_id FROM conversations
           WHERE trim(text, E' \\n\\t\\r') <> ''),
s AS (SELECT *, CASE WHEN length(t) > 500 THEN ceil((length(t) - 100) / 400)::BIGINT ELSE 1 END AS c FROM n)
SELECT source, note_id, c AS chunks, length(t)::BIGINT + greatest(c - 1, 0) * 100 AS chars, 64 AS dimension FROM s
""",
)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes arrive by two streams of one name, each half of them in micro-batches; all rows are there."""
    notes = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"),
        F.col("role").alias("title"),
        F.col("text").alias("content"),
    )
    target = scratch_path(spark, "ingest-kb")
    for half in range(2):
        stream, path = _streamed(notes.where(F.col("note_id") % 2 == half), "ingest")
        stream_into_kb(stream, build_from_notes, target, f"{path}/checkpoint", "notes").awaitTermination()
    title = F.regexp_replace("source", r" \(BLK \d+/\d+\)$", "")
    rows = kb.read(spark, target).groupBy(title.alias("source"), F.shiftright("id", 20).alias("note_id"))
    return rows.agg(
        F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"), F.max("dimension").alias("dimension")
    )


@query("stream_logs", f"WITH {_LOG_SQL} SELECT ts, level, tag, message FROM l WHERE level IN ('W', 'E') AND tag = 'error'")
def stream_logs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries keep the lines below their first one."""
    path = scratch_path(spark, "logs")
    log_lines(spark, sf_dir).select("value").repartition(_FILES).write.text(f"{path}/in")
    stream_logs(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", 2, min_level="WARNING", tag="error").awaitTermination()
    return spark.read.schema("ts timestamp, level string, tag string, message string").parquet(f"{path}/out").drop("batch")


@query(
    "byte_pieces",
    """
WITH c AS (
  SELECT conv_id * 1000 + turn AS response_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i
  FROM conversations WHERE text <> ''),
p AS (SELECT *, sum(strlen(ch)) OVER (PARTITION BY response_id ORDER BY i) - strlen(ch) AS start FROM c)
SELECT response_id, (start // 40)::BIGINT AS part, string_agg(ch, '' ORDER BY i) AS answer FROM p GROUP BY ALL
""",
)
def byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut into pieces of five bytes, through the middle of characters, and joined again in parts of eight pieces."""
    data = F.encode("text", "UTF-8")
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / 5).cast("int")),
        lambda i: F.unhex(F.substring(F.hex(data), i * 10 + 1, F.lit(10))),
    )
    turns = table(spark, sf_dir, "conversations").where(F.col("text") != "")
    exploded = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id"), F.posexplode(pieces).alias("seq", "bytes")
    )
    return assemble_utf8(exploded, ["response_id"], "seq", "bytes", "answer", positions=8)
