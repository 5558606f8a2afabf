"""Large inputs in pieces: datasets and texts of many splits, hash tables beside a knowledge base, growing and counted logs."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.operators.datasets import format_elements
from kbweave.operators.hash_tables import TableSpec, expected_similarity, read_tables, search_tables, write_tables
from kbweave.operators.pruned_search import search_cells, write_cells
from kbweave.operators.search import search_topk
from kbweave.plans.registry import query, table
from kbweave.plans.registry.datasets import PAIRS_SQL, _json, _pairs
from kbweave.plans.registry.retrieval import DEPTH, HITS_SQL, questions, stored_kb
from kbweave.plans.registry.sources import _LOG_SQL, log_lines
from kbweave.plans.registry.text import CHUNKS_SQL
from kbweave.plans.registry.vectors import _TOPK_SQL, _centroids
from kbweave.plans.retrieve import embed_questions
from kbweave.session import estimated_bytes, scratch_path, spread
from kbweave.sources.json_arrays import read_elements
from kbweave.sources.long_texts import read_windows
from kbweave.streaming.logs import ENTRY_SCHEMA, late_entries, log_counts, stream_growing_logs, stream_log_counts

_SPLIT = "spark.sql.files.maxPartitionBytes"


@contextlib.contextmanager
def _splits(spark: SparkSession, source: DataFrame, least: int) -> Iterator[None]:
    """While it lasts, a table of this size is read in some 64 splits, so that small tables too are cut within their files."""
    before, conf = spark.conf.get(_SPLIT), spark.conf
    open_cost = "spark.sql.files.openCostInBytes"
    cost = conf.get(open_cost)
    conf.set(_SPLIT, str(min(max(estimated_bytes(source) // 64, least), 128 << 20)))
    conf.set(open_cost, "1k")
    try:
        yield
    finally:
        conf.set(_SPLIT, before)
        conf.set(open_cost, cost)


# --- datasets and texts ------------------------------------------------------------------


def _as_arrays(items: DataFrame, path: str) -> None:
    """One file a task, each a JSON array of its rows' texts, an element a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, held = False, None
        for batch in batches:
            lines = batch.column(0).to_pylist()
            out = [] if begun else ["["]
            begun = True
            for line in lines:
                if held is not None:
                    out.append(held + ",")
                held = line
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([held, "]"] if held is not None else ["]"], pa.string())], names=["value"])

    items.mapInArrow(run, "value string").write.text(path)


@query(
    "dataset_pieces",
    f"""
WITH {PAIRS_SQL}
SELECT 'alpaca' AS format, '指令: ' || q || E'\\n\\n输出: ' || r AS content, true AS numbered FROM pairs
WHERE length('指令: ' || q || E'\\n\\n输出: ' || r) >= 10
""",
)
def dataset_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs in a few large arrays, read split by split; each file's texts are numbered from 0 without a gap."""
    pairs = _pairs(spark, sf_dir)
    path = scratch_path(spark, "arrays")
    _as_arrays(spread(pairs).select(_json(instruction=F.col("q"), output=F.col("r"))), path)
    with _splits(spark, table(spark, sf_dir, "conversations"), 64 << 10):
        found = format_elements(read_elements(spark, path))
        target = scratch_path(spark, "formatted")
        found.write.parquet(target)
    rows = spark.read.schema(found.schema).parquet(target)
    whole = rows.groupBy("file").agg(
        (F.countDistinct("chunk_index") == F.max("total_chunks")).alias("all"), (F.count("*") == F.max("chunk_index") + 1).alias("dense")
    )
    return rows.join(whole, "file").select("format", "content", (F.col("all") & F.col("dense")).alias("numbered"))


_FILES_SQL = CHUNKS_SQL.replace("FROM documents)", "FROM files)")


@query(
    "text_pieces",
    f"""
WITH files AS (
  SELECT doc_id // 10000 AS doc_id, '' AS lang, '' AS source, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS text
  FROM documents GROUP BY doc_id // 10000),
{_FILES_SQL}
SELECT doc_id AS part, chunk_index, total_chunks, content FROM chunks
""",
)
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 10,000 documents each, cut into windows split by split."""
    documents = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "texts")
    parts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("value"), F.floor(F.col("doc_id") / 10_000).cast("long").alias("part"))
    parts.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    with _splits(spark, documents, 64 << 10):
        found = read_windows(spark, path)
        target = scratch_path(spark, "windows")
        found.write.parquet(target)
    rows = spark.read.schema(found.schema).parquet(target)
    part = F.regexp_extract("file", r"/part=(-?\d+)/", 1).cast("long")
    return rows.select(part.alias("part"), "chunk_index", "total_chunks", "content")


# --- hash tables ---------------------------------------------------------------------------

_SPEC = TableSpec(rows_per_bucket=64)


def _vector_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Questions, and tables of the vectors in three batches."""
    embeddings = table(spark, sf_dir, "embeddings")
    rows = embeddings.select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("b"), F.col("vec_id") % 3).alias("batch"))
    path = scratch_path(spark, "hash-tables")
    write_tables(rows, path, _SPEC)
    return _centroids(embeddings), read_tables(spark, path, rows)


@query("vector_topk_tables", _TOPK_SQL)
def vector_topk_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every bucket looked into, the tables give the exact search's rows."""
    asked, tables = _vector_tables(spark, sf_dir)
    return search_tables(asked, tables, 20, recall=1.0, spec=_SPEC)


@query(
    "vector_topk_recall",
    f"""
WITH exact AS ({_TOPK_SQL})
SELECT count(*) AS wanted, true AS enough, true AS similar FROM exact
""",
)
def vector_topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all exact hits at least nine in ten are found, with the same similarities."""
    asked, tables = _vector_tables(spark, sf_dir)
    kb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = search_tables(asked, tables, 20, recall=0.95, similarity=expected_similarity(asked, kb, 20), spec=_SPEC)
    return _recall(search_topk(asked, kb, 20), near, ["id"])


@query("vector_topk_pruned", _TOPK_SQL)
def vector_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact search over cells with balls, which leaves out the cells that cannot hold a hit."""
    embeddings = table(spark, sf_dir, "embeddings")
    rows = embeddings.select(F.col("vec_id").alias("id"), "embedding")
    path = scratch_path(spark, "cells")
    write_cells(rows, path, rows_per_cell=max(32, rows.count() // 64))
    return search_cells(_centroids(embeddings), path, rows, 20).hits


def _recall(exact: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    found = exact.join(near.select("query_id", *keys, F.col("similarity").alias("_near")), ["query_id", *keys], "left")
    hit = F.col("_near").isNotNull()
    return found.agg(
        F.count("*").alias("wanted"), (F.count_if(hit) >= 0.9 * F.count("*")).alias("enough"),
        (F.count_if(hit & (F.col("_near") != F.col("similarity"))) == 0).alias("similar"),
    )


@query(
    "kb_near_search",
    f"""
WITH {HITS_SQL}
SELECT count(*) AS wanted, true AS enough, true AS similar FROM hits
""",
)
def kb_near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions to a stored knowledge base through hash tables of it, against the exact search."""
    kb = stored_kb(spark, sf_dir)
    spec = TableSpec(tables=2, rows_per_bucket=max(64, kb.count() // 256))  # each table is a copy of the vectors
    path = scratch_path(spark, "kb-tables")
    write_tables(kb.select("id", "collection", "batch", "row_id", "embedding"), path, spec)
    tables = read_tables(spark, path, kb)
    asked = embed_questions(questions(spark, sf_dir)).persist()
    near = search_tables(asked, tables, DEPTH, recall=0.95, similarity=expected_similarity(asked, kb, DEPTH), spec=spec)
    return _recall(search_topk(asked, kb, DEPTH), near, ["id", "collection", "batch", "row_id"])


# --- logs ------------------------------------------------------------------------------------


@query(
    "log_window_counts",
    f"""
WITH {_LOG_SQL}, placed AS (SELECT *, event_id % 50 = 7 AS held, time_bucket(INTERVAL 6 HOURS, ts) AS window_start FROM l),
mark AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM placed WHERE NOT held),
counted AS (SELECT * FROM placed, mark WHERE NOT held OR window_start + INTERVAL 6 HOURS > mark)
SELECT window_start, window_start + INTERVAL 6 HOURS AS window_end, level, tag, count(*) AS entries,
  window_start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM l) - INTERVAL 1 DAY AS closed FROM counted GROUP BY ALL
""",
)
def log_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in order of time, and every fiftieth only after all others: those of closed windows are not counted."""
    return log_counts(spark, _counted_logs(spark, sf_dir), "1 day")


@query(
    "log_late_entries",
    f"""
WITH {_LOG_SQL}, mark AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM l WHERE event_id % 50 <> 7)
SELECT ts, level, tag, message FROM l, mark WHERE event_id % 50 = 7 AND time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS <= mark
""",
)
def log_late_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those late ones, with all their lines."""
    return late_entries(spark, _counted_logs(spark, sf_dir))


def _counted_logs(spark: SparkSession, sf_dir: str) -> str:
    """Two runs of one stream: the log but for every fiftieth entry, then those."""
    path = scratch_path(spark, "counted-logs")
    lines = log_lines(spark, sf_dir)
    held = F.col("event_id") % 50 == 7
    for number, part in enumerate((lines.where(~held), lines.where(held))):
        part.select("value").repartition(4).write.text(f"{path}/in/{number}")
        stream_log_counts(spark, f"{path}/in/*", f"{path}/out", f"{path}/checkpoint", "6 hours", "1 day").awaitTermination()
    return f"{path}/out"


@query("growing_logs", f"WITH {_LOG_SQL} SELECT ts, level, tag, message FROM l")
def growing_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files grow between two runs of a stream, and are cut within an entry at first: each entry is there once and whole."""
    path = scratch_path(spark, "growing-logs")
    lines = log_lines(spark, sf_dir).withColumn("number", F.floor(F.col("event_id") / 2_000))
    for share in (0.6, 1.0):
        _written_files(lines, f"{path}/in", share).collect()  # one row a file
        idle = 0 if share == 1.0 else 3600
        stream_growing_logs(spark, f"{path}/in", f"{path}/out", f"{path}/checkpoint", idle_seconds=idle).awaitTermination()
    return spark.read.schema(f"{ENTRY_SCHEMA}, batch int").parquet(f"{path}/out").drop("batch")


def _written_files(lines: DataFrame, folder: str, share: float) -> DataFrame:
    """Write each file of 2,000 entries up to a share of its bytes; a task that runs again writes the same file."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        number = int(rows["number"].iloc[0])
        data = "".join(value + "\n" for value in rows.sort_values("event_id")["value"]).encode()
        store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{number}.log") as out:
            out.write(data[: int(len(data) * share)])
        return pd.DataFrame({"number": [number]})

    return lines.groupBy("number").applyInPandas(write, "number long")
