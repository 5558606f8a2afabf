"""Row-multiplying chunk operators: numbering comes from the array position, so nothing shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.functions.chunks import ChunkSpec, fixed_chunks, note_chunks
from kbweave.functions.text import is_blank, trim_blank


def explode_chunks(
    df: DataFrame,
    text: str = "text",
    spec: ChunkSpec = ChunkSpec(),
    chunker: Callable[[Column, ChunkSpec], Column] = fixed_chunks,
) -> DataFrame:
    """Replace ``text`` by ``chunk_index`` (from 0), ``total_chunks`` and ``content``."""
    kept = [c for c in df.columns if c != text]
    pieces = F.when(~is_blank(F.col(text)), chunker(F.col(text), spec))
    return number_pieces(df.select(*kept, pieces.alias("_pieces")), kept, "_pieces")


def number_pieces(df: DataFrame, kept: list[str], pieces: str) -> DataFrame:
    """``kept, chunk_index, total_chunks, content``: one row per array entry.

    The outer generator and the filter behind it are deliberate: for a plain one
    Spark infers ``size(pieces) > 0`` and pushes it below the projection that made
    the pieces, which would compute them twice.
    """
    exploded = df.select(
        *kept, F.size(pieces).alias("total_chunks"), F.posexplode_outer(pieces).alias("chunk_index", "content")
    )
    return exploded.where(F.col("content").isNotNull()).select(*kept, "chunk_index", "total_chunks", "content")


def chunk_metadata(source: Column, chunk_index: Column, extracted_at: Column) -> Column:
    """Metadata of a plain-text chunk; ``extracted_at`` is in epoch milliseconds."""
    return F.to_json(
        F.struct(
            source.alias("source"),
            chunk_index.cast("int").alias("chunkIndex"),
            extracted_at.cast("bigint").alias("extractionTime"),
        )
    )


def dataset_metadata(
    name: Column, file_index: Column, chunk_index: Column, total: Column, extracted_at: Column
) -> Column:
    """Metadata of a chunk that a dataset formatter produced."""
    return F.to_json(
        F.struct(
            name.alias("fileName"),
            file_index.cast("int").alias("fileIndex"),
            chunk_index.cast("int").alias("chunkIndex"),
            total.cast("int").alias("totalChunks"),
            extracted_at.cast("bigint").alias("extractionTime"),
            F.lit("JsonOptimized").alias("processingMethod"),
        )
    )


def default_title(content: Column) -> Column:
    text = trim_blank(content)
    return F.when(F.length(text) > 20, F.concat(F.left(text, F.lit(20)), F.lit("..."))).otherwise(text)


def explode_notes(
    notes: DataFrame, title: str = "title", content: str = "content", spec: ChunkSpec = ChunkSpec()
) -> DataFrame:
    """Valid notes as chunks; split notes carry ``(BLK i/n)`` in their source label."""
    kept = [c for c in notes.columns if c not in (title, content)]
    valid = notes.select(
        *kept, trim_blank(F.col(title)).alias("_title"), trim_blank(F.col(content)).alias("_content")
    ).where((F.col("_title") != "") & (F.col("_content") != ""))
    pieces = valid.select(
        *kept,
        "_title",
        (F.length("_content") > spec.size).alias("_split"),
        note_chunks(F.col("_content"), spec).alias("_pieces"),
    )
    exploded = number_pieces(pieces, [*kept, "_title", "_split"], "_pieces")
    label = F.format_string("%s (BLK %d/%d)", F.col("_title"), F.col("chunk_index") + 1, F.col("total_chunks"))
    return exploded.select(
        *kept,
        "chunk_index",
        "total_chunks",
        F.when(F.col("_split"), label).otherwise(F.col("_title")).alias("source"),
        "content",
    )
