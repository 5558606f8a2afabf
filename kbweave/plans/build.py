"""Texts to knowledge-base rows in one pass without a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from kbweave.functions.chunks import ChunkSpec
from kbweave.functions.embedding import hash_embedding
from kbweave.functions.providers import must_normalize
from kbweave.functions.text import clean_text
from kbweave.functions.vector_kernels import RANDOM_UNIT_SEVERITY, settle_vector
from kbweave.operators.chunking import chunk_metadata, dataset_metadata, explode_chunks, explode_notes
from kbweave.operators.datasets import route_texts
from kbweave.operators.kb import complete_metadata, storable
from kbweave.session import spread

CHUNK_BITS = 20


def chunk_id(doc_id: Column, chunk_index: Column) -> Column:
    """A BIGINT that names a chunk: document number and place, or their hash where they do not fit.

    It is a name, not a key: the stored table numbers its rows itself.
    """
    fits = (chunk_index < (1 << CHUNK_BITS)) & (doc_id >= 0) & (doc_id < (1 << (63 - CHUNK_BITS)))
    packed = F.shiftleft(doc_id.cast("bigint"), CHUNK_BITS) + chunk_index.cast("bigint")
    return F.when(fits, packed).otherwise(F.xxhash64(doc_id, chunk_index))


def embed_chunks(
    chunks: DataFrame,
    content: str = "content",
    key: str = "id",
    embedder: Callable[[Column], Column] = hash_embedding,
    expected_dim: int = -1,
    repair_above: float = RANDOM_UNIT_SEVERITY,
    balance: bool = False,
    model: str | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Add ``embedding``: model output, normalised, double-checked; rows without a vector go.

    ``normalize`` is the setting that models of some names follow; the output of all others is always normalised.

    Input splits are even by bytes, so embedding stays in the scan's tasks. With a
    slow model and a few giant documents, ``balance`` evens the chunks out first.
    """
    chunks = chunks.hint("rebalance") if balance else chunks
    raw = chunks.withColumn("embedding", embedder(F.col(content)))
    settled = settle_vector(F.col("embedding"), F.col(key), expected_dim, repair_above, must_normalize(model, normalize))
    return raw.withColumn("embedding", settled).where(F.size("embedding") > 0)


def _as_rows(embedded: DataFrame, metadata: Column, created_at: Column, model: str | None) -> DataFrame:
    return storable(
        embedded.select(
            "id",
            "collection",
            "content",
            complete_metadata(metadata, F.col("source"), F.unix_millis(created_at)).alias("metadata"),
            "source",
            created_at.alias("created_at"),
            "embedding",
            F.lit(model).cast("string").alias("model"),
        )
    )


def build_from_texts(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    collection: Column | None = None,
    source: Column | None = None,
    created_at: Column | None = None,
    spec: ChunkSpec = ChunkSpec(),
    embedder: Callable[[Column], Column] = hash_embedding,
    model: str | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Numbered texts to rows: clean, chunk, embed, check, complete the metadata."""
    created_at = F.current_timestamp() if created_at is None else created_at
    prepared = spread(docs).select(
        F.col(doc_id).alias("_doc"),
        (F.lit("default") if collection is None else collection).alias("collection"),
        (F.col(doc_id).cast("string") if source is None else source).alias("source"),
        clean_text(F.col(text)).alias("text"),
    )
    chunks = explode_chunks(prepared, "text", spec).withColumn("id", chunk_id(F.col("_doc"), F.col("chunk_index")))
    embedded = embed_chunks(chunks, embedder=embedder, model=model, normalize=normalize)
    metadata = chunk_metadata(F.col("source"), F.col("chunk_index"), F.unix_millis(created_at))
    return _as_rows(embedded, metadata, created_at, model)


def build_from_files(
    files: DataFrame,
    *,
    collection: str,
    text: str = "text",
    name: str = "file_name",
    path: str = "path",
    file_index: Column | None = None,
    created_at: Column | None = None,
    spec: ChunkSpec = ChunkSpec(),
    split_datasets: bool = True,
    embedder: Callable[[Column], Column] = hash_embedding,
    model: str | None = None,
    normalize: bool = True,
    totals: Observation | None = None,
) -> DataFrame:
    """Extracted files to rows; datasets take their formatter and its metadata. Ids hash path and place.

    ``text`` is the file as it was read: it is cleaned here, and an instruction file that does not parse is
    read by its lines. ``file_index`` is the file's number in a list, where there is one. ``totals`` counts files and chunks
    while the rows are written.
    """
    created_at = F.current_timestamp() if created_at is None else created_at
    chosen = files.select(path, name, text, (F.lit(0) if file_index is None else file_index).alias("_file"))
    chunks = route_texts(spread(chosen), name, text, spec, split_datasets, totals=totals).select(
        F.xxhash64(path, "chunk_index").alias("id"),
        F.lit(collection).alias("collection"),
        F.col(name).alias("source"),
        "chunk_index",
        "total_chunks",
        "route",
        "_file",
        "content",
    )
    embedded = embed_chunks(chunks, embedder=embedder, model=model, normalize=normalize)
    source, index, millis = F.col("source"), F.col("chunk_index"), F.unix_millis(created_at)
    metadata = F.when(F.col("route") == "text", chunk_metadata(source, index, millis)).otherwise(
        dataset_metadata(source, F.col("_file"), index, F.col("total_chunks"), millis)
    )
    return _as_rows(embedded, metadata, created_at, model)


def build_from_notes(
    notes: DataFrame,
    *,
    note_id: str = "note_id",
    title: str = "title",
    content: str = "content",
    collection: Column | None = None,
    created_at: Column | None = None,
    spec: ChunkSpec = ChunkSpec(),
    embedder: Callable[[Column], Column] = hash_embedding,
    model: str | None = None,
    normalize: bool = True,
) -> DataFrame:
    """Notes to rows. A vector that stays anomalous at any severity is replaced."""
    created_at = F.current_timestamp() if created_at is None else created_at
    chosen = notes.select(
        F.col(note_id).alias("_note"),
        (F.lit("notes") if collection is None else collection).alias("collection"),
        title,
        content,
    )
    chunks = explode_notes(chosen, title, content, spec).withColumn(
        "id", chunk_id(F.col("_note"), F.col("chunk_index"))
    )
    embedded = embed_chunks(chunks, embedder=embedder, repair_above=0.0, model=model, normalize=normalize)
    return _as_rows(embedded, F.lit("{}"), created_at, model)
