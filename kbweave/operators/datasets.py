"""Datasets and files to chunks: format routing, counts, fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from kbweave.functions.chunks import ChunkSpec, fixed_chunks
from kbweave.functions.datasets import (
    DatasetColumns,
    broken_alpaca_items,
    close_truncated_array,
    dataset_format,
    element_texts,
    format_datasets,
    has_special_name,
    is_json_content,
    json_problem,
    object_fields,
)
from kbweave.functions.text import clean_text, ignores_min_size
from kbweave.operators.chunking import number_pieces
from kbweave.session import written_below_scratch


# The formats a dataset can have; texts that are none have no format.
FORMATS = ("alpaca", "cot", "dpo", "conversation", "generic", "object")


def explode_datasets(
    df: DataFrame, text: str = "text", min_size: int = 10, ignore_min=None, stats: Observation | None = None
) -> DataFrame:
    """One row per formatted text: ``format, chunk_index, total_chunks, content``.

    ``stats`` is filled by the pass that writes the rows; :func:`observed_stats` reads it as :func:`dataset_stats` would.
    """
    kept = [c for c in df.columns if c != text]
    formatted = format_datasets(df, text, min_size, ignore_min)
    if stats is not None:
        measures = []
        for name in (*FORMATS, "none"):
            here = F.col("format").eqNullSafe(None if name == "none" else name)
            counted = {"texts": F.lit(1), "items": F.col("items"), "added": F.size("texts"), "skipped": F.greatest(F.col("items") - F.size("texts"), F.lit(0))}
            measures += [F.sum(F.when(here, value)).alias(f"{name}_{what}") for what, value in counted.items()]
        formatted = formatted.observe(stats, *measures)
    return number_pieces(formatted, [*kept, "format"], "texts")


def observed_stats(spark: SparkSession, stats: Observation) -> DataFrame:
    """``format, items, added, skipped`` of the formats that occurred, from a finished pass."""
    found = stats.get
    rows = [
        (None if name == "none" else name, *(found[f"{name}_{what}"] for what in ("items", "added", "skipped")))
        for name in (*FORMATS, "none") if found[f"{name}_texts"]
    ]
    return spark.createDataFrame(rows, "format string, items long, added long, skipped long")


def unread_datasets(df: DataFrame, text: str = "text", min_size: int = 10) -> DataFrame:
    """Quarantine: the texts with the shape of JSON that are not read, or only in part, with the ``reason``."""
    kept = [c for c in df.columns if c != text]
    formatted = format_datasets(df, text, min_size)
    reason = F.coalesce(json_problem(F.col(text)), F.when(F.col("unread") > 0, F.lit("an element could not be read")))
    return formatted.select(*kept, reason.alias("reason")).where(F.col("reason").isNotNull())


def dataset_stats(df: DataFrame, text: str = "text", min_size: int = 10) -> DataFrame:
    """Elements seen, texts added and elements skipped, by format."""
    formatted = format_datasets(df.select(text), text, min_size)
    return formatted.groupBy("format").agg(
        F.sum("items").alias("items"),
        F.sum(F.size("texts")).alias("added"),
        F.sum(F.greatest(F.col("items") - F.size("texts"), F.lit(0))).alias("skipped"),
    )


def route_texts(
    files: DataFrame,
    name: str = "file_name",
    text: str = "text",
    spec: ChunkSpec = ChunkSpec(),
    split_datasets: bool = True,
    read_broken: bool = True,
    totals: Observation | None = None,
) -> DataFrame:
    """Chunk every file: datasets by their formatter, all else by fixed windows.

    JSON that yields nothing falls back to windows in the same row, where a join
    would have to find the files without output. ``read_broken`` reads instruction
    files that do not parse line by line, on the uncleaned text. ``totals`` is filled by the pass that writes the
    chunks: ``files`` (with a chunk), ``chunks``, and the least and most chunks of a file.
    """
    kept = [c for c in files.columns if c != text]
    cleaned = files.withColumn("_raw", F.col(text)).withColumn(
        text, close_truncated_array(clean_text(F.col(text)))
    )
    formatted = format_datasets(
        cleaned, text, spec.min_size, ignores_min_size(F.col(name)), DatasetColumns("_format", "_texts", "_items", "_unread")
    )
    windows = fixed_chunks(F.col(text), spec)
    use_dataset = F.lit(split_datasets) & (F.size("_texts") > 0)
    pieces, route = F.when(use_dataset, F.col("_texts")), F.when(use_dataset, "dataset")
    if read_broken:
        raw = F.col("_raw")
        suspicious = ~is_json_content(raw) & F.contains(raw, F.lit('"instruction"')) & raw.rlike('"(output|response)"')
        formatted = formatted.withColumn("_lines", F.when(suspicious, broken_alpaca_items(raw, spec.min_size)))
        pieces = pieces.when(F.size("_lines") > 0, F.col("_lines"))
        route = route.when(F.size("_lines") > 0, "lines")
    routed = formatted.select(
        *kept, route.otherwise("text").alias("route"), pieces.otherwise(windows).alias("_pieces")
    )
    if totals is not None:
        own = F.when(F.size("_pieces") > 0, F.size("_pieces"))
        routed = routed.observe(
            totals, F.count(own).alias("files"), F.sum(own).alias("chunks"), F.min(own).alias("min_chunks_per_file"), F.max(own).alias("max_chunks_per_file")
        )
    return number_pieces(routed, [*kept, "route"], "_pieces")


# --- datasets of any size, read in pieces ---------------------------------------------

# Arrays of an object that are read, the first one there counts.
_LISTS = ("", "data", "conversations", "examples")
BROADCAST_FILES = 100_000


def format_elements(elements: DataFrame, min_size: int = 10) -> DataFrame:
    """``file, format, chunk_index, total_chunks, content`` from :func:`read_elements` rows, as :func:`explode_datasets` of each whole file.

    A file's first element decides its format; one row a file is joined back to the elements. Numbers come from counts by split, so no task
    numbers a whole file. A file with an element that is no JSON is left out, as whole; :func:`broken_files` lists it.
    """
    order = F.lit(None).cast("int")
    for place, name in enumerate(_LISTS):
        order = F.when(F.col("list") == name, place).otherwise(order)
    ranked = elements.withColumn("_list", order).where(F.col("_list").isNotNull())
    facts = _file_facts(ranked)
    few = facts.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    rows = ranked.join(F.broadcast(facts) if few else facts, "file").where((F.col("_list") == F.col("first._list")) & (F.col("broken") == 0))
    first = object_fields(F.col("first.element"))
    rows = rows.withColumn("_first", first).withColumn("_map", object_fields(F.col("element")))
    talks = F.col("_list") == _LISTS.index("conversations")
    rows = rows.withColumn("format", F.when(talks, "conversation").otherwise(dataset_format(F.col("_first"))))
    rows = rows.withColumn("_any", has_special_name(F.col("_first")))
    texts = element_texts(F.col("element"), F.col("_map"), F.col("format"), F.col("_any"), min_size)
    found = rows.select("file", "block", "k", "format", texts.alias("_texts"))
    placed = written_below_scratch(found.select("file", "block", "k", "format", F.posexplode("_texts").alias("_pos", "content")), "element-texts")
    counts = placed.groupBy("file", "block").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "file", "block", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("file")).alias("_all")
    )
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("k", "_pos")) - 1 + F.col("_before")
    numbered = placed.join(offsets, ["file", "block"])
    return numbered.select("file", "format", place.cast("int").alias("chunk_index"), F.col("_all").cast("int").alias("total_chunks"), "content")


def _file_facts(elements: DataFrame) -> DataFrame:
    """By file: its first element, and how many of its elements are no JSON."""
    return elements.groupBy("file").agg(
        F.min(F.struct("_list", "block", "k", "element")).alias("first"), F.count_if(F.try_parse_json("element").isNull()).alias("broken")
    )


def broken_files(elements: DataFrame) -> DataFrame:
    """``file, broken``: files with elements that are no JSON, and how many."""
    counts = elements.groupBy("file").agg(F.count_if(F.try_parse_json("element").isNull()).alias("broken"))
    return counts.where("broken > 0")
