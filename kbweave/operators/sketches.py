"""Mergeable summaries: percentiles and distinct counts without a second look at the rows.

A summary row holds, for each group, its number of rows and small binary sketches: KLL for quantiles, HyperLogLog for distinct values. Summaries of
batches are stored beside a knowledge base and merged for its catalog; merging is associative, so a new batch only adds its own.
A KLL sketch of ``K`` tells a rank to within about 1.65 / K^0.9 of all rows, whatever their number, a HyperLogLog of 2^LG_K
registers a count to within about 1.04 / 2^(LG_K / 2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.functions.text import estimate_tokens
from kbweave.operators import kb as kb_table
from kbweave.operators.answers import parse_footer

K = 400
LG_K = 14
RANKS = (0.5, 0.9, 0.99)
FOLDER = "_summaries"


def summaries(rows: DataFrame, keys: list[str], numbers: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """``keys, rows`` and for each number ``<name>_kll, _min, _max``, for each value counted ``<name>_hll``; partial aggregation does the work."""
    chosen = rows.select(*keys, *(c.cast("double").alias(f"_n_{n}") for n, c in numbers.items()), *(c.cast("string").alias(f"_d_{n}") for n, c in (distinct or {}).items()))
    measures = [F.count("*").alias("rows")]
    for name in numbers:
        value = F.col(f"_n_{name}")
        measures += [F.kll_sketch_agg_double(value, K).alias(f"{name}_kll"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max")]
    measures += [F.hll_sketch_agg(F.col(f"_d_{name}"), LG_K).alias(f"{name}_hll") for name in distinct or {}]
    return chosen.groupBy(*keys).agg(*measures)


def _names(found: DataFrame, end: str) -> list[str]:
    return [name.removesuffix(end) for name in found.columns if name.endswith(end)]


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of groups as summaries of the coarser groups by ``keys``."""
    measures = [F.sum("rows").alias("rows")]
    for name in _names(parts, "_kll"):
        measures += [F.kll_merge_agg_double(f"{name}_kll", K).alias(f"{name}_kll"), F.min(f"{name}_min").alias(f"{name}_min"), F.max(f"{name}_max").alias(f"{name}_max")]
    measures += [F.hll_union_agg(f"{name}_hll").alias(f"{name}_hll") for name in _names(parts, "_hll")]
    return parts.groupBy(*keys).agg(*measures)


def estimates(found: DataFrame, keys: list[str], ranks: tuple[float, ...] = RANKS) -> DataFrame:
    """``keys, rows`` and for each number ``<name>_min, <name>_p50, ..., <name>_max``, for each counted value ``<name>_count``."""
    columns = [F.col("rows")]
    for name in _names(found, "_kll"):
        known = F.col(f"{name}_min").isNotNull()
        columns.append(F.col(f"{name}_min"))
        columns += [F.when(known, F.kll_sketch_get_quantile_double(f"{name}_kll", F.lit(float(r)))).alias(f"{name}_p{round(r * 100)}") for r in ranks]
        columns.append(F.col(f"{name}_max"))
    columns += [F.hll_sketch_estimate(f"{name}_hll").alias(f"{name}_count") for name in _names(found, "_hll")]
    return found.select(*keys, *columns)


def generation_percentiles(answers: DataFrame, keys: list[str], answer: str = "answer", ranks: tuple[float, ...] = RANKS) -> DataFrame:
    """Percentiles of tokens, seconds and rate by group, from the answers' footers; answers without one are counted as rows only."""
    parsed = answers.select(*keys, parse_footer(F.col(answer)).alias("_f"))
    numbers = {"tokens": F.col("_f.tokens"), "seconds": F.col("_f.seconds"), "rate": F.col("_f.rate")}
    return estimates(summaries(parsed, keys, numbers), keys, ranks)


# --- beside a knowledge base --------------------------------------------------------------


def write_summaries(spark: SparkSession, kb_path: str, batches: list[str] | None = None) -> None:
    """Summaries of the named batches' rows (or of all), one row a collection and batch; a batch summed up again is replaced."""
    rows = kb_table.read(spark, kb_path)
    rows = rows if batches is None else rows.where(F.col("batch").isin(batches))
    text = F.col("content")
    found = summaries(rows, ["collection", "batch"], {"chars": F.char_length(text), "tokens": estimate_tokens(text)}, {"sources": F.col("source")})
    found.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{kb_path}/{FOLDER}")


def catalog_estimates(spark: SparkSession, kb_path: str, ranks: tuple[float, ...] = RANKS) -> DataFrame:
    """By collection: chunks, about how many sources, and percentiles of characters and tokens, from the stored summaries alone.

    Only summaries of batches that a reader sees count; what an overwrite has replaced is left out by its folders' names.
    """
    parts = spark.read.parquet(f"{kb_path}/{FOLDER}").withColumn("batch", F.col("batch").cast("string"))
    there = kb_table.read(spark, kb_path).select("collection", "batch").distinct()
    return estimates(merged(parts.join(there, ["collection", "batch"], "left_semi"), ["collection"]), ["collection"], ranks)
