"""Answers and logs after the fact: assembly, statistics, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.functions.text import estimate_tokens, fixed_decimals
from kbweave.operators.ordered_text import PART_POSITIONS, assemble

# Log levels in rising order.
LEVELS = ("VERBOSE", "DEBUG", "INFO", "WARNING", "ERROR", "NONE")


def assemble_answers(
    pieces: DataFrame,
    response_id: str = "response_id",
    seq: str = "seq",
    content: str = "content",
    positions: int = PART_POSITIONS,
) -> DataFrame:
    """``response_id, part, answer``: the streamed pieces joined in order."""
    return assemble(pieces, [response_id], seq, content, "answer", positions)


def token_rate(tokens: Column, millis: Column) -> Column:
    """Tokens per second; 0 when nothing was counted or no time has passed."""
    return F.when((tokens > 0) & (millis > 0), tokens * 1000.0 / millis).otherwise(0.0)


def stats_footer(tokens: Column, millis: Column) -> Column:
    """The line an answer ends with."""
    return F.concat(
        F.lit("\n\n---\ntokens: "),
        tokens.cast("string"),
        F.lit(" • Time: "),
        fixed_decimals(millis / 1000.0, 2),
        F.lit("s • Rate: "),
        fixed_decimals(token_rate(tokens, millis), 2),
        F.lit(" token/s"),
    )


def parse_footer(answer: Column) -> Column:
    """``struct<tokens, seconds, rate>`` of an answer's footer, NULL fields without one."""
    pattern = r"tokens: (\d+) • Time: ([0-9.]+)s • Rate: ([0-9.]+) token/s"
    field = lambda i, kind: F.nullif(F.regexp_extract(answer, pattern, i), F.lit("")).cast(kind)
    return F.struct(
        field(1, "long").alias("tokens"), field(2, "double").alias("seconds"), field(3, "double").alias("rate")
    )


def generation_stats(answers: DataFrame, keys: list[str], answer: str = "answer") -> DataFrame:
    """Count, tokens, seconds and mean rate per group, from the footers."""
    parsed = answers.select(*keys, parse_footer(F.col(answer)).alias("_f"))
    return parsed.groupBy(*keys).agg(
        F.count("_f.tokens").alias("answers"),
        F.sum("_f.tokens").alias("tokens"),
        F.sum("_f.seconds").alias("seconds"),
        F.avg("_f.rate").alias("mean_rate"),
    )


def token_report(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Corpus token counts by the length estimate."""
    counted = df.select(*keys, estimate_tokens(F.col(text)).alias("_tokens"))
    return counted.groupBy(*keys).agg(
        F.count("*").alias("texts"),
        F.sum("_tokens").alias("tokens"),
        F.min("_tokens").alias("min_tokens"),
        F.max("_tokens").alias("max_tokens"),
    )


def level_rank(level: Column) -> Column:
    """Rank of a level given by its name or its first letter; unknown levels are NULL."""
    rank = F.lit(None).cast("int")
    for value, name in enumerate(LEVELS):
        rank = F.coalesce(rank, F.when(F.upper(level).isin(name, name[0]), F.lit(value)))
    return rank


def filter_log(
    logs: DataFrame, start=None, end=None, min_level: str | None = None, tag: str | None = None
) -> DataFrame:
    """Log rows by time (end excluded), lowest level and tag; a filter left out matches all."""
    if start is not None:
        logs = logs.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        logs = logs.where(F.col("ts") < F.lit(end).cast("timestamp"))
    if min_level is not None:
        logs = logs.where(level_rank(F.col("level")) >= level_rank(F.lit(min_level)))
    if tag is not None:
        logs = logs.where(F.col("tag") == tag)
    return logs


def search_notes(kb: DataFrame, keyword: str | None = None, start=None, end=None) -> DataFrame:
    """Knowledge-base rows whose text or source holds the keyword, created within the time range."""
    if keyword:
        wanted = F.lit(keyword.lower())
        kb = kb.where(F.contains(F.lower("content"), wanted) | F.contains(F.lower("source"), wanted))
    if start is not None:
        kb = kb.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        kb = kb.where(F.col("created_at") < F.lit(end).cast("timestamp"))
    return kb


def build_progress(
    files_done: Column, files_total: Column, chunks_done: Column, chunks_total: Column
) -> Column:
    """Percent of a build: extraction counts for the first half, vectors for the second."""
    files = F.when(files_total > 0, files_done / files_total).otherwise(0.0)
    chunks = F.when(chunks_total > 0, chunks_done / chunks_total).otherwise(0.0)
    extracting = F.floor(files * 50).cast("int")
    return F.when(files_done < files_total, extracting).otherwise(50 + F.floor(chunks * 100 / 2).cast("int"))
