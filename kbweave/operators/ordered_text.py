"""Ordered text assembly that no single hot key can overload.

A group's pieces are put together in parts of a fixed number of positions. The
(key, part) pair is the shuffle key, so a key that owns a third of all rows is
spread over many tasks, and each part stays small enough for one row. Ordinary
keys fit into part 0; reading the parts in order gives the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_POSITIONS = 1024


def assemble(
    pieces: DataFrame, keys: list[str], position: str, piece: str, out: str, positions: int = PART_POSITIONS
) -> DataFrame:
    """``keys, part, <out>``: the pieces of each part concatenated by position."""
    part = F.floor(F.col(position) / positions).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(piece).alias("t"))))
    return (
        pieces.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.array_join(F.transform(ordered, lambda s: s["t"]), "").alias(out))
    )


def assemble_utf8(
    pieces: DataFrame, keys: list[str], position: str, piece: str, out: str, positions: int = PART_POSITIONS
) -> DataFrame:
    """The same for byte pieces that may end inside a character.

    A character cut at a part's end is completed with the continuation bytes the
    next part starts with; invalid bytes become the replacement character.
    """
    part = F.floor(F.col(position) / positions).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.hex(piece).alias("h"))))
    parts = (
        pieces.withColumn("part", part)
        .groupBy(*keys, "part")
        .agg(F.array_join(F.transform(ordered, lambda s: s["h"]), "").alias("_hex"))
    )
    # Two hex digits per byte, so a match at the start is always byte-aligned.
    split = parts.select(
        *keys,
        "part",
        F.regexp_extract("_hex", "^((?:[89AB][0-9A-F])*+)", 1).alias("_head"),
        F.regexp_replace("_hex", "^(?:[89AB][0-9A-F])*+", "").alias("_body"),
    )
    tails = split.select(*keys, (F.col("part") - 1).alias("part"), F.col("_head").alias("_tail"))
    whole = split.join(tails, [*keys, "part"], "left")
    own_head = F.when(F.col("part") == 0, F.col("_head")).otherwise("")
    text = F.concat(own_head, F.col("_body"), F.coalesce("_tail", F.lit("")))
    return whole.select(*keys, "part", F.make_valid_utf8(F.unhex(text).cast("string")).alias(out))
