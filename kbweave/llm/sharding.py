"""Shards of bounded size by extendible hashing.

A row's hash is read bit by bit. The directory starts as one bucket; a bucket over the byte limit splits on its next bit, the others stay, so
shards have prefixes of different lengths and none is over the limit. Bytes are first summed by a
prefix some bits longer than needed on average; the splits work on these sums, and only rows of buckets that are still too large after that
are looked at again with more bits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import bounded, written

LIMIT = 8 << 20
SPARE_BITS = 6
MAX_BITS = 62


def _prefix(bits: int) -> Column:
    """The first ``bits`` bits of the hash as a number."""
    return F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long")


def _named(prefix: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def directory(rows: DataFrame, limit: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """``prefix, shard, depth, shard_bytes, shard_rows`` for every ``bits``-bit prefix that lies in a shard that fits, and the prefixes that do not.

    ``rows`` holds ``_h, _bytes``. A bucket fits if it is within the limit or holds one hash, which no bit can split.
    """
    open_ = written(rows.groupBy(_prefix(bits).alias("prefix")).agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("n"), F.min("_h").alias("low"), F.max("_h").alias("high")), "prefixes")
    done = None
    for depth in range(bits + 1):
        name = F.shiftright("prefix", bits - depth)
        sums = open_.groupBy(name.alias("bucket")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("low").alias("a"), F.max("high").alias("b"))
        sums = written(sums.withColumn("fits", (F.col("shard_bytes") <= limit) | (F.col("a") == F.col("b"))), "buckets")
        both = open_.withColumn("bucket", name).join(sums.drop("a", "b"), "bucket")
        fit = both.filter("fits").select("prefix", _named(F.col("bucket"), depth).alias("shard"), F.lit(depth).alias("depth"), "shard_bytes", "shard_rows")
        done = fit if done is None else done.unionByName(fit)
        open_ = both.filter(~F.col("fits")).select("prefix", "bytes", "n", "low", "high")
        if sums.filter(~F.col("fits")).isEmpty():
            break
    return done, open_


def assigned(documents: DataFrame, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """Add ``shard`` (the bits of its prefix), ``depth``, ``shard_bytes`` and ``shard_rows`` to every row.

    A row weighs the UTF-8 bytes of ``text``; null and empty texts weigh nothing. The hash is over ``doc_id`` and ``text``. No shard is over the
    limit but a single row that is so itself, and repeated equal rows, which no bit can part: those get shards of their own, numbered
    after the prefix, each within the limit. An empty table has no shards. Columns with the names of the added ones are replaced.
    """
    added = ("shard", "depth", "shard_bytes", "shard_rows")
    base = documents.drop(*added).withColumn("_h", F.xxhash64("doc_id", text)).withColumn("_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    rows = written(base.select("_h", "_bytes"), "hashes")
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    bits = min(MAX_BITS, max(1, math.ceil(math.log2(max(total / limit, 1))) + SPARE_BITS))
    maps, left = [], None
    while True:
        found, open_ = directory(rows if left is None else left, limit, bits)
        maps.append((bits, written(found, "directory")))
        open_ = written(open_, "over")
        if open_.isEmpty() or bits == MAX_BITS:
            break
        left = written((rows if left is None else left).withColumn("prefix", _prefix(bits)).join(bounded(open_.select("prefix")), "prefix", "left_semi").select("_h", "_bytes"), "again")
        bits = min(MAX_BITS, bits + 12)
    out = base
    for i, (width, found) in enumerate(maps):
        part = bounded(found.select(F.col("prefix").alias(f"_p{i}"), F.struct(*added).alias(f"_d{i}")))
        out = out.withColumn(f"_p{i}", _prefix(width)).join(part, f"_p{i}", "left").drop(f"_p{i}")
    out = out.withColumn("_d", F.coalesce(*(F.col(f"_d{i}") for i in range(len(maps)))))
    out = out.select(*base.columns, *(F.col(f"_d.{name}").alias(name) for name in added))
    over = out.filter((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1))
    if not written(over.select("shard").limit(1), "equal").isEmpty():
        from pyspark.sql import Window

        fit = F.greatest(F.lit(limit) / F.col("_bytes"), F.lit(1)).cast("long")
        number = F.row_number().over(Window.partitionBy("_h").orderBy("_bytes")) - 1
        parts = over.withColumn("_k", F.floor(number / fit).cast("string")).withColumn("shard", F.concat_ws("-", "shard", "_k"))
        window = Window.partitionBy("shard")
        parts = parts.withColumn("shard_bytes", F.sum("_bytes").over(window)).withColumn("shard_rows", F.count("*").over(window)).drop("_k")
        out = out.filter(~((F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1))).unionByName(parts)
    return out.drop("_h", "_bytes")


def write_shards(documents: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """Write every shard as one Parquet file below ``path/shard=<bits>`` and return the table read back.

    Rows of a shard meet in one task, which the limit bounds.
    """
    rows = assigned(documents, limit, text)
    rows = rows.withColumn("_name", F.concat(F.lit("s"), "shard"))
    rows.repartition("_name").write.partitionBy("_name").parquet(path)
    schema = rows.schema
    return documents.sparkSession.read.schema(schema).parquet(path).drop("_name")
