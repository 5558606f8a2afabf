"""Benchmark passages in documents, found by SimHash with DataFrame functions only.

Windows as long as the items slide over every document. A window and an item are similar when their weighted sets of five-word shingles
have a Jaccard similarity of ``PERCENT`` or more; a shingle weighs more the fewer items hold it. Every window that could reach this gets a
64-bit SimHash; a multi-index of eight blocks finds all items of its size within ``RADIUS`` bits: of fingerprints that differ in
at most 20 bits, some block of eight differs in at most two, and the index holds each block's 37 variants
within two bits. Candidates are then compared exactly.

Only windows that hold enough weight of some item are fingerprinted. That bound follows from the similarity asked for, so it leaves none out.
At the similarity of 0.8 the fingerprints of two sets differ in 10 bits on average, in more than 20 once in some thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import bounded, let, written

SHINGLE = 5
PERCENT = 80
RADIUS = 20
BLOCKS = 8
_MASKS = [m for m in range(256) if bin(m).count("1") <= RADIUS // BLOCKS]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null and empty texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(found: Column) -> Column:
    """Hash of the five words from each position on; fewer words give none. The words are bound once, not once a position."""

    def hashes(w: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
        return F.when(F.size(w) >= SHINGLE, some).otherwise(F.array().cast("array<bigint>"))

    return let(found, hashes)


def lanes() -> list[Column]:
    """Aggregates: for rows of ``shingle`` with integer weight ``w``, the weight of each bit's ones, two bits to a sum, and the whole weight."""
    pair = F.lit((1 << 32) + 1)
    sums = [F.sum(F.shiftrightunsigned("shingle", k).bitwiseAND(pair) * F.col("w")).alias(f"_l{k}") for k in range(32)]
    return [*sums, F.sum("w").alias("_w")]


def simhash() -> Column:
    """The 64-bit SimHash from ``lanes``; a bit is set if its ones weigh more than half of all."""
    out = F.lit(0).cast("long")
    for k in range(32):
        for shift, ones in ((k, F.col(f"_l{k}").bitwiseAND(F.lit(0xFFFFFFFF))), (k + 32, F.shiftrightunsigned(f"_l{k}", 32))):
            out = out.bitwiseOR(F.when(2 * ones > F.col("_w"), F.shiftleft(F.lit(1).cast("long"), shift)).otherwise(F.lit(0).cast("long")))
    return out


def item_shingles(items: DataFrame) -> DataFrame:
    """``item_id, n, shingle, w``: distinct shingles of the items of five words and more, weighted ``16 (1 + ln(items / items with it))``, rounded."""
    base = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words")).filter(F.size("words") >= SHINGLE)
    rows = written(base.select("item_id", F.size("words").alias("n"), F.explode(F.array_distinct(shingle_hashes(F.col("words")))).alias("shingle")).distinct(), "shingles")
    held = rows.groupBy("shingle").agg(F.countDistinct("item_id").alias("df"))
    return rows.join(held, "shingle").select("item_id", "n", "shingle", weight(number_of_items(rows), F.col("df")).alias("w"))


def number_of_items(parts: DataFrame) -> int:
    return parts.agg(F.countDistinct("item_id")).first()[0]


def weight(items: int, holding: Column) -> Column:
    return F.round(16 * (1 + F.log(F.lit(max(items, 1)) / holding))).cast("long")


def key() -> Column:
    """Names a row by its id and text, so that rows with the same or no id stay apart."""
    return F.xxhash64("doc_id", "text")


def contaminated(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, row_key, item_id, start, n_words, similarity``: of each document and item the best window, the first on ties.

    ``start`` counts words from 0. A document shorter than the item is one window. Documents or items that are null, empty or shorter than
    five words match nothing; repeated rows give one result, and items with equal texts one each. Items without an id are left out.
    """
    parts = written(item_shingles(items), "items")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = parts.groupBy("item_id", "n").agg(F.sum("w").alias("item_w"), F.sort_array(F.collect_list(F.struct("shingle", "w"))).alias("item_set"))
    prints = bounded(written(parts.groupBy("item_id", "n").agg(*lanes()).select("item_id", "n", simhash().alias("item_print")).join(sets, ["item_id", "n"]), "prints"))
    weights = parts.groupBy("shingle").agg(F.max("w").alias("w"))
    unknown = weight(number_of_items(parts), F.lit(1))
    sized = bounded(written(parts.join(sets.select("item_id", "n", "item_w"), ["item_id", "n"]), "sized"))
    known = bounded(written(weights, "weights"))

    # Where a document shares a shingle with an item: every window of the item's size around that place gains the shingle's weight.
    found = docs.select("doc_id", key().alias("row_key"), words(F.col("text")).alias("words"))
    places = found.select("row_key", F.size("words").alias("size"), F.posexplode(shingle_hashes(F.col("words"))).alias("pos", "shingle"))
    last = F.greatest(F.col("size") - F.col("n"), F.lit(0))
    starts = F.sequence(F.greatest(F.col("pos") - F.col("n") + SHINGLE, F.lit(0)), F.least(F.col("pos"), last))
    low = F.greatest(F.col("pos") - F.col("n") + SHINGLE, F.lit(0)) <= F.least(F.col("pos"), last)
    hits = places.join(sized, "shingle").filter(low).select("row_key", "item_id", "n", "item_w", "w", F.explode(starts).alias("start"))
    rich = hits.groupBy("row_key", "item_id", "n", "item_w", "start").agg(F.sum("w").alias("shared")).filter(F.col("shared") * 100 >= F.col("item_w") * PERCENT)
    windows = written(rich.select("row_key", "n", "start").distinct(), "windows")

    # Fingerprint those windows.
    places_of = windows.groupBy("row_key").agg(F.collect_list(F.struct("n", "start")).alias("spans"))
    chosen = docs.withColumn("row_key", key()).join(bounded(written(places_of.select("row_key"), "rows")), "row_key", "left_semi").dropDuplicates(["row_key"])
    texts = chosen.join(places_of, "row_key").select("doc_id", "row_key", "spans", shingle_hashes(words(F.col("text"))).alias("hashes"))
    spans = texts.select("doc_id", "row_key", "hashes", F.explode("spans").alias("span")).select(
        "doc_id", "row_key", F.col("span.n").alias("n"), F.col("span.start").alias("start"),
        F.array_distinct(F.slice("hashes", F.col("span.start") + 1, F.col("span.n") - SHINGLE + 1)).alias("window_set"),
    )
    # Little data but much work a row: spread by a set number of partitions, which is not merged again.
    spread = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = written(spans.repartition(spread, "row_key", "n", "start"), "spans")
    each = spans.select("row_key", "n", "start", F.explode("window_set").alias("shingle"))
    each = each.join(known, "shingle", "left").withColumn("w", F.coalesce("w", unknown))
    finger = each.groupBy("row_key", "n", "start").agg(*lanes()).select("row_key", "n", "start", F.col("_w").alias("window_w"), simhash().alias("print"))

    # Look them up by blocks, then compare exactly.
    block = lambda value, b: F.shiftright(value, 8 * b).bitwiseAND(F.lit(255))
    probes = F.array(*(F.struct(F.lit(b).alias("block"), block(F.col("print"), b).alias("value")) for b in range(BLOCKS)))
    variants = prints.select("item_id", "n", "item_print", F.explode(F.array(*(F.lit(b) for b in range(BLOCKS)))).alias("block")).select(
        "item_id", "n", "item_print", "block", F.explode(F.array(*map(F.lit, _MASKS))).alias("mask")
    )
    variants = variants.select(
        "item_id", "n", "item_print", "block", F.expr("(shiftright(item_print, 8 * block) & 255) ^ mask").alias("value")
    )
    near = finger.withColumn("probe", F.explode(probes)).select("*", F.col("probe.block").alias("block"), F.col("probe.value").alias("value")).drop("probe")
    near = near.join(bounded(written(variants, "index")), ["n", "block", "value"])
    near = near.withColumn("distance", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))).filter(F.col("distance") <= RADIUS)
    near = near.select("row_key", "n", "start", "item_id", "window_w").distinct()
    near = near.join(spans, ["row_key", "n", "start"]).join(prints.select("item_id", "item_w", "item_set"), "item_id")
    shared = F.aggregate("item_set", F.lit(0).cast("long"), lambda total, x: total + F.when(F.array_contains("window_set", x["shingle"]), x["w"]).otherwise(0))
    near = near.withColumn("shared", shared).withColumn("joined", F.col("window_w") + F.col("item_w") - F.col("shared"))
    near = near.filter(F.col("shared") * 100 >= F.col("joined") * PERCENT).withColumn("similarity", F.col("shared") / F.col("joined"))
    best = F.max_by(F.struct("start", "n", "similarity"), F.struct("similarity", -F.col("start"))).alias("best")
    return near.groupBy("doc_id", "row_key", "item_id").agg(best).select(
        "doc_id", "row_key", "item_id", F.col("best.start").alias("start"), F.col("best.n").alias("n_words"), F.col("best.similarity").alias("similarity")
    )


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no passage similar to an item, with their columns; repeated rows stay or go together."""
    dirty = bounded(written(contaminated(documents, items).select("row_key").distinct(), "dirty"))
    marked = documents.withColumn("_row_key", F.xxhash64(F.col("doc_id").cast("long"), "text"))
    return marked.join(dirty, F.col("_row_key") == F.col("row_key"), "left_anti").drop("_row_key")
