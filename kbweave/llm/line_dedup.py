"""Line deduplication with levelled sorted runs of line hashes.

The index is a set of immutable runs, each a bucketed and sorted table of ``h1, h2, keeper``: hashes that no older run holds, and the
document that was first to hold them. A new batch of lines is anti-joined with every run, bucket by bucket, so stored runs are never
shuffled again; the hashes that no run holds become the batch's own run. When a level has ``fan`` runs they are compacted into one run
of the next level, so a batch meets at most ``fan - 1`` runs a level. Runs share no hash, and compaction is a plain merge.

Batches come in descending order of document ids, so the first holder of a line is the largest id. A line that is not its hash's first
holder is a repeat; all first holders and all lines that occur once are settled by the anti-join alone, and only repeats go on to the
count of documents.

* **Hot lines**: a batch's hashes are aggregated before they are shuffled, repeats are found by hash and document together, and repeats
  meet the counted hashes by broadcast below a counted bound, else by hash and a salt of the document.
* **Names**: a line's key is named by two 64-bit hashes of different seeds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.llm.common import BROADCAST_ROWS, written
from kbweave.session import scratch_path

FAN = 2
BATCHES = 4
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]
NO_ID = -(1 << 63)  # a null id sorts below all others


class LineRuns:
    """The levels of runs. Each run is an external table below the shared folder; ``close`` takes their names off the catalog."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._names: list[str] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _store(self, rows: DataFrame) -> str:
        name = f"kbweave_lines_{uuid.uuid4().hex}"
        sorted_run = rows.write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
        sorted_run.option("path", scratch_path(self.spark, "line-run")).saveAsTable(name, format="parquet")
        self._names.append(name)
        return name

    def add(self, lines: DataFrame) -> DataFrame:
        """``lines`` (``h1, h2, doc`` and more columns) without the first holder of each hash: the largest ``doc`` of the first batch with it."""
        fresh = lines.groupBy(HASH).agg(F.max("doc").alias("keeper"))
        for run in self.runs():
            fresh = fresh.join(run.select(HASH), HASH, "left_anti")
        name = self._store(fresh)
        first = self.spark.table(name).select(*HASH, F.col("keeper").alias("doc"))
        repeats = written(lines.join(first, [*HASH, "doc"], "left_anti"), "line-repeats")
        self._settle(name)
        return repeats

    def _settle(self, name: str) -> None:
        """Put a run into level 0 and compact every level that is full."""
        level = 0
        while True:
            if len(self.levels) == level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fan:
                return
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            name, level = self._store(merged.repartition(self.buckets, *HASH)), level + 1

    def close(self) -> None:
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _doc(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(documents: DataFrame, min_chars: int) -> DataFrame:
    """``doc, text_hash, pos, h1, h2`` of all lines whose key has at least ``min_chars`` code points.

    The key is the line without ASCII white space at both ends, with A-Z lower-cased. ``text_hash`` tells rows of one id apart.
    """
    rows = documents.select(_doc().alias("doc"), F.xxhash64("text").alias("text_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(BLANK))).where(F.char_length("line") >= min_chars)
    key = F.translate("line", UPPER, LOWER)
    return rows.select("doc", "text_hash", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _batch(documents: DataFrame, batches: int) -> Column:
    """Number of a document's batch; batch 0 has the largest ids."""
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    bounds = documents.select(F.percentile_approx(_doc(), shares).alias("bounds")).first()["bounds"] if shares else None
    return sum(((F.col("doc") < bound).cast("int") for bound in bounds or []), F.lit(0))


def _common(repeats: DataFrame, common: DataFrame) -> DataFrame:
    """The repeats whose hash is in ``common`` (16 bytes a row)."""
    if common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return repeats.join(F.broadcast(common), HASH, "left_semi")
    salted = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return repeats.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int")).join(salted, [*HASH, "salt"], "left_semi").drop("salt")


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the sorted places ``dropped``: the stretches between them, in one linear pass."""
    before = F.concat(F.array(F.lit(-1)), dropped)
    after = F.concat(dropped, F.array(F.size(lines)))
    return F.flatten(F.zip_with(before, after, lambda low, high: F.slice(lines, low + 2, high - low - 1)))


def dedup(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = BATCHES) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row of ``documents`` (``doc_id``, ``text``; other columns are not read).

    A text is split at line feeds; null and empty texts are one empty line. Keys of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold lose all their lines except in the largest ``doc_id`` with the key, which keeps all of its own. Rows that
    share an id count as one document; rows without an id count as one document below all others. An empty table gives an empty result.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = line_hashes(rows, min_chars)
    path = scratch_path(spark, "line-hashes")
    lines.withColumn("batch", _batch(rows, batches)).write.partitionBy("batch").parquet(path)
    stored = spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in lines.dtypes)}, batch int").parquet(path)
    runs, repeats = LineRuns(spark), None
    for number in range(batches):
        found = runs.add(stored.where(F.col("batch") == number).drop("batch"))
        repeats = found if repeats is None else repeats.unionByName(found)
    runs.close()
    holders = repeats.select(*HASH, "doc").distinct().groupBy(HASH).agg(F.count("*").alias("docs"))
    common = written(holders.where(F.col("docs") >= min_docs - 1).select(HASH), "common-lines")
    drops = _common(repeats, common).groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    split = rows.withColumns({"doc": _doc(), "text_hash": F.xxhash64("text")}).join(drops, ["doc", "text_hash"], "left")
    text = F.coalesce("text", F.lit(""))
    kept = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(_without(_lines(F.col("text")), F.col("dropped")), "\n"))
    n_lines = F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1
    return split.select(
        "doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("text")
    )
