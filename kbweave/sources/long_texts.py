"""Windows of texts of any length: a file's splits are cleaned and cut in many tasks, with the same result as cutting the whole text.

Cleaning works line by line but for the blanks between lines. Each split is summed up as a transition (blanks before its first visible character,
length up to its last, blanks after), the transitions are composed along each file, one row a split, and a second scan that knows where its
split starts in the cleaned text cuts the windows. A window that crosses splits is put together from its parts. No row holds more than a line.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.functions.chunks import ChunkSpec
from kbweave.functions.text import collapse_runs
from kbweave.session import scratch_path

BROADCAST_SPLITS = 1 << 20
RUN, KEPT = 11, 3  # as in cleaning: so many equal characters in a row keep three
BLOCK = ["file", "block"]
PART = "file string, block long, window long, start long, text string, whole boolean"


def visible(line: Column) -> Column:
    """A line without blanks at its ends and without control and format characters; NULL for a blank line."""
    stripped = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    shown = F.regexp_replace(F.regexp_replace(stripped, r"\s+", " "), r"[\p{Cntrl}&&[^\r\n\t]]|\p{Cf}", "")
    return F.when(stripped != "", shown)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, place, before, body, after``: what each line that is not blank shows, and the blanks around it."""
    meta = F.col("_metadata")
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), visible(F.col("value")).alias("shown")
    )
    body = F.trim("shown")
    before = F.char_length("shown") - F.char_length(F.ltrim("shown"))
    after = F.char_length(F.ltrim("shown")) - F.char_length(body)
    return lines.where("shown is not null").select(*BLOCK, "place", before.alias("before"), collapse_runs(body).alias("body"), after.alias("after"))


def _gap(blanks: int) -> int:
    return blanks if blanks < RUN else KEPT


def _runs(batches: Iterator[pa.RecordBatch]):
    """The lines of consecutive rows of one split, and the other columns of the first."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        lines = [batch.column(name).to_pylist() for name in ("before", "body", "after")]
        begun = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[begun] or blocks[i] != blocks[begun]:
                others = {name: batch.column(name)[begun].as_py() for name in batch.schema.names if name in ("start", "gap", "length")}
                yield (files[begun], blocks[begun]), zip(*(column[begun:i] for column in lines)), others
                begun = i


class _Split:
    """Lengths within a split: blanks before the first body, from it to the end of the last one, blanks after."""

    def __init__(self) -> None:
        self.lead, self.inner, self.pending, self.seen = 0, 0, 0, False

    def add(self, before: int, body: str, after: int) -> int:
        """Blanks to put between the last body and this one. Each line adds the blank of its end to ``pending``."""
        blanks = self.pending + before
        if not body:
            self.pending = blanks + after + 1
            return 0
        gap = _gap(blanks) if self.seen else 0
        if not self.seen:
            self.lead, self.seen = blanks, True
        self.inner += gap + len(body)
        self.pending = after + 1
        return gap


LENGTHS = "file string, block long, lead long, inner long, pending long, seen boolean"


def lengths(lines: DataFrame) -> DataFrame:
    """One row a split that shows anything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, int], _Split] = {}
        for key, found, _ in _runs(batches):
            split = rows.setdefault(key, _Split())
            for line in found:
                split.add(*line)
        columns = [[k[0] for k in rows], [k[1] for k in rows], *([getattr(s, name) for s in rows.values()] for name in ("lead", "inner", "pending", "seen"))]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "lead", "inner", "pending", "seen"])

    return lines.mapInArrow(run, LENGTHS)


def starts(splits: DataFrame) -> DataFrame:
    """``file, block, start, gap, length``: where each split's text begins, the blanks it begins with, and the length of the whole text."""

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        at, blanks, begin, gaps = 0, 0, [], []
        for row in rows.itertuples():
            gap = _gap(blanks + row.lead) if at and row.seen else 0
            begin.append(at)
            gaps.append(gap)
            blanks = row.pending if row.seen else blanks + row.pending
            at += gap + row.inner
        return pd.DataFrame({"file": rows["file"], "block": rows["block"], "start": begin, "gap": gaps, "length": at})

    return splits.groupBy("file").applyInPandas(compose, "file string, block long, start long, gap long, length long")


def window_count(length: Column, spec: ChunkSpec) -> Column:
    """Windows of a text of that length, without a last one below the minimum."""
    count = F.greatest(F.lit(1), F.ceil((length - spec.overlap) / spec.step)).cast("long")
    return F.when(length - (count - 1) * spec.step < spec.min_size, count - 1).otherwise(count)


def cut(told: DataFrame, spec: ChunkSpec) -> DataFrame:
    """Rows ``PART`` of lines that know their split's start: whole windows, and parts of windows that cross splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = split = None
        for found, lines, others in _runs(batches):
            if found != key:
                if key is not None:
                    yield _parts(key, list(windows.end()))
                key, split, windows = found, _Split(), _Windows(others["start"], others["length"], spec)
                windows.add(" " * others["gap"])
            text = []
            for before, body, after in lines:
                text.append(" " * split.add(before, body, after) + body)
            windows.add("".join(text))
            yield _parts(key, list(windows.full()))
        if key is not None:
            yield _parts(key, list(windows.end()))

    return told.mapInArrow(run, PART)


class _Windows:
    """The windows over a split's text, as far as it is read; ``at`` is the place of the first held character in the whole text."""

    def __init__(self, start: int, length: int, spec: ChunkSpec):
        self.start, self.length, self.spec = start, length, spec
        self.at, self.text = start, ""
        self.next = max(0, (start - spec.size) // spec.step + 1)  # the first window that reaches past the start

    def add(self, text: str) -> None:
        self.text += text

    def _part(self, window: int) -> tuple[int, int, str, bool]:
        low, high = window * self.spec.step, min(window * self.spec.step + self.spec.size, self.length)
        text = self.text[max(low - self.at, 0) : high - self.at]
        return window, max(low, self.at), text, len(text) == high - low

    def full(self) -> Iterator[tuple]:
        """Windows that end within the text held; what none of the later ones needs is let go."""
        end = self.at + len(self.text)
        while (self.next * self.spec.step + self.spec.size) <= end:
            yield self._part(self.next)
            self.next += 1
        drop = min(max(0, self.next * self.spec.step - self.at), len(self.text))
        self.at, self.text = self.at + drop, self.text[drop:]

    def end(self) -> Iterator[tuple]:
        yield from self.full()
        while self.next * self.spec.step < self.at + len(self.text):
            yield self._part(self.next)
            self.next += 1


def _parts(key: tuple[str, int], rows: list[tuple]) -> pa.RecordBatch:
    n = len(rows)
    columns = [[key[0]] * n, [key[1]] * n, *([r[i] for r in rows] for i in range(4))]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "window", "start", "text", "whole"])


def read_windows(spark: SparkSession, path: str | list[str], spec: ChunkSpec = ChunkSpec()) -> DataFrame:
    """``file, chunk_index, total_chunks, content``: the windows of the cleaned text of every file below ``path``, as ``fixed_chunks`` cuts them.

    Files are scanned twice and only parts of windows that cross splits are shuffled. A file that shows nothing has no rows. A line is the smallest
    unit: one of gigabytes is one value.
    """
    lines = read_lines(spark, path)
    folder = scratch_path(spark, "text-splits")
    lengths(lines).write.parquet(f"{folder}/lengths")
    splits = spark.read.schema(LENGTHS).parquet(f"{folder}/lengths")
    starts(splits).write.parquet(f"{folder}/starts")
    begin = spark.read.parquet(f"{folder}/starts") if not splits.isEmpty() else starts(splits)
    if begin.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        told = lines.join(F.broadcast(begin), BLOCK)
    else:
        told = lines.join(begin, BLOCK).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "place")
    cut(told, spec).write.parquet(f"{folder}/parts")
    parts = spark.read.schema(PART).parquet(f"{folder}/parts")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"])
    crossing = parts.where("not whole").groupBy("file", "window").agg(F.array_join(texts, "").alias("text"))
    found = parts.where("whole").select("file", "window", "text").unionByName(crossing)
    totals = begin.groupBy("file").agg(F.max(window_count(F.col("length"), spec)).alias("total_chunks"))
    few = totals.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    found = found.join(F.broadcast(totals) if few else totals, "file").where(F.col("window") < F.col("total_chunks"))
    return found.select("file", F.col("window").cast("int").alias("chunk_index"), F.col("total_chunks").cast("int").alias("total_chunks"), F.col("text").alias("content"))
