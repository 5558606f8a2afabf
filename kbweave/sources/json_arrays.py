"""JSON arrays read in pieces: one huge file becomes element rows in many tasks.

The scan splits a file at commas, so a split holds whole pieces and no row holds the file. Where a piece stands in the array depends on all
bytes before it, but only through two facts: whether it starts inside a string, and how deep. Each split is therefore summed up as a transition
(for both answers to the first question, the change of both facts), the transitions are composed along each file, one row a split,
and a second scan, told how its split starts, cuts the elements. An element that crosses splits is put together from its ends.

A file is an array, or an object with arrays; elements of an object's arrays carry the array's name. Memory is bounded by the split and by the
longest element, except that a string longer than a split without any comma is one piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbweave.functions.text import trim_blank
from kbweave.session import scratch_path

BROADCAST_SPLITS = 1 << 20
BLOCK = ["file", "block"]
_SIGN = np.zeros(256, dtype=np.int8)
_SIGN[[ord("["), ord("{")]], _SIGN[[ord("]"), ord("}")]] = 1, -1
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')
_BLANK = b" \t\r\n"


def read_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, block, place, value``: the bytes of every file between commas; ``block`` is the start of the split."""
    pieces = spark.read.text(path, lineSep=",", recursiveFileLookup=True)
    meta = F.col("_metadata")
    return pieces.select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("place"), "value"
    )


class Tracker:
    """Where a split's text stands: depth, and whether inside a string, at every byte, batch after batch."""

    def __init__(self, inside: int = 0, depth: int = 0):
        self.inside, self.depth = inside, depth

    def read(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, 1 where a byte is in a string, and the bracket signs. ``data`` ends outside any escape."""
        d = np.frombuffer(data, dtype=np.uint8)
        quotes = np.flatnonzero(d == 34)
        if b"\\" in data and len(quotes):
            place = np.arange(len(d))
            plain = np.maximum.accumulate(np.where(d != 92, place, -1))
            before = np.where(quotes > 0, quotes - 1, 0)
            run = np.where(quotes > 0, before - plain[before], 0)
            quotes = quotes[run % 2 == 0]
        marks = np.zeros(len(d), dtype=np.int8)
        marks[quotes] = 1
        inside = (np.cumsum(marks, dtype=np.int64) + self.inside) & 1
        self.inside = int(inside[-1]) if len(d) else self.inside
        return d, inside, _SIGN[d]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes, dict]]:
    """The text of consecutive pieces of one split, with the commas put back, and the other columns of the first."""
    for batch in batches:
        names = batch.schema.names
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        values = batch.column("value").cast(pa.binary()).to_pylist()
        start = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or files[i] != files[start] or blocks[i] != blocks[start]:
                others = {name: batch.column(name)[start].as_py() for name in names if name not in ("file", "block", "place", "value")}
                yield (files[start], blocks[start]), b",".join(values[start:i]) + b",", others
                start = i


TRANSITION = "file string, block long, quotes int, outside long, inside long, top string"


def transitions(pieces: DataFrame) -> DataFrame:
    """One row a split: parity of its quotes, change of depth if it starts outside or inside a string, and the first byte of a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[tuple[str, int], list] = {}
        for key, data, _ in _blocks(batches):
            row = rows.setdefault(key, [Tracker(), 0, 0, ""])
            _, inside, signs = row[0].read(data)
            row[1] += int(signs[inside == 0].sum())
            row[2] += int(signs[inside == 1].sum())
            if key[1] == 0 and not row[3]:
                row[3] = data.removeprefix(b"\xef\xbb\xbf").lstrip(_BLANK)[:1].decode("ascii", "replace")
        columns = [[k[0] for k in rows], [k[1] for k in rows], [r[0].inside for r in rows.values()], *([r[i] for r in rows.values()] for i in (1, 2, 3))]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "block", "quotes", "outside", "inside", "top"])

    return pieces.mapInArrow(run, TRANSITION)


def starts(splits: DataFrame) -> DataFrame:
    """``file, block, in_string, depth, top``: the transitions composed along each file, up to each split."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda value: F.coalesce(F.sum(value).over(before), F.lit(0))
    entered = splits.withColumn("in_string", (so_far(F.col("quotes")) % 2).cast("int"))
    change = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    entered = entered.withColumn("depth", so_far(change))
    return entered.select(*BLOCK, "in_string", "depth", F.max("top").over(Window.partitionBy("file")).alias("top"))


CUT = "file string, block long, k long, part string, list string, known boolean, text string"


def cut(told: DataFrame) -> DataFrame:
    """Rows ``CUT`` of pieces that know how their split starts: elements, ends of elements, and one row a split without text.

    ``k`` counts the elements that start in the split. ``part`` is ``whole``, ``tail`` (the rest is in later splits), ``head`` (it started in an
    earlier one), or ``split``, whose ``k`` is the last element started and whose list is the one open at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, reader = None, None
        for key, data, others in _blocks(batches):
            if key != current:
                if reader is not None:
                    yield reader.end()
                reader, current = _Cutter(key, others), key
            yield reader.add(data)
        if reader is not None:
            yield reader.end()

    return told.mapInArrow(run, CUT)


class _Cutter:
    """Elements of one split. ``level`` is the depth at which elements stand: 1 in an array, 2 in an object of arrays."""

    def __init__(self, key: tuple[str, int], start: dict):
        self.key = key
        self.tracker = Tracker(start["in_string"], start["depth"])
        self.level = 2 if start["top"] == "{" else 1
        self.k, self.started = 0, False  # started: an element began in this split
        self.list, self.known = ("", True) if self.level == 1 else (None, False)
        self.open = start["depth"] >= self.level
        self.held: list[bytes] = []

    def add(self, data: bytes) -> pa.RecordBatch:
        tracker = self.tracker
        depth = tracker.depth
        d, inside, signs = tracker.read(data)
        outside = inside == 0
        signs = np.where(outside, signs, 0)
        after = depth + np.cumsum(signs, dtype=np.int64)
        tracker.depth = int(after[-1])
        before = after - signs
        opens = (signs > 0) & (before == self.level - 1)
        closes = (signs < 0) & (before == self.level)
        commas = outside & (d == 44) & (after == self.level)
        at = 0
        rows: list[tuple] = []
        for place in np.flatnonzero(opens | closes | commas).tolist():
            if opens[place]:
                self.list, self.known, self.open, self.held = self._name(data, place), True, True, []
                self._start()
            else:
                self._finish(rows, data[at:place])
                if closes[place]:
                    self.open = False
                else:
                    self._start()
            at = place + 1
        if self.open:
            self.held.append(data[at:])
        return self._batch(rows)

    def _name(self, data: bytes, place: int) -> str | None:
        """Name of the array that opens; None for an object, whose fields are no elements."""
        if data[place : place + 1] != b"[":
            return None
        if self.level == 1:
            return ""
        found = _NAME.search(data[max(0, place - 1024) : place])
        return found.group(1).decode("utf-8", "replace") if found else None

    def _start(self) -> None:
        if self.started:
            self.k += 1
        self.started = True

    def _finish(self, rows: list[tuple], text: bytes) -> None:
        whole = b"".join([*self.held, text])
        self.held = []
        if self.known and self.list is None:
            return
        if not self.started:
            rows.append((-1, "head", self.list, self.known, whole))
        elif whole.strip(_BLANK):
            rows.append((self.k, "whole", self.list, self.known, whole))

    def end(self) -> pa.RecordBatch:
        rows = []
        if self.open and not (self.known and self.list is None):
            part = "tail" if self.started else "head"
            rows.append((self.k if self.started else -1, part, self.list, self.known, b"".join(self.held)))
        rows.append((self.k if self.started else -1, "split", self.list, self.known, None))
        return self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        n = len(rows)
        columns = [[self.key[0]] * n, [self.key[1]] * n, *([r[i] for r in rows] for i in range(4))]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
        texts = pa.array([None if r[4] is None else r[4].decode("utf-8", "replace") for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([*arrays, texts], names=["file", "block", "k", "part", "list", "known", "text"])


def read_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, list, block, k, element``: every array element of all files below ``path``, in order of ``(block, k)`` in its file.

    ``list`` is empty for a file that is an array, else the name of the object's array. A file that is neither has no rows. An array without its
    closing bracket yields all its elements. Elements are texts as they stand in the file; nothing is checked but brackets and quotes.
    The files are scanned twice.
    """
    pieces = read_pieces(spark, path)
    folder = scratch_path(spark, "json-splits")
    transitions(pieces).write.parquet(f"{folder}/splits")
    begin = starts(spark.read.schema(TRANSITION).parquet(f"{folder}/splits")).where(F.col("top").isin("[", "{"))
    begin.write.parquet(f"{folder}/starts")
    begin = spark.read.schema(begin.schema).parquet(f"{folder}/starts")
    if begin.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        told = pieces.join(F.broadcast(begin), BLOCK)
    else:
        told = pieces.join(begin, BLOCK).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "place")
    cut(told).write.parquet(f"{folder}/cut")
    rows = spark.read.schema(CUT).parquet(f"{folder}/cut")
    # What is open where a split starts: the last element begun, and the last list opened, in an earlier split.
    splits = rows.where("part = 'split'")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.last(F.when(F.col("k") >= 0, F.struct("block", "k")), ignorenulls=True).over(earlier)
    listed = F.last(F.when(F.col("known"), F.struct("list")), ignorenulls=True).over(earlier)
    carried = splits.select(*BLOCK, begun.alias("begun"), listed.alias("listed"))
    list_name = F.when(F.col("known"), F.col("list")).otherwise(F.col("listed.list"))
    whole = rows.where("part = 'whole' and known").select("file", "list", "block", "k", F.col("text").alias("element"))
    unknown = rows.where("part = 'whole' and not known").join(carried, BLOCK)
    unknown = unknown.select("file", list_name.alias("list"), "block", "k", F.col("text").alias("element"))
    ends = rows.where("part in ('head', 'tail')").join(carried, BLOCK)
    head = F.col("part") == "head"
    ends = ends.select(
        "file", list_name.alias("list"), F.when(head, F.col("begun.block")).otherwise(F.col("block")).alias("from"),
        F.when(head, F.col("begun.k")).otherwise(F.col("k")).alias("k"), "block", "text",
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])
    joined = ends.groupBy("file", F.col("from").alias("block"), "k").agg(F.max("list").alias("list"), F.array_join(texts, "").alias("element"))
    joined = joined.select("file", "list", "block", "k", "element").where(trim_blank(F.col("element")) != "")
    return whole.unionByName(unknown).unionByName(joined).where(F.col("list").isNotNull())


def unread_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, reason``: files that are no array and no object, and ones whose brackets do not close."""
    splits = transitions(read_pieces(spark, path))
    ends = starts(splits).join(splits.select(*BLOCK, "quotes", "outside", "inside"), BLOCK)
    change = F.when(F.col("in_string") == 0, F.col("outside")).otherwise(F.col("inside"))
    last = ends.groupBy("file").agg(F.max_by(F.col("depth") + change, "block").alias("depth"), F.max("top").alias("top"))
    reason: Column = F.when(~F.coalesce(F.col("top"), F.lit("")).isin("[", "{"), "no array or object").when(F.col("depth") != 0, "brackets do not close")
    return last.select("file", reason.alias("reason")).where(F.col("reason").isNotNull())
