"""Nearest vectors by an inverted multi-index.

Both halves of a vector are quantised by codebooks of their own; a pair of centroids is a cell, and a cell's entries its posting
list. A query sorts the centroids of each half by distance and walks the pairs in order of summed distance with a heap until the
cells it passed hold ``share`` of all entries. Those entries are compared exactly.

Spark holds the lists: cells are packed into buckets of at most ``BUCKET`` entries (a larger cell takes several), queries into blocks, and a task
compares one block with one bucket. Of equal vectors only the first depth + 1 ids are indexed, as no others can be among the results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbweave.llm.common import written

CENTROIDS = 64
SAMPLE = 20_000
BUCKET = 2_000
BLOCK = 512
SHARE = 0.6


def usable(vector: Column) -> Column:
    """Not null, not empty, all numbers finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


@dataclass(frozen=True)
class Index:
    """Codebooks of the two halves, the number of entries in each cell, and each cell's first bucket and number of buckets."""

    cut: int
    books: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    first: np.ndarray
    several: np.ndarray

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each vector's halves to the centroids."""
        out = []
        for part, book in zip((x[:, : self.cut], x[:, self.cut :]), self.books):
            out.append((part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None])
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = (d.argmin(1) for d in self.halves(x))
        return (a * len(self.books[1]) + b).astype(np.int32)

    def walk(self, da: np.ndarray, db: np.ndarray, enough: float) -> np.ndarray:
        """Cells by growing summed distance until they hold ``enough`` entries, as a bit mask over all cells."""
        width = len(db)
        oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
        sa, sb = da[oa].tolist(), db[ob].tolist()
        reached = [0] * len(sa)  # next column of each row of the sorted grid
        heap = [(sa[0] + sb[0], 0, 0)]
        mask, held = np.zeros(len(self.counts), dtype=bool), 0
        while heap and held < enough:
            _, i, j = heapq.heappop(heap)
            cell = int(oa[i]) * width + int(ob[j])
            mask[cell] = True
            held += int(self.counts[cell])
            reached[i] = j + 1
            if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (sa[i] + sb[j + 1], i, j + 1))
            if i + 1 < len(sa) and reached[i + 1] == j:
                heapq.heappush(heap, (sa[i + 1] + sb[j], i + 1, j))
        return mask


def _book(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from random distinct points; an empty centroid keeps its place."""
    distinct = np.unique(x, axis=0)
    book = distinct[np.random.default_rng(seed).permutation(len(distinct))[:size]].copy()
    for _ in range(12):
        near = ((book**2).sum(1)[None] - 2 * x @ book.T).argmin(1)
        counts = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, x)
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def fit(vectors: DataFrame, width: int, sample: int = SAMPLE, centroids: int = CENTROIDS) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks from at most ``sample`` vectors, chosen by a hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    x = _matrix(rows.column(0).combine_chunks(), width)
    cut = (width + 1) // 2
    return _book(x[:, :cut], centroids, 1), _book(x[:, cut:], centroids, 2) if width > 1 else np.zeros((1, 0))


def prepared(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, embedding`` (doubles) of the usable vectors, and their dimension, the most frequent one.

    Rows without an id take no part; of rows that share one, the smallest vector counts.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = written(rows.withColumn("width", F.size("embedding")), "vectors")
    most = rows.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    width = most["width"] if most else 0
    return rows.filter(F.col("width") == width).drop("width"), width


def nearest(vectors: DataFrame, queries: Column, depth: int = 10, share: float = SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every usable vector that ``queries`` selects, its ``depth`` nearest others found.

    Score is the Euclidean distance in double precision, ties go to the smaller id, fewer candidates give fewer rows. Vectors that are
    null, empty, zero, of another dimension or hold null or non-finite numbers take no part; with none left the result is empty.
    """
    spark = vectors.sparkSession
    rows, width = prepared(vectors)
    if not width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    entries = rows.withColumn("nth", first).filter(F.col("nth") <= depth + 1).drop("nth")
    books = fit(rows, width)
    cells = len(books[0]) * len(books[1])
    empty = np.zeros(cells, dtype=np.int64)
    index = Index((width + 1) // 2, books, empty, empty, empty)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = index.cells(_matrix(batch.column(1), width)) if len(batch) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=["vec_id", "embedding", "cell"])

    entries = written(entries.mapInArrow(assign, "vec_id long, embedding array<double>, cell int"), "entries")
    counts = empty.copy()
    for row in entries.groupBy("cell").count().collect():  # at most one row a pair of centroids
        counts[row["cell"]] = row["count"]
    several = np.maximum(1, -(-counts // BUCKET))
    first_bucket, at, room = np.zeros(cells, dtype=np.int64), -1, 0
    for cell in range(cells):
        if several[cell] > 1 or counts[cell] > room or at < 0:
            at, room = at + 1, BUCKET
        first_bucket[cell] = at
        room -= int(counts[cell])
        if several[cell] > 1:
            at, room = at + int(several[cell]) - 1, 0
    buckets, enough = at + 1, max(share * counts.sum(), 4.0 * depth)
    index = Index(index.cut, books, counts, first_bucket, several)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                da, db = index.halves(_matrix(batch.column(1), width))
                masks = [np.packbits(index.walk(a, b, enough)).tobytes() for a, b in zip(da, db)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.binary())], names=["query_id", "query", "mask"])

    asked = written(rows.filter(queries).mapInArrow(probe, "query_id long, query array<double>, mask binary"), "queries")
    blocks = max(1, -(-asked.count() // BLOCK))
    place = spark.createDataFrame([(c, int(first_bucket[c]), int(several[c])) for c in range(cells) if counts[c]], "cell int, bucket int, several int")
    spread = F.pmod(F.xxhash64("vec_id"), F.col("several")).cast("int")
    left = entries.join(F.broadcast(place), "cell").withColumn("bucket", F.col("bucket") + spread)
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("bucket", "block", "cell", "vec_id", "embedding")
    right = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    right = right.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))

    def compare(entry: pa.Table, query: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if entry.num_rows and query.num_rows:
            ids, cell = entry.column("vec_id").to_numpy(), entry.column("cell").to_numpy()
            x = _matrix(entry.column("embedding").combine_chunks(), width)
            q = _matrix(query.column("query").combine_chunks(), width)
            square = (x**2).sum(1)
            for i, (name, mask) in enumerate(zip(query.column("query_id").to_pylist(), query.column("mask").to_pylist())):
                near = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8))[cell] & (ids != name))
                if len(near) > 4 * depth:
                    rough = square[near] - 2 * (x[near] @ q[i])
                    bar = np.partition(rough, depth)[depth]
                    near = near[rough <= bar + 1e-6 * (abs(bar) + square[near].max() + 1)]
                score = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                best = near[np.lexsort((ids[near], score))[:depth]]
                out.append((np.full(len(best), name), ids[best], np.sqrt(((x[best] - q[i]) ** 2).sum(1))))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(compare, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= depth).select("query_id", "rank", "vec_id", "score")
