"""Exact top-k that skips folders which cannot hold a hit.

A table is stored in cells, one folder each, cut by random planes; every cell has a ball: a centre and the largest angle of its vectors to it.
No row of a cell is more similar to a question than the cosine of the angle to the centre less that radius. A question is first compared with
the cells of the highest bounds that hold ``k`` rows; its ``k``-th similarity then rules out all cells whose bound is lower. What is read
grows with the cells near the questions, and the result is that of the full search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.functions.udfs import once
from kbweave.functions.vector_kernels import lengths_of
from kbweave.operators.hash_tables import TableSpec, buckets
from kbweave.operators.search import ROW_KEYS, _best_overall, _dense, _unit_rows, search_topk
from kbweave.session import estimated_scan_tasks, scratch_path

BALLS = "_balls"
NO_DIRECTION = -1
_SLACK = 2e-6  # similarities are rounded to six digits
_BALL = "cell int, rows long, centre array<double>, radius double"


def write_cells(rows: DataFrame, path: str, rows_per_cell: int = 50_000, vector: str = "embedding", seed: int = 1) -> None:
    """Store ``rows`` (``id``, the vector and more columns) in cells of about that many rows, with their balls, below a new ``path``.

    All vectors must have one dimension; null and empty ones are left out. Vectors that are zero or not finite have a cell of their own.
    """
    spark = rows.sparkSession
    kept = rows.where(F.size(vector) > 0)
    facts = kept.agg(F.count("*").alias("n"), F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if facts["low"] != facts["high"]:
        raise ValueError(f"vectors of {facts['low']} and of {facts['high']} entries")
    dimension = facts["low"] or 0
    bits = TableSpec(rows_per_bucket=rows_per_cell, seed=seed).bits(facts["n"], dimension)

    @once("int")
    def cell(vectors: pa.Array) -> pa.Array:
        unit = _unit_rows(_dense(vectors, dimension)[1])
        return pa.array(np.where(unit.any(axis=1), buckets(unit, 0, bits, seed), NO_DIRECTION).astype(np.int32))

    placed = kept.withColumn("cell", cell(F.col(vector)))
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    stored = read_cells(spark, path, rows).where(F.col("cell") != NO_DIRECTION)
    centres = _centres(stored, vector, dimension)
    _radii(stored, vector, centres).write.parquet(f"{path}/{BALLS}")


def _centres(stored: DataFrame, vector: str, dimension: int) -> dict[int, np.ndarray]:
    """Mean direction of each cell; tasks add up their own, one row a task and cell is merged."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            unit, cells = _unit_rows(_dense(batch.column(1), dimension)[1]), batch.column(0).to_numpy(zero_copy_only=False)
            for number in np.unique(cells).tolist():
                sums[number] = sums.get(number, 0) + unit[cells == number].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["cell", "total"])

    def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": [key[0]], "total": [np.sum(np.stack(parts["total"].to_list()), axis=0)]})

    found = stored.select("cell", vector).mapInArrow(add, "cell int, total array<double>").groupBy("cell").applyInPandas(merge, "cell int, total array<double>")
    # At most 2^MAX_BITS cells.
    return {row["cell"]: _unit_rows(np.array([row["total"]]))[0] for row in found.collect()}


def _radii(stored: DataFrame, vector: str, centres: dict[int, np.ndarray]) -> DataFrame:
    """Rows ``cell, rows, centre, radius``: the largest angle of a cell's vectors to its centre; a cell without a centre reaches everywhere."""
    dimension = len(next(iter(centres.values()))) if centres else 0

    def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, list] = {}
        for batch in batches:
            unit, cells = _unit_rows(_dense(batch.column(1), dimension)[1]), batch.column(0).to_numpy(zero_copy_only=False)
            for number in np.unique(cells).tolist():
                members, centre = unit[cells == number], centres[number]
                angle = float(np.arccos(np.clip(members @ centre, -1, 1)).max()) if centre.any() else np.pi
                n, before = most.get(number, (0, 0.0))
                most[number] = [n + len(members), max(before, angle)]
        if most:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(most), pa.int32()), pa.array([n for n, _ in most.values()], pa.int64()), pa.array([a for _, a in most.values()])], names=["cell", "rows", "radius"]
            )

    parts = stored.select("cell", vector).mapInArrow(widest, "cell int, rows long, radius double")
    whole = parts.groupBy("cell").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius"))
    known = stored.sparkSession.createDataFrame([(number, centre.tolist()) for number, centre in centres.items()], "cell int, centre array<double>")
    return whole.join(F.broadcast(known), "cell").select("cell", "rows", "centre", "radius")


def read_cells(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored rows with their ``cell``; ``like`` has the columns that were written."""
    return spark.read.schema(T.StructType([*like.schema.fields, T.StructField("cell", T.IntegerType())])).parquet(path)


@dataclass
class Found:
    """Hits as :func:`search_topk` returns them, and how many of the cells were read."""

    hits: DataFrame
    cells_read: int
    cells: int


def search_cells(questions: DataFrame, path: str, like: DataFrame, k: int = 20, *, query_id: str = "query_id", vector: str = "embedding") -> Found:
    """The ``k`` most similar rows of each question (a set bounded like one block of :func:`search_topk`), exactly."""
    spark = questions.sparkSession
    table = read_cells(spark, path, like)
    balls = spark.read.schema(_BALL).parquet(f"{path}/{BALLS}").orderBy("cell").toArrow()
    keys = [name for name in ROW_KEYS if name in like.columns and "row_id" in like.columns]
    if not balls.num_rows:
        return Found(search_topk(questions, table.select(*like.columns), k, query_id=query_id, vector=vector), 1, 1)
    numbers, rows = balls.column("cell").to_numpy(), balls.column("rows").to_numpy()
    centres = np.array(balls.column("centre").to_pylist())
    asked = questions.select(query_id, vector).persist()
    fetched = asked.toArrow()
    vectors = fetched.column(vector).combine_chunks()
    fits, matrix = _dense(vectors, centres.shape[1]) if len(vectors) else (np.zeros(0, dtype=bool), np.zeros((0, centres.shape[1])))
    unit = _unit_rows(matrix)
    angle = np.arccos(np.clip(unit @ centres.T, -1, 1)) - balls.column("radius").to_numpy()
    bound = np.where(unit.any(axis=1)[:, None], np.cos(np.maximum(angle, 0)), 0.0)
    order = np.argsort(-bound, axis=1, kind="stable")
    enough = np.cumsum(rows[order], axis=1) < k
    first = np.unique(order[np.concatenate((np.ones((len(order), 1), dtype=bool), enough[:, :-1]), axis=1)]) if len(order) else np.zeros(0, dtype=int)
    search = lambda cells: search_topk(
        asked, table.where(F.col("cell").isin([int(c) for c in cells])).select(*like.columns), k, query_id=query_id, vector=vector
    )
    folder = scratch_path(spark, "pruned")
    near = search(numbers[first])
    near.write.parquet(f"{folder}/first")
    near = spark.read.schema(near.schema).parquet(f"{folder}/first")
    full = near.groupBy(query_id).agg(F.min("similarity").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    least = {row[query_id]: row["least"] for row in full.collect()}  # at most one row a question
    floor = np.array([least.get(q, -np.inf) for q, fit in zip(fetched.column(query_id).to_pylist(), fits) if fit])
    wanted = (bound >= floor[:, None] - _SLACK).any(axis=0) if len(floor) else np.zeros(len(numbers), dtype=bool)
    wanted[first] = False
    # Rows without direction have a similarity of 0.
    blank = [NO_DIRECTION] if len(floor) and (floor <= _SLACK).any() else []
    rest = search([*numbers[wanted], *blank])
    read = estimated_scan_tasks(table)
    hits = _best_overall(near.drop("rank").unionByName(rest.drop("rank")), query_id, "id", k, read, keys)
    return Found(hits, len(first) + int(wanted.sum()) + len(blank), len(numbers) + 1)
