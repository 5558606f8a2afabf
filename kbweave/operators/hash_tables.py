"""Approximate cosine top-k by random-projection hash tables, stored batch by batch beside a knowledge base.

A table cuts the space by random orthogonal planes; a vector's bucket is the row of its sides. Every batch keeps its own tables below
``<kb>/_hash_tables``, in one folder a bucket, with as many planes as its rows need, so buckets stay of one size as the knowledge
base grows and an append touches no older batch. The planes depend on the dimension, the table and the seed alone.

A question looks into buckets in the order of the probability that a neighbour of a given cosine lies there, until that probability
reaches what the wanted recall asks of each table. Only the folders of those buckets are read; in each, the questions that
probe it are compared with its rows, and a task hands on the best ``k`` a question. A bucket that is hot because many vectors are alike is
read in many splits like any large folder, and no pairs of rows are made.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.functions.udfs import once
from kbweave.functions.vector_kernels import lengths_of
from kbweave.operators.search import MAX_BROADCAST_BYTES, ROW_KEYS, TopK, _attached, _best_overall, _dense, _unit_rows, search_topk
from kbweave.session import bounded, estimated_scan_tasks, scratch_path, written_below_scratch

FOLDER = "_hash_tables"
MAX_BITS = 12
SAMPLE_ROWS = 20_000
BROADCAST_BATCHES = 100_000
PLACES = ["batch", "dimension", "bits", "hash_table", "bucket"]


@dataclass(frozen=True)
class TableSpec:
    """How many tables, and how many rows a bucket should hold on average."""

    tables: int = 4
    rows_per_bucket: int = 50_000
    seed: int = 1

    def bits(self, rows: int, dimension: int) -> int:
        wanted = math.ceil(math.log2(max(1, rows / self.rows_per_bucket)))
        return max(0, min(wanted, MAX_BITS, dimension))


@functools.lru_cache(maxsize=256)
def planes(dimension: int, table: int, seed: int) -> np.ndarray:
    """Unit normals of a table's planes, at right angles to each other; fewer bits take the first of them."""
    drawn = np.random.default_rng((seed, table, dimension)).standard_normal((dimension, min(dimension, MAX_BITS)))
    return np.linalg.qr(drawn)[0].T


def buckets(unit: np.ndarray, table: int, bits: int, seed: int) -> np.ndarray:
    """Number of the bucket of each unit vector: its sides of the first ``bits`` planes as binary digits."""
    sides = unit @ planes(unit.shape[1], table, seed)[:bits].T >= 0
    return sides @ (1 << np.arange(bits)) if bits else np.zeros(len(unit), dtype=np.int64)


def probes(unit: np.ndarray, table: int, bits: int, seed: int, similarity: float, mass: float) -> list[np.ndarray]:
    """The buckets each question looks into: the likeliest first, until a neighbour of that cosine is in one with probability ``mass``.

    A neighbour is ``similarity`` times the question and a rest in a random direction at right angles to it; the rest's part along
    a plane's normal is normal with a variance of ``(1 - t^2) / (dimension - 1)``, t the question's own part.
    """
    if not bits or not len(unit):
        return [np.zeros(1, dtype=np.int64)] * len(unit)
    own = unit @ planes(unit.shape[1], table, seed)[:bits].T
    rest = np.sqrt(max(1e-12, 1 - similarity**2) * np.maximum(1e-12, 1 - own**2) / max(1, unit.shape[1] - 1))
    positive = 0.5 * (1 + np.vectorize(math.erf)(similarity * own / rest / math.sqrt(2)))
    digits = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    found = []
    for row in positive:
        chance = np.where(digits == 1, row, 1 - row).prod(axis=1)
        order = np.argsort(-chance, kind="stable")
        found.append(order[: int(np.searchsorted(np.cumsum(chance[order]), min(mass, 1 - 1e-9))) + 1])
    return found


def table_mass(recall: float, tables: int) -> float:
    """The probability each of independent tables has to reach for the wanted recall."""
    return 1 - (1 - recall) ** (1 / tables)


# --- writing -----------------------------------------------------------------------------


def _bucket_numbers(vector: Column, bits: Column, spec: TableSpec) -> Column:
    """One bucket a table; NULL for a vector without direction."""

    @once("array<int>")
    def numbers(vectors: pa.Array, wanted: pa.Array) -> pa.Array:
        out: list[list[int] | None] = [None] * len(vectors)
        sizes, bit_counts = lengths_of(vectors), wanted.to_numpy(zero_copy_only=False)
        for dimension, count in {(int(d), int(b)) for d, b in zip(sizes, bit_counts) if d > 0}:
            at = np.flatnonzero((sizes == dimension) & (bit_counts == count))
            unit = _unit_rows(_dense(vectors.take(pa.array(at)), dimension)[1])
            found = np.stack([buckets(unit, t, count, spec.seed) for t in range(spec.tables)], axis=1)
            for place, row, usable in zip(at.tolist(), found.tolist(), unit.any(axis=1).tolist()):
                out[place] = row if usable else None
        return pa.array(out, pa.list_(pa.int32()))

    return numbers(vector, bits)


def bucketed(rows: DataFrame, spec: TableSpec = TableSpec(), vector: str = "embedding") -> DataFrame:
    """The rows with the ``dimension`` and ``bits`` of their batch and ``_buckets``, one number a table."""
    sized = rows.withColumn("dimension", F.size(vector)).where("dimension > 0")
    counts = sized.groupBy("batch", "dimension").agg(F.count("*").alias("_rows"))
    wanted = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("_rows") / spec.rows_per_bucket))).cast("int")
    counts = counts.select("batch", "dimension", F.least(wanted, F.lit(MAX_BITS), F.col("dimension")).alias("bits"))
    # Batches and dimensions are few keys of very many rows: a shuffled join would read each key's rows in one task.
    counts = bounded(written_below_scratch(counts, "batch-sizes"), BROADCAST_BATCHES)
    return sized.join(counts, ["batch", "dimension"]).withColumn("_buckets", _bucket_numbers(F.col(vector), F.col("bits"), spec))


def write_tables(rows: DataFrame, path: str, spec: TableSpec = TableSpec(), vector: str = "embedding") -> None:
    """Hash tables of the batches in ``rows`` (``id``, row keys, the vector) below ``path``; a batch that is there is replaced.

    The number of planes follows from the counted rows of each batch and dimension. Vectors that are null, zero or not finite have no
    direction and are not indexed. ``rebalance`` gives a bucket few files and cuts a hot one.
    """
    names = [name for name in ("id", "collection", "row_id") if name in rows.columns]
    found = bucketed(rows, spec, vector).select(*names, vector, "batch", "dimension", "bits", F.posexplode("_buckets").alias("hash_table", "bucket"))
    (
        found.hint("rebalance", "batch", "hash_table", "bucket").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(*PLACES).parquet(path)
    )


def index_kb(spark: SparkSession, kb_path: str, batches: list[str] | None = None, spec: TableSpec = TableSpec()) -> None:
    """Tables of a stored knowledge base, or of the named batches of it, below its own folder."""
    from kbweave.operators import kb

    rows = kb.read(spark, kb_path)
    rows = rows if batches is None else rows.where(F.col("batch").isin(batches))
    write_tables(rows.select("id", "collection", "batch", "row_id", "embedding"), f"{kb_path}/{FOLDER}", spec)


def read_tables(spark: SparkSession, path: str, like: DataFrame, vector: str = "embedding") -> DataFrame:
    """The stored tables; ``like`` tells the types of the columns of the rows."""
    names = [name for name in ("id", "collection", "row_id", vector) if name in like.columns]
    fields = [T.StructField(name, like.schema[name].dataType) for name in names]
    kinds = {"batch": T.StringType()}
    places = [T.StructField(name, kinds.get(name, T.IntegerType())) for name in PLACES]
    return spark.read.schema(T.StructType(fields + places)).parquet(path)


# --- searching ---------------------------------------------------------------------------


def _plan(questions: pa.Table, shapes: list[tuple[int, int]], vector: str, spec: TableSpec, similarity: float, mass: float):
    """``(dimension, bits, table, bucket) -> question rows`` for a fetched block of questions."""
    vectors = questions.column(vector).combine_chunks()
    asked: dict[tuple[int, int, int, int], list[int]] = {}
    for dimension in {d for d, _ in shapes}:
        fits, matrix = _dense(vectors, dimension)
        unit, places = _unit_rows(matrix), np.flatnonzero(fits)
        usable = unit.any(axis=1)
        for bits in {b for d, b in shapes if d == dimension}:
            for table in range(spec.tables if bits else 1):
                for place, found in zip(places[usable].tolist(), probes(unit[usable], table, bits, spec.seed, similarity, mass)):
                    for bucket in found.tolist():
                        asked.setdefault((dimension, bits, table, bucket), []).append(place)
    return asked


def _probed(tables: DataFrame, asked) -> DataFrame:
    """The rows of the folders that are looked into; all conditions are on partition columns."""
    wanted: dict[tuple[int, int, int], list[int]] = {}
    for dimension, bits, table, bucket in asked:
        wanted.setdefault((dimension, bits, table), []).append(bucket)
    condition = F.lit(False)
    for (dimension, bits, table), numbers in sorted(wanted.items()):
        here = (F.col("dimension") == dimension) & (F.col("bits") == bits) & (F.col("hash_table") == table)
        condition = condition | (here if len(numbers) == 1 << bits else here & F.col("bucket").isin(sorted(numbers)))
    return tables.where(condition)


def search_tables(
    questions: DataFrame, tables: DataFrame, k: int = 20, *, recall: float = 0.95, similarity: float = 0.5, spec: TableSpec = TableSpec(),
    query_id: str = "query_id", vector: str = "embedding", collection: str | None = None, attach_to: DataFrame | None = None,
    attach: list[str] | None = None, max_block: int = 4096,
) -> DataFrame:
    """``query_id, rank, id, similarity`` and the row keys: the best ``k`` rows of each question in the buckets it looks into.

    A row of cosine ``similarity`` or more is looked at with a probability of at least ``recall``; similarities are those of the exact search, so
    only rows can be missing. Questions of another dimension than any batch, and ones without direction, find nothing. ``attach`` names
    columns to read from ``attach_to`` for the hits. Questions go in blocks of a checked size; each block's best rows are written.
    """
    spark = tables.sparkSession
    keys = [name for name in ROW_KEYS if name in tables.columns and "row_id" in tables.columns]
    asked = questions.select(query_id, vector, *([collection] if collection else [])).persist()
    facts = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim")).first()
    rows = max(1, min(max_block, MAX_BROADCAST_BYTES // (4 * max(1, facts["dim"]) + 64)))
    blocks = max(1, -(-facts["n"] // rows))
    # One folder level each: few rows, from the names of the folders.
    shapes = [tuple(row) for row in tables.select("dimension", "bits").distinct().collect()]
    mass = table_mass(recall, spec.tables)
    schema = T.StructType(
        [T.StructField(query_id, questions.schema[query_id].dataType), T.StructField("id", tables.schema["id"].dataType), T.StructField("similarity", T.DoubleType())]
        + [T.StructField(key, tables.schema[key].dataType) for key in keys]
    )
    path, read = scratch_path(spark, "near"), 0
    for number in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == number)
        fetched = block.toArrow()
        plan = _plan(fetched, shapes, vector, spec, similarity, mass)
        shared = spark.sparkContext.broadcast((fetched, plan))
        part = _probed(tables, plan)
        read = max(read, estimated_scan_tasks(part))
        part.mapInArrow(_scorer(shared, k, query_id, vector, collection, keys, schema.names), schema).write.mode("append").parquet(path)
        shared.destroy()
    asked.unpersist()
    # A row that several tables found is one hit.
    found = spark.read.schema(schema).parquet(path).groupBy(query_id, "id", *keys).agg(F.max("similarity").alias("similarity"))
    hits = _best_overall(found, query_id, "id", k, read, keys)
    return hits if attach_to is None else _attached(hits, attach_to, attach, "id", keys, facts["n"] * k)


def _scorer(shared, k: int, query_id: str, vector: str, collection: str | None, keys: list[str], names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, plan = shared.value
        vectors, ids = questions.column(vector).combine_chunks(), questions.column(query_id).combine_chunks()
        spaces = questions.column(collection).to_pylist() if collection else None
        held: dict[tuple, tuple[pa.Array, TopK]] = {}
        last = None

        def told() -> Iterator[pa.RecordBatch]:
            for chosen, state in held.values():
                if state.ids is not None:
                    columns = [ids.take(chosen.take(pa.array(state.question))), pa.array(state.ids, type=id_type), pa.array(state.score)]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(key) for key in state.keys], names=names)
            held.clear()

        for batch in batches:
            id_type = batch.column("id").type
            places = [batch.column(name).to_numpy(zero_copy_only=False) for name in PLACES[1:]]
            code = np.stack(places, axis=1).astype(np.int64)
            starts = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]).any(axis=1))))
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(code)]):
                place = tuple(code[start].tolist())
                if place != last:
                    # Files of one bucket follow each other, so a task holds one bucket's questions at a time.
                    yield from told()
                    last = place
                part = batch.slice(start, stop - start)
                names_here = part.column(collection).to_pylist() if collection else None
                for space in set(names_here) if collection else (None,):
                    members = [q for q in plan.get(place, ()) if not collection or spaces[q] == space]
                    if not members:
                        continue
                    rows = part if not collection else part.filter(pa.array([name == space for name in names_here]))
                    if space not in held:
                        chosen = pa.array(members)
                        held[space] = (chosen, TopK(_dense(vectors.take(chosen), place[0])[1], k))
                    values = rows.column(vector)
                    own = tuple(rows.column(key).to_numpy(zero_copy_only=False) for key in keys)
                    held[space][1].add(rows.column("id").to_numpy(zero_copy_only=False), _dense(values, place[0])[1], own)
        yield from told()

    return score


def expected_similarity(questions: DataFrame, rows: DataFrame, k: int, sample: int = SAMPLE_ROWS, quantile: float = 0.1, vector: str = "embedding") -> float:
    """How similar the ``k``-th hit is to be, for :func:`search_tables`: that of all but a ``quantile`` of the questions, at least 0.

    Told from an exact search of about ``sample`` rows, the bound of this fit: in a share f of the rows the ``k f``-th hit stands for the ``k``-th.
    """
    share = min(1.0, sample / max(1, rows.count()))
    part = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)
    hits = search_topk(questions, part, max(1, round(k * share)), vector=vector)
    last = hits.groupBy("query_id").agg(F.min("similarity").alias("s")).agg(F.percentile_approx("s", quantile)).first()[0]
    return max(0.0, last or 0.0)


def looked_at(questions: DataFrame, tables: DataFrame, *, recall: float, similarity: float, spec: TableSpec, vector: str = "embedding") -> DataFrame:
    """One row: distinct rows in the tables and rows read for these questions (a bounded set), to weigh recall against work."""
    shapes = [tuple(row) for row in tables.select("dimension", "bits").distinct().collect()]
    plan = _plan(questions.select(vector).toArrow(), shapes, vector, spec, similarity, table_mass(recall, spec.tables))
    total = tables.where("hash_table = 0").agg(F.count("*").alias("rows_stored"))
    return total.crossJoin(_probed(tables, plan).agg(F.count("*").alias("rows_read")))
