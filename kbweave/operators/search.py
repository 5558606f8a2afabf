"""Exact cosine top-k of many questions over a table of vectors.

Scoring is a matrix product per Arrow batch. Pairs are never emitted: a task
keeps the best ``k`` per question while it reads and ships only those, so what
is shuffled grows with questions x k x tasks and not with the table.

* A question set whose size was checked travels as a broadcast matrix.
* A larger one is cut into blocks of such a size, one after the other: each is a
  pass over the unshuffled table, and its few best rows are written before the next.

Rows of a stored table are told apart by ``ROW_KEYS``, not by their ids, which may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.functions.vector_kernels import lengths_of
from kbweave.session import estimated_scan_tasks, scratch_path

SIMILARITY_DIGITS = 6
SQUARED_NORM_LIMIT = 1e-6
_ROUNDING = 10.0**-SIMILARITY_DIGITS
_SCORES_PER_SLICE = 1 << 22
MAX_BROADCAST_BYTES = 64 << 20
MAX_BROADCAST_HITS = 1 << 20
ROW_KEYS = ("collection", "batch", "row_id")


class TopK:
    """Running best ``k`` rows per question, ordered by similarity, then id."""

    def __init__(self, questions: np.ndarray, k: int):
        self.k = k
        self.unit = _unit_rows(questions)
        n = len(questions)
        self.question = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.ids: np.ndarray | None = None
        self.keys: list[np.ndarray] = []
        # Score and id of each question's last row, once it has k of them.
        self.floor = np.full(n, -np.inf)
        self.worst: np.ndarray | None = None

    def add(self, ids: np.ndarray, vectors: np.ndarray, keys: tuple[np.ndarray, ...] = ()) -> None:
        """``keys`` go along with the ids and decide between rows of the same id."""
        step = max(1, _SCORES_PER_SLICE // max(1, len(self.unit)))
        for start in range(0, len(ids), step):
            at = slice(start, start + step)
            self._add_slice(ids[at], vectors[at], [key[at] for key in keys])

    def _add_slice(self, ids: np.ndarray, vectors: np.ndarray, keys: list[np.ndarray]) -> None:
        order = np.lexsort((*_places(keys), ids))
        ids, keys = ids[order], [key[order] for key in keys]
        raw = self.unit @ _unit_rows(vectors[order]).T
        # Once a question has k rows nearly all others fail this one comparison;
        # clipping, rounding and tie rules then run on the few that are left.
        question, row = np.nonzero(raw >= self.floor[:, None] - _ROUNDING)
        score = _similarity(raw[question, row])
        better = score > self.floor[question]
        if self.worst is not None:
            better |= (score == self.floor[question]) & (ids[row] <= self.worst[question])
        question, row, score = question[better], row[better], score[better]
        crowded = np.flatnonzero(np.bincount(question, minlength=len(self.unit)) > self.k)
        if len(crowded):
            # Ids ascend, so a stable sort by falling score is the wanted order and
            # of a question with more than k candidates only the first k matter.
            best = np.argsort(-_similarity(raw[crowded]), axis=1, kind="stable")[:, : self.k]
            keep = ~np.isin(question, crowded)
            question = np.concatenate([question[keep], np.repeat(crowded, best.shape[1])])
            row = np.concatenate([row[keep], best.ravel()])
            score = _similarity(raw[question, row])
        if len(question):
            self._merge(question, score, ids[row], [key[row] for key in keys])

    def _merge(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: list[np.ndarray]) -> None:
        if self.ids is not None:
            question = np.concatenate([self.question, question])
            score = np.concatenate([self.score, score])
            ids = np.concatenate([self.ids, ids])
            keys = [np.concatenate(pair) for pair in zip(self.keys, keys)]
        order = np.lexsort((*_places(keys), ids, -score, question))
        question, score, ids = question[order], score[order], ids[order]
        starts = np.concatenate(([True], question[1:] != question[:-1]))
        place = np.arange(len(question)) - np.maximum.accumulate(np.where(starts, np.arange(len(question)), 0))
        keep = place < self.k
        self.question, self.score, self.ids = question[keep], score[keep], ids[keep]
        self.keys = [key[order][keep] for key in keys]
        full = np.flatnonzero(place[keep] == self.k - 1)
        if self.worst is None:
            self.worst = np.empty(len(self.unit), dtype=ids.dtype)
            self.worst[:] = ids[0]
        self.floor[self.question[full]] = self.score[full]
        self.worst[self.question[full]] = self.ids[full]


def _places(keys: list[np.ndarray]) -> list[np.ndarray]:
    """Sort keys, the first one last as ``lexsort`` wants it; texts by their place among the texts there are."""
    return [np.unique(key, return_inverse=True)[1] if key.dtype == object else key for key in reversed(keys)]


def _similarity(cosine: np.ndarray) -> np.ndarray:
    return np.round(np.clip(cosine, -1.0, 1.0), SIMILARITY_DIGITS)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; near-zero and non-finite rows become zero, so they score 0."""
    with np.errstate(all="ignore"):
        squared = (x * x).sum(axis=1, keepdims=True)
        usable = np.isfinite(squared) & (squared > SQUARED_NORM_LIMIT)
        return np.where(usable, x / np.sqrt(np.where(usable, squared, 1.0)), 0.0)


def _dense(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have the wanted dimension, and those rows as a matrix."""
    sizes = lengths_of(vectors)
    fits = sizes == dim
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if fits.all():
        return fits, values.reshape(-1, dim).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))[:-1]
    return fits, values[starts[fits][:, None] + np.arange(dim)].astype(np.float64)


def _hits_schema(
    questions: DataFrame, kb: DataFrame, query_id: str, id_col: str, collection: str | None, keys: list[str]
) -> T.StructType:
    fields = [
        T.StructField(query_id, questions.schema[query_id].dataType),
        T.StructField(id_col, kb.schema[id_col].dataType),
        T.StructField("similarity", T.DoubleType()),
        *(T.StructField(key, kb.schema[key].dataType) for key in keys),
    ]
    return T.StructType(fields + ([T.StructField(collection, T.StringType())] if collection else []))


def _hits_batches(groups, names: list[str], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for name, members in groups.items():
        for _, query_ids, state in members:
            ids = state.ids if state.ids is not None else np.empty(0)
            columns = [query_ids.take(pa.array(state.question)), pa.array(ids, type=id_type), pa.array(state.score)]
            if state.ids is None:
                continue
            columns += [pa.array(key) for key in state.keys]
            if len(names) > len(columns):
                columns.append(pa.array([name] * len(ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _id_values(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy(zero_copy_only=False)


def _matched(part: pa.RecordBatch, vector: str, collection: str | None) -> list[tuple[str | None, pa.RecordBatch]]:
    """The batch cut by collection, or whole when the search has none."""
    if collection is None:
        return [(None, part)]
    names = part.column(collection)
    return [
        (name, part.filter(pc.equal(names, pa.scalar(name, names.type))))
        for name in pc.unique(names).to_pylist()
        if name is not None
    ]


def _grouped_questions(table: pa.Table, query_id: str, vector: str, collection: str | None, k: int):
    """``collection -> [(dimension, question ids, TopK)]`` of a question table."""
    if not table.num_rows:
        return {}
    vectors = table.column(vector).combine_chunks()
    ids = table.column(query_id).combine_chunks()
    names = table.column(collection).to_pylist() if collection else [None] * table.num_rows
    members: dict[tuple[str | None, int], list[int]] = {}
    for row, key in enumerate(zip(names, lengths_of(vectors).tolist())):
        if key[1] > 0:
            members.setdefault(key, []).append(row)
    groups: dict[str | None, list] = {}
    for (name, dim), rows in members.items():
        chosen = pa.array(rows)
        _, matrix = _dense(vectors.take(chosen), dim)
        groups.setdefault(name, []).append((dim, ids.take(chosen), TopK(matrix, k)))
    return groups


def _score_table(
    groups, batches: Iterator[pa.RecordBatch], id_col: str, vector: str, collection: str | None, keys: list[str]
):
    id_type = None
    for batch in batches:
        id_type = batch.column(id_col).type
        for name, part in _matched(batch, vector, collection):
            for dim, _, state in groups.get(name, ()):
                fits, matrix = _dense(part.column(vector), dim)
                if len(matrix):
                    state.add(
                        _id_values(part.column(id_col))[fits],
                        matrix,
                        tuple(part.column(key).to_numpy(zero_copy_only=False)[fits] for key in keys),
                    )
    return id_type


def _best_overall(
    partial: DataFrame, query_id: str, id_col: str, k: int, tasks: int, keys: list[str]
) -> DataFrame:
    """Merge the tasks' best rows; a question fed by many tasks is first cut down in 64 salted groups."""
    order = [F.desc("similarity"), F.col(id_col), *keys]
    if tasks > 256:
        salted = partial.withColumn("_salt", F.spark_partition_id() % 64)
        first = F.row_number().over(Window.partitionBy(query_id, "_salt").orderBy(*order))
        partial = salted.withColumn("_place", first).where(F.col("_place") <= k).drop("_place", "_salt")
    ranked = partial.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order)))
    kept = [query_id, "rank", id_col, "similarity", *keys]
    return ranked.where(F.col("rank") <= k).select(*kept)


def search_topk(
    questions: DataFrame,
    kb: DataFrame,
    k: int = 20,
    *,
    query_id: str = "query_id",
    id_col: str = "id",
    vector: str = "embedding",
    collection: str | None = None,
    attach: list[str] | None = None,
    max_broadcast_questions: int = 16384,
) -> DataFrame:
    """``(query_id, rank, id, similarity)``: the ``k`` most similar rows of each question.

    With ``collection`` both sides carry that column, a question sees only its own
    knowledge base, and the hits name it. Rows of another dimension than the
    question's are left out (count them with :func:`mismatched_rows`). ``k`` of 0
    finds nothing. ``attach`` names columns of the hit rows to read afterwards.
    """
    wide = kb
    columns = [query_id, vector] + ([collection] if collection else [])
    keys = [name for name in ROW_KEYS if name in kb.columns and "row_id" in kb.columns and name != collection]
    table_columns = [id_col, vector, *keys] + ([collection] if collection else [])
    questions, table = questions.select(*columns), kb.select(*table_columns)
    schema = _hits_schema(questions, table, query_id, id_col, collection, keys)
    named = keys + ([collection] if collection else [])
    if k <= 0:
        empty = questions.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
        return _attached(empty.select(query_id, "rank", id_col, "similarity", *named), wide, attach, id_col, named, 0)
    # Embedded once, counted where they are, and fetched only as far as the count allows.
    asked = questions.persist()
    facts = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim")).first()
    block_rows = max(1, min(max_broadcast_questions, MAX_BROADCAST_BYTES // (4 * max(1, facts["dim"]) + 64)))
    blocks = max(1, -(-facts["n"] // block_rows))
    score = lambda part: _by_broadcast(part, table, schema, k, query_id, id_col, vector, collection, keys)
    if blocks == 1:
        partial, _ = score(asked.toArrow())
    else:
        partial = _by_blocks(asked, schema, score, query_id, blocks)
    asked.unpersist()
    hits = _best_overall(partial, query_id, id_col, k, estimated_scan_tasks(table), named)
    return _attached(hits, wide, attach, id_col, named, facts["n"] * k)


def _by_blocks(questions: DataFrame, schema: T.StructType, score, query_id: str, blocks: int) -> DataFrame:
    """Block after block over the scan. A block's best rows are written, then its broadcast copies go."""
    spark = questions.sparkSession
    path = scratch_path(spark, "hits")
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    for number in range(blocks):
        partial, shared = score(questions.where(block == number).toArrow())
        partial.write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(schema).parquet(path)


def _attached(
    hits: DataFrame, kb: DataFrame, attach: list[str] | None, id_col: str, keys: list[str], bound: int
) -> DataFrame:
    """Join the hits to their rows' columns.

    Hits of a counted question set are at most questions x k short rows. Below the
    limit they are broadcast, so the wide table is only scanned; a plain join would
    start shuffling it while the search still runs.
    """
    if not attach:
        return hits
    small = bound <= MAX_BROADCAST_HITS
    return attach_content(F.broadcast(hits) if small else hits, kb, attach, id_col, keys)


def _by_broadcast(checked, table, schema, k, query_id, id_col, vector, collection, keys):
    """The tasks' best rows for a fetched block of questions, and the broadcast block."""
    if collection:
        wanted = sorted({name for name in checked.column(collection).to_pylist() if name is not None})
        table = table.where(F.col(collection).isin(wanted)) if wanted else table.where(F.lit(False))
    shared = table.sparkSession.sparkContext.broadcast(checked)
    names = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = _grouped_questions(shared.value, query_id, vector, collection, k)
        id_type = _score_table(groups, batches, id_col, vector, collection, keys)
        if id_type is not None:
            yield from _hits_batches(groups, names, id_type)

    return table.mapInArrow(score, schema), shared


def mismatched_rows(kb: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """How many rows a search with this dimension leaves out."""
    return kb.agg(F.count_if(F.coalesce(F.size(vector), F.lit(-1)) != dim).alias("mismatched_rows"))


def require_dimension(kb_dim: int, query_dim: int) -> None:
    """A question of another dimension than the knowledge base cannot be answered."""
    if kb_dim != query_dim:
        raise ValueError(f"question vectors have {query_dim} entries, the knowledge base has {kb_dim}")


def require_same_dimension(questions: DataFrame, kb: DataFrame, vector: str = "embedding") -> None:
    """Check one question's dimension against a stored table's, whose column of dimensions is short to read.

    A table of several dimensions is searched by each question in its own.
    """
    stored = kb.agg(F.min("dimension").alias("low"), F.max("dimension").alias("high")).first()
    asked = questions.select(F.size(vector).alias("size")).first()
    if asked is not None and stored["low"] is not None and stored["low"] == stored["high"]:
        require_dimension(stored["low"], asked["size"])


def attach_content(
    hits: DataFrame,
    kb: DataFrame,
    columns: list[str],
    id_col: str = "id",
    keys: list[str] | None = None,
) -> DataFrame:
    """Read the texts after the search: only ids, keys and vectors were scanned before, and hits are few."""
    on = [id_col, *(keys or [])]
    return hits.join(kb.select(*on, *columns), on, "inner")
