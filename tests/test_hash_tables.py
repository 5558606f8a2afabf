"""Hash tables: recall by the rule, exactness with all buckets, batches of their own sizes, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbweave.operators import hash_tables as H
from kbweave.operators import kb as kb_table
from kbweave.operators.search import search_topk

DIM = 48


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def neighbours(rng, of, cosine):
    """Vectors of exactly that cosine to each given one."""
    rest = rng.standard_normal(of.shape)
    rest = unit(rest - (rest * of).sum(axis=1, keepdims=True) * of)
    return cosine * of + np.sqrt(1 - cosine**2) * rest


def test_planes_are_orthogonal_and_nested():
    for dimension in (3, DIM):
        normals = H.planes(dimension, 2, 7)
        assert np.allclose(normals @ normals.T, np.eye(len(normals)))
    rows = unit(np.random.default_rng(1).standard_normal((500, DIM)))
    few, many = H.buckets(rows, 0, 4, 1), H.buckets(rows, 0, 9, 1)
    assert (many % 16 == few).all() and (H.buckets(rows, 0, 0, 1) == 0).all()


@pytest.mark.parametrize("bits, cosine, recall", [(6, 0.5, 0.9), (10, 0.7, 0.95), (8, 0.9, 0.8)])
def test_recall_by_the_rule(bits, cosine, recall):
    """Neighbours of a given cosine are in the buckets looked into as often as the rule says, and few rows are."""
    rng = np.random.default_rng(bits)
    asked = unit(rng.standard_normal((600, DIM)))
    near, far = neighbours(rng, asked, cosine), unit(rng.standard_normal((600, DIM)))
    tables = 3
    hit, read = np.zeros(600, dtype=bool), 0
    for table in range(tables):
        found = H.probes(asked, table, bits, 1, cosine, H.table_mass(recall, tables))
        at, others = H.buckets(near, table, bits, 1), H.buckets(far, table, bits, 1)
        hit |= np.array([b in set(p.tolist()) for p, b in zip(found, at)])
        read += sum(b in set(p.tolist()) for p, b in zip(found, others))
    assert hit.mean() >= recall - 0.03
    assert read / 600 / tables < 0.6


def rows_of(spark, vectors, batch="b", first=0):
    rows = [(first + i, [float(x) for x in v] if v is not None else None, batch) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, batch string")


def test_search_against_exact(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = unit(rng.standard_normal((30, DIM)))
    vectors = neighbours(rng, np.repeat(centres, 40, axis=0), 0.85)
    hot = np.tile(centres[:1], (400, 1))
    rows = rows_of(spark, vectors, "big").unionByName(rows_of(spark, hot, "hot", 5000)).unionByName(rows_of(spark, centres[:5], "small", 9000))
    spec = H.TableSpec(tables=4, rows_per_bucket=20)
    path = f"{tmp_path}/tables"
    H.write_tables(rows, path, spec)
    tables = H.read_tables(spark, path, rows)
    shapes = {(r["batch"], r["bits"]) for r in tables.select("batch", "bits").distinct().collect()}
    assert shapes == {("big", 6), ("hot", 5), ("small", 0)}
    asked = rows_of(spark, neighbours(rng, centres, 0.95)).select(F.col("id").alias("query_id"), "embedding")
    exact = search_topk(asked, rows, 10)
    every = H.search_tables(asked, tables, 10, recall=1.0, spec=spec)
    key = lambda r: (r["query_id"], r["rank"])
    same = lambda df: sorted((tuple(r) for r in df.select("query_id", "rank", "id", "similarity").collect()))
    assert same(every) == same(exact) and len(every.collect()) == 300
    near = {(r["query_id"], r["id"]): r["similarity"] for r in H.search_tables(asked, tables, 10, recall=0.95, similarity=0.75, spec=spec, max_block=7).collect()}
    wanted = {(r["query_id"], r["id"]): r["similarity"] for r in sorted(exact.collect(), key=key)}
    assert sum(k in near for k in wanted) >= 0.9 * len(wanted) and all(near[k] == v for k, v in wanted.items() if k in near)
    work = H.looked_at(asked, tables, recall=0.95, similarity=0.75, spec=spec).first()
    assert work["rows_stored"] == 1605 and work["rows_read"] < 4 * 1605


def test_odd_vectors_and_questions(spark, tmp_path):
    rng = np.random.default_rng(9)
    good = unit(rng.standard_normal((20, DIM)))
    odd = [None, [], [0.0] * DIM, [float("nan")] * DIM, [1.0, 2.0, 3.0]]
    rows = rows_of(spark, [*good, *odd])
    path = f"{tmp_path}/tables"
    H.write_tables(rows, path, H.TableSpec(rows_per_bucket=2))
    tables = H.read_tables(spark, path, rows)
    assert {r["id"] for r in tables.select("id").distinct().collect()} == {*range(20), 24}
    asked = rows_of(spark, [good[3], *odd]).select(F.col("id").alias("query_id"), "embedding")
    hits = H.search_tables(asked, tables, 2, recall=1.0).collect()
    assert {(r["query_id"], r["id"]) for r in hits if r["rank"] == 1} == {(0, 3), (5, 24)}
    assert H.search_tables(asked.limit(0), tables, 2).count() == 0


def test_tables_beside_a_knowledge_base(spark, tmp_path):
    """Each batch has its own tables; a batch indexed again replaces them; rows are found by key and texts attached."""
    rng = np.random.default_rng(2)
    vectors = unit(rng.standard_normal((200, DIM)))
    path = f"{tmp_path}/kb"

    def stored(collection, some):
        rows = [(i, f"text {collection} {i}", "{}", "s", [float(x) for x in v], collection) for i, v in enumerate(some)]
        frame = spark.createDataFrame(rows, "id long, content string, metadata string, source string, embedding array<float>, collection string")
        return frame.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))

    spec = H.TableSpec(rows_per_bucket=16)
    kb_table.append(stored("a", vectors), path, "one")
    H.index_kb(spark, path, ["one"], spec)
    kb_table.append(stored("b", -vectors), path, "two")
    for _ in range(2):
        H.index_kb(spark, path, ["two"], spec)
    kb = kb_table.read(spark, path)
    assert kb.count() == 400
    tables = H.read_tables(spark, f"{path}/{H.FOLDER}", kb)
    assert tables.where("hash_table = 0").count() == 400
    asked = spark.createDataFrame([(n, [float(x) for x in vectors[n]], name) for n in (5, 6) for name in ("a",)], "query_id long, embedding array<float>, collection string")
    hits = H.search_tables(asked, tables, 1, recall=0.99, similarity=0.9, spec=spec, collection="collection", attach_to=kb, attach=["content"]).collect()
    assert {(r["query_id"], r["content"]) for r in hits} == {(5, "text a 5"), (6, "text a 6")}


def test_a_batch_is_not_joined_in_one_task(spark):
    """The sizes of batches are broadcast however large Spark takes them for: by key, a batch's rows would all go to one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = H.bucketed(rows_of(spark, np.eye(5)))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
