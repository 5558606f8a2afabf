"""The physical plans stay the ones the operators were written for."""

import re
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbweave import session
from kbweave.functions import embedding
from kbweave.operators.rerank import rerank
from kbweave.operators.search import search_topk
from kbweave.plans.build import build_from_texts
from kbweave.plans.registry import QUERIES, load_all, retrieval

SF_DIR = "/root/testdata/sf0.001"
load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_build_has_no_shuffle_and_one_model_run(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("some text to embed").alias("text")).repartition(16)
    text = plan(build_from_texts(docs))
    assert text.count("Exchange") == 1  # the repartition above
    for kernel in ("embed(", "settle("):
        assert sum(kernel in line for line in text.splitlines() if "ArrowEvalPython" in line) == 1


def test_search_reads_ids_and_vectors_only(spark, tmp_path):
    rows = spark.range(100).select(
        "id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit("text").alias("content")
    )
    rows.write.parquet(str(tmp_path / "t"))
    kb = spark.read.parquet(str(tmp_path / "t"))
    text = plan(search_topk(kb.limit(2).withColumnRenamed("id", "query_id"), kb, 3))
    assert "ReadSchema: struct<id:bigint,embedding:array<float>>" in text
    assert "WindowGroupLimit" in text and "BroadcastNestedLoopJoin" not in text


def test_a_larger_question_set_does_not_shuffle_the_table(spark, tmp_path):
    spark.range(3000).select("id", F.array(F.rand(3).cast("float"), F.lit(1.0).cast("float")).alias("embedding")).write.parquet(str(tmp_path / "t"))
    kb = spark.read.parquet(str(tmp_path / "t"))
    text = plan(search_topk(kb.limit(40).withColumnRenamed("id", "query_id"), kb, 3, max_broadcast_questions=9))
    assert "cogroup" not in text.lower() and "FlatMapCoGroups" not in text and str(tmp_path / "t") not in text


def test_rerank_runs_its_kernels_once(spark):
    hits = spark.createDataFrame([(1, "q", 1, "t")], "query_id long, question string, rank int, content string")
    nodes = [line for line in plan(rerank(hits, 5)).splitlines() if "ArrowEvalPython" in line]
    assert len(nodes) <= 2 and sum(line.count("process") for line in nodes) <= 2


@pytest.mark.parametrize("name", ["chat_text", "chatml_no_think", "answer_assembly", "question_answer_pairs", "kb_catalog"])
def test_no_pair_products_and_no_whole_group_windows(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "Cartesian" not in text and "NestedLoop" not in text and "Window " not in text


def test_filters_reach_the_scan(spark):
    text = plan(QUERIES["question_answer_pairs"](spark, SF_DIR))
    assert "EqualTo(role,user)" in text and "EqualTo(role,assistant)" in text


def test_texts_are_joined_without_shuffling_the_table(spark, tmp_path):
    rows = spark.range(200000).select(
        "id", F.array(F.rand(1).cast("float"), F.lit(1.0).cast("float")).alias("embedding"),
        F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 30)).alias("content"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("collection"),
    )
    rows.write.partitionBy("collection").parquet(str(tmp_path / "t"))
    kb = spark.read.parquet(str(tmp_path / "t"))
    asked = kb.where("id < 4 and collection = 'a'").select(F.col("id").alias("query_id"), "embedding", "collection")
    found = search_topk(asked, kb, 3, attach=["content"], collection="collection")
    text = plan(found)
    scan = next(line for line in text.splitlines() if "content" in line and "FileScan" in line)
    assert "SortMergeJoin" not in text and "dynamicpruning" in scan
    assert found.count() == 6 and {r["collection"] for r in found.collect()} == {"a"}


def test_large_shares_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(200_000).select(F.xxhash64("id").alias("h")).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(rows).rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "SPREAD_BYTES", 1 << 16)
    assert session.spread(rows).rdd.getNumPartitions() > 2 * cores


def test_embedding_by_brute_force(spark, monkeypatch):
    """Short, long and repeated words over several slices, exactly, with a small memory of words."""
    monkeypatch.setattr(embedding, "_TOKENS_PER_SLICE", 7)
    monkeypatch.setattr(embedding, "_TOKENS_KEPT", 3)
    texts = [" ".join(f"w{(i * j) % 11}" for j in range(i)) + " " + "x" * (40 * i) for i in range(1, 30)] + ["", None, "!?"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    found = {r["i"]: r["e"] for r in df.select("i", embedding.hash_embedding(F.col("t"), 40).alias("e")).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[a-z0-9]+", text or "") or ([text] if text else [])
        sums = [sum(2 * (sha256(b"%d:" % (p // 32) + w.encode()).digest()[p % 32]) - 255 for w in words) for p in range(40)]
        assert found[i] == [float(np.float32(s / (255.0 * len(words)))) for s in sums] if words else not found[i]


def test_both_appends_hold_the_same_rows(spark, tmp_path, monkeypatch):
    """Documents are built once for two appends: even what differs from run to run is equal in both."""
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en", "s") for i in range(6)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    built = retrieval.document_kb
    monkeypatch.setattr(retrieval, "document_kb", lambda *a: built(*a).withColumn("content", F.concat("content", F.lit(" "), F.uuid())))
    rows = [r for r in retrieval.kb_mixed_search(spark, str(tmp_path)).collect() if "words of text" in r["content"]]
    contents = {batch: {r["id"]: r["content"] for r in rows if r["batch"] == batch} for batch in ("one", "two")}
    assert len(contents["one"]) == 6 and contents["one"] == contents["two"]
