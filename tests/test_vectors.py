import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbweave.functions import vector_kernels as K
from kbweave.functions import vectors as V
from kbweave.functions.embedding import hash_embedding
from kbweave.operators.rerank import fallback_scores, rerank, with_relevance
from kbweave.operators.search import mismatched_rows, require_dimension, search_topk

NAN, INF = float("nan"), float("inf")
RNG = np.random.default_rng(7)


def ramp(n, low=-1.0, high=1.0):
    return np.linspace(low, high, n).tolist()


def detect(spark, vectors, expected=-1):
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>")
    rows = df.select("id", K.detect_anomaly(F.col("v"), expected).alias("a")).orderBy("id").collect()
    return [(r["a"]["type"], round(r["a"]["severity"], 4)) for r in rows]


def test_detection_thresholds(spark):
    extreme = lambda n: ramp(20 - n) + [2000.0 + 300 * i for i in range(n)]
    cases = [
        (None, ("ZERO_VECTOR", 1.0)),
        ([], ("ZERO_VECTOR", 1.0)),
        ([NAN] + ramp(19), ("NAN_VALUES", 0.05)),
        ([INF, NAN] + ramp(18), ("NAN_VALUES", 0.05)),
        ([INF, -INF] + ramp(18), ("INFINITE_VALUES", 0.1)),
        (extreme(2), ("HIGH_VARIANCE", 0.7)),
        (extreme(3), ("EXTREME_VALUES", 0.15)),
        ([0.0] * 20, ("ZERO_VECTOR", 1.0)),
        ([1e-7] + [0.0] * 19, ("ZERO_VECTOR", 0.8)),
        ([0.5] * 20, ("LOW_VARIANCE", 0.6)),
        (ramp(20, -60, 60), ("HIGH_VARIANCE", 0.7)),
        (ramp(20, -50, 50), ("NONE", 0.0)),
        (ramp(19, -0.01, 0.01) + [5.0], ("HIGH_SKEWNESS", 0.5)),
        ([0.1] * 6 + ramp(14), ("NONE", 0.0)),
        ([0.1] * 7 + ramp(13), ("ABNORMAL_CLUSTERING", 0.35)),
        ([0.1] * 4 + ramp(5), ("NONE", 0.0)),
    ]
    assert detect(spark, [v for v, _ in cases]) == [want for _, want in cases]
    assert detect(spark, [ramp(19), ramp(20), ramp(21)], 20) == [
        ("DIMENSION_MISSING", 0.9), ("NONE", 0.0), ("DIMENSION_MISMATCH", 0.9),
    ]


@settings(max_examples=10, deadline=None)
@given(
    st.lists(
        st.lists(st.floats(width=32, allow_nan=True, allow_infinity=True), min_size=1, max_size=24),
        min_size=20, max_size=20,
    )
)
def test_repair_and_normalise(spark, vectors):
    vectors = [v for v in vectors if any(np.isfinite(v)) and max(abs(x) for x in v if np.isfinite(x)) < 1e15]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>")
    rows = df.select(
        K.process_vector(F.col("v"), F.col("id")).alias("p"),
        K.normalize_vector(F.transform("v", lambda x: F.when(F.isnan(x) | (F.abs(x) == INF), 0.5).otherwise(x)), F.col("id")).alias("n"),
    ).collect()
    for row in rows:
        kinds = np.isnan(row["p"]).any() + np.isinf(row["p"]).any()
        assert kinds <= 1
        assert abs(np.linalg.norm(row["n"]) - 1) < 1e-4


def test_noise_depends_on_key_only(spark):
    vectors = [(i, [0.5] * 16) for i in range(40)]
    df = spark.createDataFrame(vectors, "id long, v array<float>")
    fix = lambda d: {r["id"]: r["r"] for r in d.select("id", K.process_vector(F.col("v"), F.col("id")).alias("r")).collect()}
    assert fix(df.repartition(1)) == fix(df.repartition(7)) and len({tuple(v) for v in fix(df).values()}) == 40


def test_padding_and_double_check(spark):
    df = spark.createDataFrame([(1, ramp(12)), (2, [0.3]), (3, [0.0] * 16)], "id long, v array<float>")
    rows = df.select(K.process_vector(F.col("v"), F.col("id"), 16).alias("p"), K.double_check(F.col("v"), F.col("id"), 16).alias("c")).collect()
    assert [len(r["p"]) for r in rows] == [16, 16, 16]
    assert np.allclose(rows[0]["p"][:12], ramp(12)) and abs(np.linalg.norm(rows[2]["c"]) - 1) < 1e-5


def test_settle_is_normalise_then_double_check(spark):
    vectors = [ramp(16), [0.0] * 16, [0.5] * 16, [0.25] * 8 + ramp(8), [9.0] + ramp(15, -0.01, 0.01)]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>")
    two = K.double_check(K.normalize_vector(F.col("v"), F.col("id")), F.col("id"))
    rows = df.select(K.settle_vector(F.col("v"), F.col("id")).alias("a"), two.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_blob_codec(spark):
    data = struct.pack("<3f", 1.0, -2.5, 3.0)
    df = spark.createDataFrame([(data + b"xy",), (b"",), (None,)], "b binary")
    got = [r[0] for r in df.select(K.blob_to_vector(F.col("b"))).collect()]
    assert got == [[1.0, -2.5, 3.0], [], None]


@pytest.mark.parametrize(
    "a, b, want", [([1, 0], [0, 1], 0.0), ([1, 1], [2, 2], 1.0), ([1, 0], [-3, 0], -1.0), ([1e-4, 0], [1, 0], 0.0)]
)
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(list(map(float, a)), list(map(float, b)))], "a array<float>, b array<float>")
    assert abs(df.select(V.cosine_similarity(F.col("a"), F.col("b"))).first()[0] - want) < 1e-9


def test_cosine_refuses_unequal_lengths(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    with pytest.raises(Exception, match="vector lengths differ"):
        df.select(V.cosine_similarity(F.col("a"), F.col("b"))).collect()


def test_relevance(spark):
    logits = [None, [], [0.0], [2.0], [1.0, 3.0], [9.0, NAN], [0.0, 800.0]]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(logits)], "id long, l array<float>")
    got = [r[0] for r in with_relevance(df, F.col("l"), F.col("id")).orderBy("id").select("score").collect()]
    assert got[:3] == [0.5, 0.5, 0.5]
    assert abs(got[3] - 1 / (1 + np.exp(-2))) < 1e-9 and abs(got[4] - 1 / (1 + np.exp(-3))) < 1e-9
    assert 0 <= got[5] <= 1 and 0 <= got[6] <= 1


def test_softmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([INF, 1.0],)], "l array<float>")
    a, b = [r[0] for r in df.select(V.softmax(F.col("l"))).collect()]
    assert abs(sum(a) - 1) < 1e-9 and b == [0.5, 0.5]


# --- search --------------------------------------------------------------------------


def brute(questions, rows, k):
    out = set()
    for qid, q in questions:
        scored = []
        for rid, v in rows:
            if v is None or len(v) != len(q):
                continue
            a, b = np.array(q, np.float32).astype(float), np.array(v, np.float32).astype(float)
            sa, sb = a @ a, b @ b
            s = 0.0 if sa <= 1e-6 or sb <= 1e-6 else float(np.clip(a @ b / np.sqrt(sa * sb), -1, 1))
            scored.append((-round(s, 6), rid))
        for rank, (s, rid) in enumerate(sorted(scored)[:k], 1):
            out.add((qid, rank, rid, round(-s, 6) + 0.0))
    return out


def frames(spark, questions, rows, id_type="long"):
    q = spark.createDataFrame(questions, "query_id long, embedding array<float>")
    t = spark.createDataFrame(rows, f"id {id_type}, embedding array<float>").repartition(5)
    return q, t


def found(df):
    return {(r["query_id"], r["rank"], r["id"], r["similarity"] + 0.0) for r in df.collect()}


@pytest.mark.parametrize("limit", [16384, 4])
def test_topk_matches_brute_force(spark, limit):
    questions = [(i, RNG.normal(size=8).tolist()) for i in range(12)]
    rows = [(i, RNG.normal(size=8).round(1).tolist()) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 8), (302, [1.0] * 7)]
    rows += [(1000 + i, [1.0] * 8) for i in range(150)]  # a third are copies of one vector
    q, t = frames(spark, questions, rows)
    assert found(search_topk(q, t, 7, max_broadcast_questions=limit)) == brute(questions, rows, 7)


def test_topk_is_a_prefix(spark):
    questions = [(1, RNG.normal(size=4).tolist())]
    rows = [(i, RNG.normal(size=4).tolist()) for i in range(50)]
    q, t = frames(spark, questions, rows)
    assert found(search_topk(q, t, 3)) < found(search_topk(q, t, 10))
    assert search_topk(q, t, 0).count() == 0


def test_topk_with_text_ids(spark):
    rows = [(f"r{i}", [1.0, float(i % 2)]) for i in range(9)]
    q, t = frames(spark, [(1, [1.0, 0.0])], rows, "string")
    assert [r["id"] for r in search_topk(q, t, 3).orderBy("rank").collect()] == ["r0", "r2", "r4"]


@pytest.mark.parametrize("limit", [16384, 1])
def test_topk_stays_in_its_collection(spark, limit):
    q = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0])], "query_id long, collection string, embedding array<float>")
    t = spark.createDataFrame(
        [(i, "ab"[i % 2], [1.0, i / 10]) for i in range(10)], "id long, collection string, embedding array<float>"
    )
    got = search_topk(q, t, 2, collection="collection", max_broadcast_questions=limit)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == {(1, 0), (1, 2), (2, 1), (2, 3)}


def test_repeated_ids_are_told_apart_by_their_row_keys(spark):
    schema = "id long, embedding array<float>, collection string, batch string, row_id long, content string"
    rows = [(i % 3, [1.0, 0.0], "c", f"b{i % 2}", i, f"text {i}") for i in range(12)] + [(9, [0.0, 1.0], "c", "b0", 50, "far")]
    t = spark.createDataFrame(rows, schema).repartition(4)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<float>")
    order = [r[5] for r in sorted(rows[:12], key=lambda r: (r[0], r[2], r[3], r[4]))]
    for limit in (16384, 1):
        hits = search_topk(q, t, 5, attach=["content"], max_broadcast_questions=limit).orderBy("query_id", "rank").collect()
        assert [r["content"] for r in hits if r["query_id"] == 1] == order[:5]
        assert len(hits) == 10 and hits[5]["content"] == "far"


def test_blank_question_keeps_the_search_order(spark):
    rows = [(q, t, i + 1, f"text {i}") for q, t in ((1, " "), (2, "text 3")) for i in range(6)]
    hits = spark.createDataFrame(rows, "query_id long, question string, rank int, content string")
    got = rerank(hits, 2).orderBy("query_id", "rerank_rank").collect()
    assert [(r["rank"], r["rerank_rank"], round(r["score"], 2)) for r in got if r["query_id"] == 1] == [(i, i, round(1.01 - 0.01 * i, 2)) for i in range(1, 7)]
    assert [r["rank"] for r in got if r["query_id"] == 2] == [4, 1]


def test_mismatch_is_counted(spark):
    _, t = frames(spark, [(1, [1.0])], [(1, [1.0]), (2, [1.0, 2.0]), (3, None)])
    assert mismatched_rows(t, 2).first()[0] == 2
    with pytest.raises(ValueError):
        require_dimension(2, 3)


def test_rerank_order_and_fallback(spark):
    hits = spark.createDataFrame(
        [(1, 1, "nothing here", "red fox"), (1, 2, "a red fox", "red fox"), (1, 3, " ", "red fox"), (1, 4, "red", "red fox")],
        "query_id long, rank int, content string, question string",
    )
    best = rerank(hits, 2).orderBy("rerank_rank").collect()
    assert [r["rank"] for r in best] == [2, 4]
    assert [r["rank"] for r in rerank(hits, 0).orderBy("rerank_rank").collect()] == [1, 2, 3, 4]
    assert [round(r["score"], 2) for r in fallback_scores(hits).orderBy("rank").collect()] == [1.0, 0.99, 0.98, 0.97]
    single = rerank(hits, 4, logits=F.array(F.col("rank").cast("float"))).orderBy("rerank_rank").collect()
    assert [r["rank"] for r in single] == [4, 2, 1]


# --- embedding contract ----------------------------------------------------------------


def test_hash_embedding(spark):
    texts = ["red fox", "fox red", "", None, "!!!", "blue whale"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(hash_embedding(F.col("t"), 32)).collect()]
    assert got[0] == got[1] and got[2] == [] and got[3] == [] and len(got[4]) == 32 and got[5] != got[0]


def test_long_text_embeds_like_its_words(spark):
    words = [f"w{i % 700}" for i in range(70_000)]
    df = spark.createDataFrame([(" ".join(words),), (" ".join(words[:700]),), ("a b",)], "t string").coalesce(1)
    a, b, _ = [r[0] for r in df.select(hash_embedding(F.col("t"))).collect()]
    assert np.allclose(a, b, atol=1e-6)
