"""Reranking: logits to scores, reordering, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbweave.functions.embedding import words
from kbweave.functions.text import is_blank
from kbweave.functions.vector_kernels import detect_anomaly, process_vector
from kbweave.functions.vectors import relevance_logit, sigmoid

SCORE_DIGITS = 6


def pair_text(query: Column, doc: Column) -> Column:
    return F.concat(F.lit("[Q] "), query, F.lit(" [SEP] [D] "), doc, F.lit(" [SEP]"))


def lexical_logits(query: Column, doc: Column) -> Column:
    """Default scorer: a logit pair that rises with the share of question words the text has.

    A model's ``array<float>`` logits can take its place.
    """
    asked = F.array_distinct(words(query))
    share = F.size(F.array_intersect(asked, words(doc))) / F.greatest(F.size(asked), F.lit(1))
    logit = 1 + 4 * share
    return F.transform(F.array(-logit, logit), lambda x: x.cast("float"))


def with_relevance(df: DataFrame, logits: Column, key: Column, name: str = "score") -> DataFrame:
    """Add the sigmoid of the deciding logit; 0.5 without logits or when repair does not help.

    Pairs and longer are checked for anomalies; one logit has no spread to check. Logits, repair and check are columns of
    their own, one projection after the other, so each kernel runs once a row.
    """
    several = F.size("_logits") >= 2
    df = df.withColumn("_logits", logits).withColumn("_repaired", process_vector(F.when(several, F.col("_logits")), key))
    df = df.withColumn("_found", detect_anomaly(F.col("_repaired")))
    still_bad = several & F.coalesce(F.col("_found.is_anomalous"), F.lit(False))
    plain = sigmoid(relevance_logit(F.when(several, F.col("_repaired")).otherwise(F.col("_logits"))))
    none = F.coalesce(F.size("_logits"), F.lit(0)) <= 0
    return df.withColumn(name, F.when(none | still_bad, 0.5).otherwise(plain)).drop("_logits", "_repaired", "_found")


def rerank(
    hits: DataFrame,
    rerank_count: int = 5,
    *,
    query: str = "question",
    content: str = "content",
    query_id: str = "query_id",
    rank: str = "rank",
    logits: Column | None = None,
) -> DataFrame:
    """Score every non-blank hit and keep the best; equal scores keep the search order.

    A count of 0 switches reranking off. A blank question has nothing to compare: its
    hits keep the search order with falling scores and are not cut. The window holds
    one question's hits, at most the search depth.
    """
    if rerank_count <= 0:
        return hits.withColumn("rerank_rank", F.col(rank)).withColumn("score", F.lit(None).cast("double"))
    if logits is None:
        logits = lexical_logits(F.col(query), F.col(content))
    scored = with_relevance(hits.where(~is_blank(F.col(content))), logits, F.xxhash64(query_id, rank))
    unasked = F.coalesce(is_blank(F.col(query)), F.lit(True))
    score = F.when(unasked, falling_score(rank)).otherwise(F.round("score", SCORE_DIGITS))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.col(rank))
    ranked = scored.withColumn("score", score).withColumn("rerank_rank", F.row_number().over(order))
    return ranked.where(unasked | (F.col("rerank_rank") <= rerank_count))


def falling_score(rank: str) -> Column:
    return 1 - 0.01 * (F.col(rank) - 1)


def fallback_scores(hits: DataFrame, rank: str = "rank") -> DataFrame:
    """When no reranker answers: the search order with scores 1, 0.99, 0.98, ..."""
    return hits.withColumn("rerank_rank", F.col(rank)).withColumn("score", falling_score(rank))
