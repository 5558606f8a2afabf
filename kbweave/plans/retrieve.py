"""A batch of questions to hits, prompts and requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.functions.embedding import hash_embedding
from kbweave.functions.providers import detect_provider, full_endpoint
from kbweave.operators.prompts import build_prompts, sent_body
from kbweave.operators.rerank import fallback_scores, rerank
from kbweave.operators.search import require_same_dimension, search_topk
from kbweave.plans.build import embed_chunks


def embed_questions(
    questions: DataFrame, embedder: Callable[[Column], Column] = hash_embedding, model: str | None = None, normalize: bool = True
) -> DataFrame:
    """Add the question vector, normalised (as its model wants it) and double-checked like the stored ones."""
    keyed = questions.withColumn("_key", F.xxhash64("query_id"))
    return embed_chunks(keyed, content="question", key="_key", embedder=embedder, model=model, normalize=normalize).drop("_key")


def retrieve(
    questions: DataFrame,
    kb: DataFrame,
    *,
    depth: int = 20,
    rerank_count: int = 5,
    by_collection: bool = False,
    embedder: Callable[[Column], Column] = hash_embedding,
    logits: Column | None = None,
    reranker_available: bool = True,
) -> DataFrame:
    """Hits per question after search and reranking.

    A stored knowledge base of one dimension refuses questions of another before the
    search. A depth of 0 retrieves nothing. A rerank count of 0 keeps the search order;
    without a reranker the search order comes with falling scores.
    """
    collection = "collection" if by_collection else None
    asked = embed_questions(questions, embedder)
    if not by_collection and "dimension" in kb.columns:
        require_same_dimension(asked, kb)
    hits = search_topk(
        asked, kb, depth, collection=collection, attach=["content", "source"]
    )
    found = hits.join(questions.select("query_id", "question"), "query_id")
    if not reranker_available:
        return fallback_scores(found)
    return rerank(found, rerank_count, logits=logits)


def request_table(prompts: DataFrame, model: Column, url: Column) -> DataFrame:
    """One request per prompt for an external client.

    System and user text come from their own columns, so a blank line inside the
    prompt decides nothing.
    """
    provider = detect_provider(url)
    user = F.when(
        F.col("system") != "", F.substring("prompt", F.length("system") + 3, F.length("prompt"))
    ).otherwise(F.col("prompt"))
    return prompts.select(
        "query_id",
        provider.alias("provider"),
        full_endpoint(url, provider).alias("endpoint"),
        sent_body(model, F.col("system"), user).alias("body"),
    )


def answer_requests(
    questions: DataFrame,
    kb: DataFrame,
    *,
    model: Column,
    url: Column,
    system: Column | None = None,
    **options,
) -> DataFrame:
    """Questions to requests in one call; ``options`` are those of :func:`retrieve`."""
    prompts = build_prompts(questions, retrieve(questions, kb, **options), system=system)
    return request_table(prompts, model, url)
