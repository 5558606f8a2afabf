"""Prompt, request and chat text builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.functions.text import is_blank, trim_blank

# Prompt wording.
FOUND = "The following is information related to the question:\n"
NOT_FOUND = "No information related to the question was found.\n\n"


def _system_part(system: Column) -> Column:
    return F.when(F.coalesce(system, F.lit("")) != "", F.concat(system, F.lit("\n\n"))).otherwise("")


def direct_prompt(system: Column, question: Column) -> Column:
    return F.concat(_system_part(system), question)


def context_prompt(system: Column, question: Column, docs: Column) -> Column:
    """``docs`` in order; a blank one is skipped but keeps its number."""
    parts = F.transform(
        docs,
        lambda d, i: F.when(is_blank(d), "").otherwise(
            F.concat(F.lit("Document"), (i + 1).cast("string"), F.lit(":\n"), d, F.lit("\n\n"))
        ),
    )
    body = F.when(F.size(docs) > 0, F.concat(F.lit(FOUND), F.array_join(parts, ""))).otherwise(NOT_FOUND)
    return F.concat(_system_part(system), body, question)


def labelled_prompt(system: Column, question: Column, knowledge: Column | None = None) -> Column:
    """The alternate wording with Chinese labels."""
    with_system = F.concat(F.lit("系统: "), system, F.lit("\n\n"))
    parts = [F.when(F.coalesce(system, F.lit("")) != "", with_system).otherwise("")]
    if knowledge is not None:
        parts += [F.lit("相关知识: "), knowledge, F.lit("\n\n")]
    return F.concat(*parts, F.lit("用户: "), question)


def build_prompts(
    questions: DataFrame,
    hits: DataFrame,
    *,
    query_id: str = "query_id",
    question: str = "question",
    system: Column | None = None,
    order: str = "rerank_rank",
    content: str = "content",
) -> DataFrame:
    """One prompt per question; a question without hits gets the direct prompt.

    The list per question is at most the rerank count long.
    """
    system = F.lit("") if system is None else system
    docs = hits.groupBy(query_id).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(content, F.lit("")).alias("c")))),
            lambda s: s["c"],
        ).alias("_docs")
    )
    joined = questions.join(docs, query_id, "left")
    prompt = F.when(F.col("_docs").isNull(), direct_prompt(system, F.col(question))).otherwise(
        context_prompt(system, F.col(question), F.col("_docs"))
    )
    return joined.select(
        query_id,
        system.alias("system"),
        F.col(question).alias("question"),
        F.coalesce(F.size("_docs"), F.lit(0)).alias("doc_count"),
        prompt.alias("prompt"),
    )


def score_summary(
    hits: DataFrame, score: str, order: str, label: str, digits: int = 4, prefix: str = "", query_id: str = "query_id"
) -> DataFrame:
    """``Match1: 0.8123, Match2: ...`` per question."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(score).alias("s"))))
    text = F.transform(
        items, lambda x, i: F.format_string(f"%s%d: %.{digits}f", F.lit(label), i + 1, x["s"])
    )
    return hits.groupBy(query_id).agg(F.concat(F.lit(prefix), F.array_join(text, ", ")).alias("summary"))


def split_prompt(prompt: Column) -> Column:
    """``struct<system, user>`` cut at the first blank line; without one everything is the user's."""
    cut = F.instr(prompt, "\n\n")
    return F.when(
        cut > 0,
        F.struct(
            trim_blank(F.left(prompt, cut - 1)).alias("system"),
            trim_blank(F.substring(prompt, cut + 2, F.length(prompt))).alias("user"),
        ),
    ).otherwise(F.struct(F.lit("").alias("system"), prompt.alias("user")))


def sent_body(model: Column, system: Column, user: Column) -> Column:
    """The body that is sent: model, messages (system only when there is one), stream."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    with_system = F.array(message("system", system), message("user", user))
    messages = F.when(F.coalesce(system, F.lit("")) != "", with_system).otherwise(F.array(message("user", user)))
    return F.to_json(F.struct(model.alias("model"), messages.alias("messages"), F.lit(True).alias("stream")))


def provider_body(provider: Column, model: Column, prompt: Column) -> Column:
    """The request body by provider; a local model needs none."""
    stream = F.lit(True).alias("stream")
    messages = F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages")
    named = model.alias("model")
    return (
        F.when(provider == "LOCAL", "{}")
        .when(provider == "OLLAMA", F.to_json(F.struct(named, prompt.alias("prompt"), stream)))
        .when(
            provider.isin("DOUBAO", "QIANWEN"),
            F.to_json(F.struct(named, messages, F.lit(0.7).alias("temperature"), stream)),
        )
        .otherwise(F.to_json(F.struct(named, messages, stream)))
    )
