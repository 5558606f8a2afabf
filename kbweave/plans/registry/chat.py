"""Chat rendering, answer assembly and prompt bodies over ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.functions.chat import chatml
from kbweave.functions.text import estimate_tokens
from kbweave.operators import prompts as P
from kbweave.operators.answers import assemble_answers, generation_stats, parse_footer, stats_footer
from kbweave.operators.chat import chat_text_parts, chatml_parts, question_answer_pairs
from kbweave.plans.registry import query, table
from kbweave.session import spread
from kbweave.sources.streams import is_done, parse_sse, sse_line

_CHATML_SQL = """
WITH t AS (
  SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last_turn,
    max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last_user FROM conversations)
SELECT conv_id, turn // 1024 AS part, string_agg('<|im_start|>' || role || E'\\n' || text || E'\\n'
  || {switch} || {end} || {opener}, '' ORDER BY turn) AS text
FROM t GROUP BY conv_id, turn // 1024
"""
_END = "E'<|im_end|>\\n'"


@query(
    "chat_text",
    """
WITH l AS (
  SELECT conv_id, turn, CASE lower(role) WHEN 'system' THEN '系统' WHEN 'user' THEN '用户' WHEN 'human' THEN '用户'
    WHEN 'assistant' THEN '助手' WHEN 'bot' THEN '助手' ELSE role END || ': ' || text || E'\\n\\n' AS line
  FROM conversations)
SELECT conv_id, turn // 1024 AS part, rtrim(string_agg(line, '' ORDER BY turn), E' \\n\\t\\r') AS text
FROM l GROUP BY conv_id, turn // 1024
""",
)
def chat_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_text_parts(table(spark, sf_dir, "conversations"))


@query("chatml", _CHATML_SQL.format(switch="''", end=_END, opener="''"))
def chatml_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatml_parts(table(spark, sf_dir, "conversations"))


@query(
    "chatml_no_think",
    _CHATML_SQL.format(
        switch="CASE WHEN turn = last_user AND NOT contains(text, '/no_think') THEN E'\\n/no_think' ELSE '' END",
        end=_END,
        opener="CASE WHEN turn = last_turn THEN E'<|im_start|>assistant\\n' ELSE '' END",
    ),
)
def chatml_no_think(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatml_parts(table(spark, sf_dir, "conversations"), add_generation_prompt=True, thinking=False)


@query(
    "chatml_continue",
    _CHATML_SQL.format(
        switch="''",
        end=f"CASE WHEN turn = last_turn AND role = 'assistant' THEN '' ELSE {_END} END",
        opener="''",
    ),
)
def chatml_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatml_parts(table(spark, sf_dir, "conversations"), continue_final=True)


@query(
    "chatml_messages",
    """
SELECT conv_id, turn, '<|im_start|>system' || E'\\nBe brief.\\n<|im_end|>\\n<|im_start|>' || role || E'\\n' || text
  || CASE WHEN role = 'user' THEN E'\\n\\n/no_think' ELSE E'\\n' END || E'<|im_end|>\\n' AS text
FROM conversations
""",
)
def chatml_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same template over a message array in one row."""
    message = lambda role, text: F.struct(role.alias("role"), text.alias("content"))
    messages = F.array(message(F.lit("system"), F.lit("Be brief.")), message(F.col("role"), F.col("text")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", messages.alias("m"))
    return turns.select("conv_id", "turn", chatml(F.col("m"), thinking=False).alias("text"))


@query(
    "question_answer_pairs",
    """
SELECT a.conv_id, b.turn, a.text AS instruction, b.text AS output FROM conversations a
JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'
""",
)
def question_answer_pairs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_answer_pairs(table(spark, sf_dir, "conversations"))


# --- captured responses --------------------------------------------------------------


def captured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn as the lines a streaming endpoint would send: one per word, then noise, then the end."""
    turns = spread(table(spark, sf_dir, "conversations").where(F.col("role") == "assistant"))
    response = (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id")
    words = F.split("text", "(?<= )", -1)
    lines = F.concat(
        F.transform(words, sse_line),
        F.array(F.lit(""), F.lit("data: {broken"), F.lit('data: {"choices":[{"delta":{}}]}'), F.lit("data: [DONE]")),
    )
    return turns.select(response, F.posexplode(lines).alias("seq", "value"))


ANSWERS_SQL = """
WITH w AS (
  SELECT conv_id * 1000 + turn AS response_id, unnest(string_split(text, ' ')) AS word,
    generate_subscripts(string_split(text, ' '), 1) - 1 AS seq, len(string_split(text, ' ')) AS n
  FROM conversations WHERE role = 'assistant')
SELECT response_id, seq // 1024 AS part, string_agg(word || CASE WHEN seq < n - 1 THEN ' ' ELSE '' END, '' ORDER BY seq) AS answer
FROM w GROUP BY response_id, seq // 1024
"""


@query("answer_assembly", ANSWERS_SQL)
def answer_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_answers(parse_sse(captured_lines(spark, sf_dir)))


@query(
    "sse_capture",
    """
SELECT conv_id * 1000 + turn AS response_id, len(string_split(text, ' ')) AS pieces, 1 AS ends
FROM conversations WHERE role = 'assistant'
""",
)
def sse_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pieces and end marks per response; blank and broken lines count for neither."""
    lines = captured_lines(spark, sf_dir)
    pieces = parse_sse(lines).groupBy("response_id").agg(F.count("*").alias("pieces"))
    ends = lines.where(is_done(F.col("value"))).groupBy("response_id").agg(F.count("*").cast("int").alias("ends"))
    return pieces.join(ends, "response_id")


_FOOTER_SQL = """
f AS (
  SELECT conv_id, role, greatest(1, length(text) // 4) AS tokens, turn * 250 + 500 AS millis FROM conversations)
"""


@query(
    "answer_footer",
    f"""
WITH {_FOOTER_SQL}, r AS (SELECT conv_id, tokens, millis, tokens * 1000.0::DOUBLE / millis AS rate FROM f)
SELECT conv_id, tokens, printf('%.2f', millis / 1000.0)::DOUBLE AS seconds, printf('%.2f', rate)::DOUBLE AS rate FROM r
""",
)
def answer_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics line written and read back."""
    tokens, millis = estimate_tokens(F.col("text")), F.col("turn") * 250 + 500
    answers = table(spark, sf_dir, "conversations").select(
        "conv_id", F.concat(F.col("text"), stats_footer(tokens, millis)).alias("answer")
    )
    return answers.select("conv_id", parse_footer(F.col("answer")).alias("f")).select("conv_id", "f.*")


@query(
    "generation_stats",
    f"""
WITH {_FOOTER_SQL}
SELECT role, count(*) AS answers, sum(tokens)::BIGINT AS tokens,
  round(sum(printf('%.2f', millis / 1000.0)::DOUBLE), 4) AS seconds,
  round(avg(printf('%.2f', tokens * 1000.0::DOUBLE / millis)::DOUBLE), 4) AS mean_rate
FROM f GROUP BY role
""",
)
def generation_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, millis = estimate_tokens(F.col("text")), F.col("turn") * 250 + 500
    answers = table(spark, sf_dir, "conversations").select(
        "role", F.concat(F.col("text"), stats_footer(tokens, millis)).alias("answer")
    )
    stats = generation_stats(answers, ["role"])
    return stats.withColumn("seconds", F.round("seconds", 4)).withColumn("mean_rate", F.round("mean_rate", 4))


# --- prompts -----------------------------------------------------------------------


@query(
    "prompt_forms",
    """
SELECT doc_id, coalesce(source || E'\\n\\n', '') || text AS direct,
  '系统: ' || source || E'\\n\\n相关知识: ' || lang || E'\\n\\n用户: ' || text AS labelled,
  '用户: ' || text AS labelled_bare, '[Q] ' || lang || ' [SEP] [D] ' || text || ' [SEP]' AS pair
FROM documents
""",
)
def prompt_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kbweave.operators.rerank import pair_text

    source, lang, text = F.col("source"), F.col("lang"), F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        P.direct_prompt(source, text).alias("direct"),
        P.labelled_prompt(source, text, lang).alias("labelled"),
        P.labelled_prompt(F.lit(""), text).alias("labelled_bare"),
        pair_text(lang, text).alias("pair"),
    )


@query(
    "prompt_with_gaps",
    """
SELECT doc_id, E'Be exact.\\n\\nThe following is information related to the question:\\nDocument1:\\n' || lang
  || E'\\n\\nDocument3:\\n' || text || E'\\n\\n' || source AS prompt,
  E'No information related to the question was found.\\n\\n' || source AS empty
FROM documents WHERE trim(text, E' \\n\\t\\r') <> ''
""",
)
def prompt_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank hit is left out of the prompt but keeps its number."""
    from kbweave.functions.text import is_blank

    docs = table(spark, sf_dir, "documents").where(~is_blank(F.col("text")))
    found = F.array(F.col("lang"), F.lit("  \n"), F.col("text"))
    none = F.array().cast("array<string>")
    return docs.select(
        "doc_id",
        P.context_prompt(F.lit("Be exact."), F.col("source"), found).alias("prompt"),
        P.context_prompt(F.lit(""), F.col("source"), none).alias("empty"),
    )


@query(
    "prompt_split",
    """
WITH p AS (SELECT doc_id, replace(text, E'.\\n', E'.\\n\\n') AS t FROM documents),
c AS (SELECT doc_id, t, instr(t, E'\\n\\n') AS cut FROM p)
SELECT doc_id, CASE WHEN cut > 0 THEN trim(t[1:cut - 1], E' \\n\\t\\r') ELSE '' END AS system,
  CASE WHEN cut > 0 THEN trim(substr(t, cut + 2), E' \\n\\t\\r') ELSE t END AS user
FROM c
""",
)
def prompt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit(".\n"), F.lit(".\n\n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", P.split_prompt(text).alias("s"))
    return docs.select("doc_id", "s.system", "s.user")


@query(
    "request_bodies",
    """
WITH p AS (
  SELECT item_id, text, CASE (item_id % 4)::INT WHEN 0 THEN 'OLLAMA' WHEN 1 THEN 'QIANWEN' WHEN 2 THEN 'LOCAL'
    ELSE 'OPENAI' END AS provider, '[{"role":"user","content":' || to_json(text) || '}]' AS messages FROM benchmark)
SELECT item_id, provider, CASE provider WHEN 'LOCAL' THEN '{}'
  WHEN 'OLLAMA' THEN '{"model":"m1","prompt":' || to_json(text) || ',"stream":true}'
  WHEN 'QIANWEN' THEN '{"model":"m1","messages":' || messages || ',"temperature":0.7,"stream":true}'
  ELSE '{"model":"m1","messages":' || messages || ',"stream":true}' END AS body,
  '{"model":"m1","messages":[{"role":"system","content":"Be exact."},{"role":"user","content":' || to_json(text)
    || '}],"stream":true}' AS sent
FROM p
""",
)
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("OLLAMA", "QIANWEN", "LOCAL", "OPENAI")))
    provider = F.element_at(names, (F.col("item_id") % 4 + 1).cast("int"))
    model, text = F.lit("m1"), F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", provider.alias("provider"), "text").select(
        "item_id",
        "provider",
        P.provider_body(F.col("provider"), model, text).alias("body"),
        P.sent_body(model, F.lit("Be exact."), text).alias("sent"),
    )
