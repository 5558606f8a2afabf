"""Knowledge base over ``documents``, questions from ``benchmark``: build, search, rerank, prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.functions.vectors import l2_norm
from kbweave.operators import kb as kb_table
from kbweave.operators.prompts import build_prompts, score_summary
from kbweave.operators.rerank import rerank
from kbweave.operators.search import search_topk
from kbweave.plans.build import build_from_notes, build_from_texts
from kbweave.plans.registry import query, table
from kbweave.plans.registry.text import CHUNKS_SQL
from kbweave.plans.retrieve import answer_requests, embed_questions, retrieve
from kbweave.session import scratch_path, written_below_scratch

DEPTH, RERANK_COUNT = 20, 5
_SYSTEM = "Answer from the documents."

# The default embedding in SQL: per distinct word 64 bytes of SHA-256, summed over the words
# of a text, divided by 255 times their number, held as float, scaled to length one.
EMBED_SQL = """
words AS (
  SELECT id, unnest(CASE WHEN len(w) = 0 THEN [t] ELSE w END) AS word
  FROM (SELECT id, t, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM {texts})),
counted AS (SELECT id, word, count(*) AS n FROM words GROUP BY id, word),
sizes AS (SELECT id, sum(n) AS total FROM counted GROUP BY id),
hashes AS (
  SELECT word, list_transform(range(64), lambda i:
    2 * ('0x' || substr(sha256((i // 32) || ':' || word), 2 * (i % 32)::INT + 1, 2))::INT - 255) AS h
  FROM (SELECT DISTINCT word FROM counted)),
sums AS (
  SELECT id, pos, sum(n * v) AS s
  FROM (SELECT id, n, unnest(h) AS v, unnest(range(64)) AS pos FROM counted JOIN hashes USING (word)) GROUP BY id, pos),
raw AS (
  SELECT id, list((s / (255.0::DOUBLE * total))::FLOAT ORDER BY pos)::DOUBLE[] AS v
  FROM sums JOIN sizes USING (id) GROUP BY id),
{out} AS (
  SELECT id, list_transform(v, lambda x: (x / sqrt(list_sum(list_transform(v, lambda y: y * y))))::FLOAT)::DOUBLE[] AS e
  FROM raw)
"""


def _embed_sql(texts: str, out: str) -> str:
    """The embedding's CTEs under names of their own."""
    sql = EMBED_SQL.format(texts=texts, out=out)
    for name in ("words", "counted", "sizes", "hashes", "sums", "raw"):
        for before, after in ((f"{name} AS (", f"{out}_{name} AS ("), (f"FROM {name}", f"FROM {out}_{name}"), (f"JOIN {name}", f"JOIN {out}_{name}")):
            sql = sql.replace(before, after)
    return sql


KB_SQL = (
    CHUNKS_SQL
    + """, kb_texts AS (SELECT (doc_id << 20) + chunk_index AS id, content AS t, source, lang FROM chunks),
"""
    + _embed_sql("kb_texts", "kb_vectors")
)
HITS_SQL = (
    KB_SQL
    + ", question_texts AS (SELECT item_id AS id, text AS t FROM benchmark),"
    + _embed_sql("question_texts", "question_vectors")
    + """, scored AS (
  SELECT q.id AS query_id, k.id, round(greatest(-1, least(1, list_cosine_similarity(q.e, k.e))), 6) AS similarity
  FROM question_vectors q, kb_vectors k),
hits AS (
  SELECT query_id, rank, id, similarity, t AS content, source FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank FROM scored)
  JOIN kb_texts USING (id) WHERE rank <= 20)
"""
)
RERANKED_SQL = (
    HITS_SQL
    + """, asked AS (
  SELECT h.*, b.text AS question, list_distinct(regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}]+')) AS qw,
    regexp_extract_all(lower(h.content), '[\\p{L}\\p{N}]+') AS dw
  FROM hits h JOIN benchmark b ON b.item_id = h.query_id),
logits AS (SELECT *, (1 + 4 * (len(list_intersect(qw, dw)) / len(qw)))::FLOAT::DOUBLE AS logit FROM asked),
reranked AS (
  SELECT * FROM (
    SELECT *, round(1 / (1 + exp(-logit)), 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-logit)), 6) DESC, rank)::INTEGER AS rerank_rank
    FROM logits) WHERE rerank_rank <= 5)
"""
)
PROMPTS_SQL = (
    RERANKED_SQL
    + """, prompts AS (
  SELECT query_id, question, count(*)::INTEGER AS doc_count,
    E'Answer from the documents.\\n\\nThe following is information related to the question:\\n'
    || string_agg('Document' || rerank_rank || E':\\n' || content || E'\\n\\n', '' ORDER BY rerank_rank) || question AS prompt
  FROM reranked GROUP BY query_id, question)
"""
)


def _created() -> F.Column:
    return F.timestamp_seconds(F.lit(1704067200))


def document_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as knowledge-base rows, one collection per language."""
    docs = table(spark, sf_dir, "documents")
    return build_from_texts(
        docs, collection=F.col("lang"), source=F.col("source"), created_at=_created()
    )


_STORED: dict[tuple[str, str], str] = {}


def stored_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as a table in the shared folder, built once per application and then searched."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = scratch_path(spark, "document-kb")
        kb_table.overwrite(document_kb(spark, sf_dir), path)
        _STORED[key] = path
    return kb_table.read(spark, _STORED[key])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _weighted(vector: str) -> F.Column:
    """Sum of entry times place: one number that changes with any entry."""
    terms = F.transform(vector, lambda x, i: x.cast("double") * (i + 1))
    return F.round(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), 4)


@query(
    "document_kb",
    f"""
WITH {KB_SQL}
SELECT id, lang AS collection, source, t AS content, 64 AS dimension,
  round(list_sum(list_transform(e, lambda x, i: x * i)), 4) AS weighted,
  '{{"source":"' || source || '","chunkIndex":' || (id % 1048576)
    || ',"extractionTime":1704067200000,"created_at":1704067200000}}' AS metadata
FROM kb_texts JOIN kb_vectors USING (id)
""",
)
def document_kb_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, chunk, embed, check and describe every document."""
    return document_kb(spark, sf_dir).select(
        "id",
        "collection",
        "source",
        "content",
        F.size("embedding").alias("dimension"),
        _weighted("embedding").alias("weighted"),
        "metadata",
    )


@query(
    "question_vectors",
    "WITH question_texts AS (SELECT item_id AS id, text AS t FROM benchmark),"
    + _embed_sql("question_texts", "question_vectors")
    + "SELECT id AS query_id, round(list_sum(list_transform(e, lambda x, i: x * i)), 4) AS weighted, 1.0::DOUBLE AS norm"
    " FROM question_vectors",
)
def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = embed_questions(questions(spark, sf_dir))
    return vectors.select(
        "query_id", _weighted("embedding").alias("weighted"), F.round(l2_norm(F.col("embedding")), 4).alias("norm")
    )


@query("rag_search", f"WITH {HITS_SQL} SELECT query_id, rank, id, similarity, content, source FROM hits")
def rag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = stored_kb(spark, sf_dir)
    hits = search_topk(embed_questions(questions(spark, sf_dir)), kb, DEPTH, attach=["content", "source"])
    return hits.select(
        "query_id", "rank", "id", "similarity", "content", "source"
    )


@query(
    "kb_mixed_search",
    f"""
WITH {KB_SQL}
, question_texts AS (SELECT item_id AS id, text AS t FROM benchmark),
{_embed_sql("question_texts", "question_vectors")},
stored AS (
  SELECT id, t AS content, e, b FROM kb_texts JOIN kb_vectors USING (id) CROSS JOIN (VALUES ('one'), ('two')) v(b)
  UNION ALL SELECT q.id * 1048576, t.t, q.e, 'one' FROM question_vectors q JOIN question_texts t USING (id)),
scored AS (
  SELECT q.id AS query_id, s.id, s.content, s.b, round(greatest(-1, least(1, list_cosine_similarity(q.e, s.e))), 6) AS similarity
  FROM question_vectors q, stored s)
SELECT query_id, rank, id, b AS batch, similarity, content FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id, b, content)::INTEGER AS rank FROM scored)
WHERE rank <= 20
""",
)
def kb_mixed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, notes and a second append of the same documents in one collection: each hit has its own text."""
    path = scratch_path(spark, "mixed-kb")
    # Both appends take the same rows, which are built once.
    docs = written_below_scratch(document_kb(spark, sf_dir).withColumn("collection", F.lit("all")), "mixed-documents")
    notes = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("note_id"), F.lit("item").alias("title"), F.col("text").alias("content")
    )
    made = build_from_notes(notes, collection=F.lit("all"), created_at=_created())
    kb_table.append(docs.unionByName(made), path, "one")
    kb_table.append(docs, path, "two")
    hits = search_topk(embed_questions(questions(spark, sf_dir)), kb_table.read(spark, path), DEPTH, attach=["content"])
    return hits.select("query_id", "rank", "id", "batch", "similarity", "content")


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve(
        questions(spark, sf_dir), stored_kb(spark, sf_dir), depth=DEPTH, rerank_count=RERANK_COUNT
    )


@query(
    "rag_rerank",
    f"WITH {RERANKED_SQL} SELECT query_id, rerank_rank, rank, id, score, similarity FROM reranked",
)
def rag_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reranked(spark, sf_dir).select("query_id", "rerank_rank", "rank", "id", "score", "similarity")


@query(
    "rag_without_rerank",
    f"WITH {HITS_SQL} SELECT query_id, rank, rank AS rerank_rank, NULL::DOUBLE AS score, id FROM hits",
)
def rag_without_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rerank count of 0 keeps the search order."""
    hits = retrieve(questions(spark, sf_dir), stored_kb(spark, sf_dir), depth=DEPTH, rerank_count=0)
    return hits.select("query_id", "rank", "rerank_rank", "score", "id")


@query(
    "rag_in_collection",
    f"""
WITH {KB_SQL}
, question_texts AS (SELECT item_id AS id, text AS t FROM benchmark),
{_embed_sql("question_texts", "question_vectors")},
scored AS (
  SELECT q.id AS query_id, k.id, x.lang AS collection,
    round(greatest(-1, least(1, list_cosine_similarity(q.e, k.e))), 6) AS similarity
  FROM question_vectors q JOIN kb_texts x ON x.lang = ['en', 'fr', 'de', 'es'][q.id % 4 + 1] JOIN kb_vectors k ON k.id = x.id)
SELECT query_id, collection, rank, id, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank FROM scored)
WHERE rank <= 20
""",
)
def rag_in_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question names the knowledge base it is asked of."""
    names = F.array(*map(F.lit, ("en", "fr", "de", "es")))
    asked = questions(spark, sf_dir).withColumn(
        "collection", F.element_at(names, (F.col("query_id") % 4 + 1).cast("int"))
    )
    hits = retrieve(asked, stored_kb(spark, sf_dir), depth=DEPTH, rerank_count=0, by_collection=True)
    return hits.select("query_id", "collection", "rank", "id", "similarity")


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_prompts(questions(spark, sf_dir), _reranked(spark, sf_dir), system=F.lit(_SYSTEM))


@query("rag_prompt", f"WITH {PROMPTS_SQL} SELECT query_id, doc_count, prompt FROM prompts")
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir).select("query_id", "doc_count", "prompt")


@query(
    "rag_requests",
    f"""
WITH {PROMPTS_SQL}
SELECT query_id, 'DEEPSEEK' AS provider, 'https://api.deepseek.com/v1/chat/completions' AS endpoint,
  '{{"model":"m1","messages":[{{"role":"system","content":"Answer from the documents."}},{{"role":"user","content":'
    || to_json(substr(prompt, 29)) || '}}],"stream":true}}' AS body
FROM prompts
""",
)
def rag_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_requests(
        questions(spark, sf_dir),
        stored_kb(spark, sf_dir),
        model=F.lit("m1"),
        url=F.lit("https://api.deepseek.com/"),
        system=F.lit(_SYSTEM),
        depth=DEPTH,
        rerank_count=RERANK_COUNT,
    )


@query(
    "rag_summaries",
    f"""
WITH {RERANKED_SQL},
m AS (SELECT query_id, string_agg('Match' || rank || ': ' || round(similarity::DECIMAL(10, 6), 4)::DECIMAL(10, 4), ', ' ORDER BY rank) AS matches
      FROM hits GROUP BY query_id),
r AS (SELECT query_id, 'Reranked Results - '
        || string_agg('Rerank' || rerank_rank || ': ' || round(score::DECIMAL(10, 6), 4)::DECIMAL(10, 4), ', ' ORDER BY rerank_rank) AS reranks
      FROM reranked GROUP BY query_id)
SELECT query_id, matches, reranks FROM m JOIN r USING (query_id)
""",
)
def rag_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, kb = questions(spark, sf_dir), stored_kb(spark, sf_dir)
    hits = retrieve(asked, kb, depth=DEPTH, rerank_count=0)
    best = rerank(hits.drop("rerank_rank", "score"), RERANK_COUNT)
    matches = score_summary(hits, "similarity", "rank", "Match").withColumnRenamed("summary", "matches")
    reranks = score_summary(best, "score", "rerank_rank", "Rerank", prefix="Reranked Results - ")
    return matches.join(reranks.withColumnRenamed("summary", "reranks"), "query_id")


@query(
    "rag_nothing_found",
    "SELECT item_id AS query_id, 0 AS doc_count, E'Answer from the documents.\\n\\n' || text AS prompt FROM benchmark",
)
def rag_nothing_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without retrieval every question gets the direct prompt."""
    asked = questions(spark, sf_dir)
    hits = retrieve(asked, stored_kb(spark, sf_dir), depth=0)
    return build_prompts(asked, hits, system=F.lit(_SYSTEM)).select("query_id", "doc_count", "prompt")


@query(
    "note_kb",
    """
WITH n AS (SELECT conv_id * 1000 + turn AS note_id, trim(text, E' \\n\\t\\r') AS c, length(trim(text, E' \\n\\t\\r')) AS n
           FROM conversations WHERE trim(text, E' \\n\\t\\r') <> '')
SELECT note_id, CASE WHEN n > 500 THEN ceil((n - 100) / 400)::BIGINT ELSE 1 END AS chunks FROM n
WHERE n <= 500 OR (n - 100) % 400 >= 0
""",
)
def note_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a note, chunked, embedded and stored under its labels."""
    notes = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"),
        F.col("role").alias("title"),
        F.col("text").alias("content"),
    )
    rows = build_from_notes(notes, created_at=_created())
    return rows.groupBy(F.shiftright("id", 20).alias("note_id")).agg(F.count("*").alias("chunks"))
