"""Cleaning, chunking and scalar text functions over ``documents``, ``conversations`` and others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.functions import chunks as C
from kbweave.functions import text as X
from kbweave.functions.providers import (
    detect_provider,
    expected_dimension,
    full_endpoint,
    normalizes_embeddings,
)
from kbweave.functions.vectors import (
    attention_mask,
    drop_special_ids,
    token_type_ids,
    truncate_ids,
    truncate_pair_ids,
)
from kbweave.operators.answers import build_progress, token_report
from kbweave.operators.chunking import (
    chunk_metadata,
    dataset_metadata,
    default_title,
    explode_chunks,
    explode_notes,
)
from kbweave.plans.registry import query, table
from kbweave.session import spread

# Cleaning without back-references: characters become rows, equal neighbours a run.
CLEAN_SQL = """
flat AS (
  SELECT doc_id, lang, source, regexp_replace(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'),
    '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]|\\p{Cf}', '', 'g') AS t FROM documents),
chars AS (
  SELECT doc_id, c, i, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run
  FROM (SELECT doc_id, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM flat)),
runs AS (
  SELECT doc_id, min(i) AS start, repeat(c, CASE WHEN count(*) > 10 THEN 3 ELSE count(*) END) AS piece
  FROM chars GROUP BY doc_id, c, run),
joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY start) AS t FROM runs GROUP BY doc_id),
clean AS (
  SELECT f.doc_id, f.lang, f.source, trim(coalesce(j.t, ''), ' ') AS text FROM flat f LEFT JOIN joined j USING (doc_id))
"""

CHUNKS_SQL = (
    CLEAN_SQL
    + """,
windows AS (
  SELECT doc_id, lang, source, w, substr(text, w * 400 + 1, 500) AS content
  FROM (SELECT *, unnest(range(greatest(1, ceil((length(text) - 100) / 400))::BIGINT)) AS w FROM clean WHERE text <> '')),
chunks AS (
  SELECT doc_id, lang, source, (row_number() OVER (PARTITION BY doc_id ORDER BY w) - 1)::INTEGER AS chunk_index,
    (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks, content
  FROM windows WHERE length(content) >= 10)
"""
)


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return docs.select("doc_id", "lang", "source", X.clean_text(F.col("text")).alias("text"))


@query("clean_text", f"WITH {CLEAN_SQL} SELECT doc_id, text, length(text)::INTEGER AS n_chars FROM clean")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_documents(spark, sf_dir).select("doc_id", "text", F.length("text").alias("n_chars"))


@query(
    "clean_pages",
    """
SELECT page_id, trim(regexp_replace(regexp_replace(html, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'),
  '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]|\\p{Cf}', '', 'g'), ' ') AS text
FROM pages
""",
)
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages are plain text here: their tags stay."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", X.clean_text(F.col("html")).alias("text"))


@query("fixed_chunks", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_index, total_chunks, content FROM chunks")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = clean_documents(spark, sf_dir).select("doc_id", "text")
    return explode_chunks(docs)


@query(
    "chunk_metadata",
    f"""
WITH {CHUNKS_SQL}
SELECT doc_id, chunk_index,
  '{{"source":"' || source || '","chunkIndex":' || chunk_index || ',"extractionTime":1700000000000}}' AS text_metadata,
  '{{"fileName":"' || source || '","fileIndex":' || (doc_id % 100) || ',"chunkIndex":' || chunk_index
    || ',"totalChunks":' || total_chunks
    || ',"extractionTime":1700000000000,"processingMethod":"JsonOptimized"}}' AS dataset_metadata
FROM chunks
""",
)
def chunk_metadata_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = explode_chunks(clean_documents(spark, sf_dir))
    at = F.lit(1700000000000)
    index, total = F.col("chunk_index"), F.col("total_chunks")
    return chunks.select(
        "doc_id",
        "chunk_index",
        chunk_metadata(F.col("source"), index, at).alias("text_metadata"),
        dataset_metadata(F.col("source"), F.col("doc_id") % 100, index, total, at).alias("dataset_metadata"),
    )


@query(
    "note_chunks",
    """
WITH notes AS (
  SELECT conv_id, turn, trim(CASE WHEN length(trim(text)) > 20 THEN trim(text)[1:20] || '...' ELSE trim(text) END) AS title,
    trim(text, E' \\n\\t\\r') AS content FROM conversations),
valid AS (SELECT * FROM notes WHERE title <> '' AND content <> ''),
pieces AS (
  SELECT conv_id, turn, title, w, true AS split, substr(content, w * 400 + 1, 500) AS content
  FROM (SELECT *, unnest(range(ceil((length(content) - 100) / 400)::BIGINT)) AS w FROM valid WHERE length(content) > 500)
  UNION ALL SELECT conv_id, turn, title, 0, false, content FROM valid WHERE length(content) <= 500),
kept AS (
  SELECT conv_id, turn, title, split, content,
    (row_number() OVER (PARTITION BY conv_id, turn ORDER BY w) - 1)::INTEGER AS chunk_index,
    (count(*) OVER (PARTITION BY conv_id, turn))::INTEGER AS total_chunks
  FROM pieces WHERE NOT split OR length(content) >= 10)
SELECT conv_id, turn, chunk_index, total_chunks, content,
  title || CASE WHEN split THEN ' (BLK ' || (chunk_index + 1) || '/' || total_chunks || ')' ELSE '' END AS source
FROM kept
""",
)
def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a note whose title is derived from its text."""
    notes = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", default_title(F.col("text")).alias("title"), F.col("text").alias("content")
    )
    return explode_notes(notes)


_RESPLIT_SQL = """
, pieces AS (
  SELECT doc_id, p, w, substr(body, w * 400 + 1, 500) AS content
  FROM (SELECT *, unnest(range(ceil((length(body) - 100) / 400)::BIGINT)) AS w FROM parts WHERE length(body) > 500)
  UNION ALL SELECT doc_id, p, 0, body FROM parts WHERE length(body) <= 500)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p, w) - 1)::INTEGER AS chunk_index,
  (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks, content
FROM pieces WHERE length(content) >= 10 AND trim(content, E' \\n\\t\\r') <> ''
"""


@query(
    "paragraph_chunks",
    """
WITH split AS (
  SELECT doc_id, regexp_split_to_array(replace(text, E'.\\n', E'.\\n \\n'), '\\n\\s*\\n') AS a FROM documents
  WHERE trim(text, E' \\n\\t\\r') <> ''),
parts AS (SELECT doc_id, generate_subscripts(a, 1) AS p, trim(unnest(a), E' \\n\\t\\r') AS body FROM split)
"""
    + _RESPLIT_SQL,
)
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of the uncleaned text; a line end after a full stop is made a blank line."""
    text = F.replace("text", F.lit(".\n"), F.lit(".\n \n"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", text)
    return explode_chunks(docs, chunker=C.paragraph_chunks)


# Documents with a heading per text line that follows a full stop.
_SECTIONS_SQL = """
WITH marked AS (
  SELECT doc_id, string_split(replace(text, E'.\\n', E'.\\n\\x01## '), E'\\x01') AS a FROM documents
  WHERE trim(text, E' \\n\\t\\r') <> ''),
cut AS (SELECT doc_id, generate_subscripts(a, 1) AS p, unnest(a) AS s FROM marked),
sections AS (
  SELECT doc_id, p, CASE WHEN p > 1 THEN trim(regexp_extract(s, '^## +([^\\r\\n]*)', 1), E' \\t') ELSE '' END AS title,
    trim(CASE WHEN p > 1 THEN regexp_replace(s, '^##[ \\t]+[^\\r\\n]*', '') ELSE s END, E' \\n\\t\\r') AS body FROM cut),
titled AS (
  SELECT *, concat_ws(E'\\n', nullif(title, ''), nullif(body, '')) AS content FROM sections
  WHERE title <> '' OR body <> '')
"""


def _with_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit(".\n"), F.lit(".\n## "))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", text)


@query(
    "section_chunks",
    _SECTIONS_SQL
    + """
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1)::INTEGER AS chunk_index,
  (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks, content
FROM titled WHERE length(content) >= 10
""",
)
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_chunks(_with_headings(spark, sf_dir), chunker=C.section_chunks)


@query(
    "mixed_chunks",
    _SECTIONS_SQL
    + """,
pieces AS (
  SELECT doc_id, p, 0 AS w, content FROM titled WHERE length(content) <= 500
  UNION ALL
  SELECT doc_id, p, w, concat_ws(E'\\n', nullif(title, ''), nullif(substr(body, w * 400 + 1, 500), ''))
  FROM (SELECT *, unnest(range(greatest(1, ceil((length(body) - 100) / 400))::BIGINT)) AS w FROM titled
        WHERE length(content) > 500 AND body <> ''))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p, w) - 1)::INTEGER AS chunk_index,
  (count(*) OVER (PARTITION BY doc_id))::INTEGER AS total_chunks, content
FROM pieces WHERE length(content) >= 10
""",
)
def mixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_chunks(_with_headings(spark, sf_dir), chunker=C.mixed_chunks)


@query(
    "token_estimate",
    """
SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS tokens,
  least(greatest(512, length(text) // 4 + 100), 2048)::INTEGER AS budget, length(text) > 4000 AS too_long
FROM documents
""",
)
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        X.estimate_tokens(text).alias("tokens"),
        X.prompt_budget(text, 2048).alias("budget"),
        X.prompt_too_long(text).alias("too_long"),
    )


@query(
    "token_report",
    """
SELECT lang, count(*) AS texts, sum(t)::BIGINT AS tokens, min(t) AS min_tokens, max(t) AS max_tokens
FROM (SELECT lang, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INTEGER AS t
      FROM documents) GROUP BY lang
""",
)
def token_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(table(spark, sf_dir, "documents"), ["lang"])


@query(
    "text_helpers",
    """
SELECT doc_id, CASE WHEN length(text) > 50 THEN text[1:50] || '...' ELSE text END AS preview,
  ((length(text) - length(replace(text, 'the', ''))) / 3)::INTEGER AS the_count,
  CASE WHEN contains(lang, '/think') THEN lang ELSE lang || E'\\n/think' END AS think,
  CASE WHEN contains(source || '/no_think', '/no_think') THEN source || '/no_think' END AS no_think,
  printf('%.3f', n_chars / 7.0) AS three_digits, printf('%.4f', n_chars / 7.0) AS four_digits,
  printf('%02d:%02d:%02d', n_chars // 3600, n_chars // 60 % 60, n_chars % 60) AS duration,
  true AS valid_utf8, false AS cut_utf8
FROM documents
""",
)
def text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        X.preview(text, 50).alias("preview"),
        X.count_occurrences(text, "the").alias("the_count"),
        X.add_thinking_suffix(F.col("lang"), True).alias("think"),
        X.add_thinking_suffix(F.concat("source", F.lit("/no_think")), False).alias("no_think"),
        X.fixed_decimals(F.col("n_chars") / F.lit(7.0), 3).alias("three_digits"),
        X.fixed_decimals(F.col("n_chars") / F.lit(7.0), 4).alias("four_digits"),
        X.duration_hms(F.col("n_chars") * 1000).alias("duration"),
        X.valid_utf8(F.encode(text, "UTF-8")).alias("valid_utf8"),
        X.valid_utf8(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("E4B8")))).alias("cut_utf8"),
    )


@query(
    "unicode_escapes",
    """
WITH t AS (SELECT doc_id, translate(text, 'enst', '中文字a') AS text FROM documents),
e AS (
  SELECT doc_id, text, list_aggregate(list_transform(string_split(text, ''), lambda c:
    CASE WHEN c BETWEEN '一' AND '鿿' THEN printf('\\u%04x', ord(c)) ELSE c END), 'string_agg', '') AS encoded FROM t)
SELECT doc_id, coalesce(encoded, '') AS encoded, text AS decoded, text AS twice,
  coalesce(encoded, '') <> text AS escaped,
  regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS stripped
FROM e
""",
)
def unicode_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some letters turned into Chinese ones, escaped, and read back (also when escaped twice)."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.translate("text", "enst", "中文字a").alias("t")
    )
    encoded = docs.withColumn("encoded", X.encode_chinese(F.col("t")))
    double = F.replace("encoded", F.lit("\\u"), F.lit("\\u005cu"))
    return encoded.select(
        "doc_id",
        "encoded",
        X.decode_unicode_escapes(F.col("encoded")).alias("decoded"),
        X.decode_repeatedly(double).alias("twice"),
        X.contains_unicode_escapes(F.col("encoded")).alias("escaped"),
        X.decode_and_strip(F.col("encoded")).alias("stripped"),
    )


@query(
    "fence_repair",
    """
WITH t AS (
  SELECT conv_id, turn, turn % 4 AS kind, text FROM conversations)
SELECT conv_id, turn,
  kind IN (0, 3) AS open_fence,
  CASE kind
    WHEN 0 THEN E'```py\\n' || text || E'\\n```'
    WHEN 1 THEN E'```\\n' || text || E'\\n   ```'
    WHEN 2 THEN 'x` ' || text || '`'
    ELSE text || E'\\n```\\n a ` b' || E'\\n```' || '`' END AS fixed
FROM t
""",
)
def fence_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with an open fence, a closed one, a lone backtick, and both."""
    text, kind = F.col("text"), F.col("turn") % 4
    broken = (
        F.when(kind == 0, F.concat(F.lit("```py\n"), text))
        .when(kind == 1, F.concat(F.lit("```\n"), text, F.lit("\n   ```")))
        .when(kind == 2, F.concat(F.lit("x` "), text))
        .otherwise(F.concat(text, F.lit("\n```\n a ` b")))
    )
    answers = table(spark, sf_dir, "conversations").select("conv_id", "turn", broken.alias("a"))
    return answers.select(
        "conv_id",
        "turn",
        X.has_open_fence(F.col("a")).alias("open_fence"),
        X.fix_code_blocks(F.col("a")).alias("fixed"),
    )


@query(
    "secret_masking",
    """
SELECT c_custkey, c_name[1:4] || '...' || c_name[-4:] AS name,
  CASE WHEN length(c_mktsegment) <= 8 THEN '****' ELSE c_mktsegment[1:4] || '...' || c_mktsegment[-4:] END AS segment,
  '' AS nothing
FROM customer
""",
)
def secret_masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        X.mask_secret(F.col("c_name")).alias("name"),
        X.mask_secret(F.col("c_mktsegment")).alias("segment"),
        X.mask_secret(F.lit("")).alias("nothing"),
    )


@query(
    "file_routing",
    """
WITH n AS (
  SELECT page_id, regexp_extract(url, '([^/]*)$', 1) || CASE (page_id % 8)::INT WHEN 0 THEN '.DOCX' WHEN 1 THEN '.xls'
    WHEN 2 THEN '.pptx' WHEN 3 THEN '.pdf' WHEN 4 THEN '-alpaca.json' WHEN 5 THEN '-other.json' WHEN 6 THEN '.docx.txt'
    ELSE '-STAR.txt' END AS file_name FROM pages)
SELECT page_id, file_name, (page_id % 8) IN (0, 1, 2) AS office, page_id % 8 = 3 AS pdf,
  page_id % 8 = 4 OR (page_id % 8 = 5 AND regexp_matches(file_name, 'datasets-sb|alpaca|STAR|star')) AS ignores_min_size
FROM n
""",
)
def file_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File type by name, the names made from page addresses."""
    endings = (".DOCX", ".xls", ".pptx", ".pdf", "-alpaca.json", "-other.json", ".docx.txt", "-STAR.txt")
    ending = F.element_at(F.array(*map(F.lit, endings)), (F.col("page_id") % 8 + 1).cast("int"))
    name = X.file_name(F.concat("url", ending))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("file_name")).select(
        "page_id",
        "file_name",
        X.is_office_document(F.col("file_name")).alias("office"),
        X.is_pdf_document(F.col("file_name")).alias("pdf"),
        X.ignores_min_size(F.col("file_name")).alias("ignores_min_size"),
    )


@query(
    "provider_route",
    """
WITH u AS (SELECT page_id, CASE (page_id % 8)::INT WHEN 0 THEN 'local' WHEN 1 THEN 'http://localhost:11434/' || page_id
  WHEN 2 THEN replace(url, 'example', 'deepseek') WHEN 3 THEN replace(url, 'example', 'moonshot') || '/'
  WHEN 4 THEN replace(url, 'example', 'volces') WHEN 5 THEN replace(url, 'example', 'dashscope')
  WHEN 6 THEN url || '/v1/chat/completions' ELSE url END AS url FROM pages),
p AS (SELECT page_id, url, CASE WHEN lower(url) = 'local' THEN 'LOCAL'
  WHEN url LIKE '%ollama%' OR url LIKE '%localhost%' THEN 'OLLAMA' WHEN url LIKE '%deepseek%' THEN 'DEEPSEEK'
  WHEN url LIKE '%moonshot%' THEN 'MOONSHOT' WHEN url LIKE '%volces%' OR url LIKE '%ark%' THEN 'DOUBAO'
  WHEN url LIKE '%dashscope%' OR url LIKE '%aliyun%' THEN 'QIANWEN' ELSE 'OPENAI' END AS provider FROM u),
b AS (SELECT page_id, provider, regexp_replace(url, '/$', '') AS base, CASE provider WHEN 'OLLAMA' THEN '/api/generate'
  WHEN 'DOUBAO' THEN '/api/completion' WHEN 'QIANWEN' THEN '/v1/services/aigc/text-generation/generation'
  ELSE '/v1/chat/completions' END AS path FROM p)
SELECT page_id, provider, CASE WHEN provider = 'LOCAL' THEN 'local' WHEN contains(base, path) THEN base
  ELSE base || path END AS endpoint FROM b
""",
)
def provider_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, kind = F.col("url"), F.col("page_id") % 8
    moved = lambda host: F.replace(url, F.lit("example"), F.lit(host))
    address = (
        F.when(kind == 0, "local")
        .when(kind == 1, F.concat(F.lit("http://localhost:11434/"), F.col("page_id").cast("string")))
        .when(kind == 2, moved("deepseek"))
        .when(kind == 3, F.concat(moved("moonshot"), F.lit("/")))
        .when(kind == 4, moved("volces"))
        .when(kind == 5, moved("dashscope"))
        .when(kind == 6, F.concat(url, F.lit("/v1/chat/completions")))
        .otherwise(url)
    )
    routed = table(spark, sf_dir, "pages").select("page_id", address.alias("u"))
    routed = routed.withColumn("provider", detect_provider(F.col("u")))
    return routed.select("page_id", "provider", full_endpoint(F.col("u"), F.col("provider")).alias("endpoint"))


# Model names that meet every dimension rule.
_MODELS = (
    "Qwen3-Embedding-0.6B", "qwen-1.5b", "qwen-7b", "bge-small-zh", "bge-m3", "bert-large-uncased", "bert-base",
    "sentence-t5", "unknown",
)


@query(
    "model_rules",
    """
WITH m AS (SELECT p_partkey, (p_partkey % 9)::INT AS k FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 384
  ELSE [1024, 1536, 1024, 768, 1024, 1024, 768, 768, 1024][k + 1] END AS dimension,
  k NOT IN (3, 4, 5, 6, 7) AS normalizes
FROM m
""",
)
def model_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension and normalisation by model name, one name per part; some have a configured size."""
    name = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    hidden = F.when(F.col("p_partkey") % 5 == 0, 384)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        expected_dimension(name, hidden).alias("dimension"),
        normalizes_embeddings(name, F.lit(False)).alias("normalizes"),
    )


@query(
    "token_id_rules",
    """
WITH i AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)::INTEGER) AS ids FROM documents)
SELECT doc_id,
  array_to_string(CASE WHEN len(ids) > 16 THEN list_append(ids[1:15], 2) ELSE ids END, ' ') AS cut,
  len(ids[1:512])::INTEGER AS pair_length,
  array_to_string(list_filter(ids[1:512], lambda x: x NOT IN (0, 1, 4)), ' ') AS shown,
  len(ids)::INTEGER AS mask_sum, 0 AS type_sum
FROM i
""",
)
def token_id_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word lengths stand in for token ids."""
    ids = F.transform(F.split("text", " ", -1), lambda w: F.length(w))
    docs = table(spark, sf_dir, "documents").select("doc_id", ids.alias("ids"))
    as_text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), " ")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    col = F.col("ids")
    return docs.select(
        "doc_id",
        as_text(truncate_ids(col, 16)).alias("cut"),
        F.size(truncate_pair_ids(col)).alias("pair_length"),
        as_text(drop_special_ids(truncate_pair_ids(col), [0, 1, 2, 4], [2])).alias("shown"),
        total(attention_mask(col)).alias("mask_sum"),
        total(token_type_ids(col)).alias("type_sum"),
    )


@query(
    "build_progress",
    """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber < 7 THEN floor(l_linenumber / 7 * 50) ELSE 50 + floor(l_discount * 10 * 100 / 2) END::INTEGER
    AS percent
FROM lineitem
""",
)
def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers as files done out of seven, the discount as share of chunks done."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        build_progress(F.col("l_linenumber"), F.lit(7), F.col("l_discount") * 10, F.lit(1)).alias("percent"),
    )
