"""Knowledge-base tables: catalog, guards, metadata and stored copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.operators import kb, staging
from kbweave.operators.answers import search_notes
from kbweave.plans.registry import query, table
from kbweave.session import scratch_path


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as rows without a model: the whole text is the chunk, its length the vector.

    Short documents have no vector.
    """
    size = F.col("n_chars").cast("float")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("collection"),
        F.col("text").alias("content"),
        F.lit("{}").alias("metadata"),
        "source",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("created_at"),
        F.when(F.col("n_chars") < 200, F.array().cast("array<float>"))
        .otherwise(F.array(size, F.lit(1.0).cast("float")))
        .alias("embedding"),
    )


_ROWS_SQL = """
rows AS (
  SELECT doc_id AS id, lang AS collection, text AS content, source, n_chars,
    TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS created_at FROM documents WHERE n_chars >= 200 AND text <> '')
"""


@query(
    "kb_rejects",
    "SELECT lang AS collection, count(*) FILTER (WHERE n_chars < 200 OR text = '') AS rejected, count(*) AS total"
    " FROM documents GROUP BY lang",
)
def kb_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without text or vector are not stored."""
    rows = _rows(spark, sf_dir)
    kept = kb.storable(rows).groupBy("collection").agg(F.count("*").alias("kept"))
    total = rows.groupBy("collection").agg(F.count("*").alias("total"))
    return total.join(kept, "collection", "left").select(
        "collection", (F.col("total") - F.coalesce("kept", F.lit(0))).alias("rejected"), "total"
    )


_CATALOG_SQL = f"""
WITH {_ROWS_SQL}
SELECT collection, count(*) AS chunk_count, count(DISTINCT source) AS source_count, 2 AS embedding_dimension,
  false AS mixed_dimensions, min(created_at) AS created_at, max(created_at) AS last_modified FROM rows GROUP BY collection
"""


@query("kb_catalog", _CATALOG_SQL)
def kb_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.catalog(kb.storable(_rows(spark, sf_dir)))


@query("kb_sources", f"WITH {_ROWS_SQL} SELECT collection, source, count(*) AS chunk_count FROM rows GROUP BY collection, source")
def kb_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.sources(kb.storable(_rows(spark, sf_dir)))


@query(
    "kb_listing",
    "SELECT DISTINCT CASE WHEN lang = 'de' THEN '.de' WHEN lang = 'es' THEN '_es' ELSE lang END AS collection"
    " FROM documents WHERE lang NOT IN ('de', 'es')",
)
def kb_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hidden names are not listed."""
    lang = F.col("lang")
    name = F.when(lang == "de", ".de").when(lang == "es", "_es").otherwise(lang)
    return kb.list_collections(table(spark, sf_dir, "documents").select(name.alias("collection")))


@query(
    "build_totals",
    """
WITH p AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
SELECT count(*) AS files, sum(n)::BIGINT AS chunks, min(n) AS min_chunks_per_file, max(n) AS max_chunks_per_file FROM p
""",
)
def build_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.build_totals(table(spark, sf_dir, "documents"))


def _catalog_with_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One knowledge base per segment; its dimension and model come from its customers."""
    customers = table(spark, sf_dir, "customer")
    return customers.groupBy(F.col("c_mktsegment").alias("collection")).agg(
        (F.length(F.min("c_mktsegment")) * 64).alias("embedding_dimension"),
        F.concat(F.lit("m"), (F.length(F.min("c_mktsegment")) % 3).cast("string")).alias("embedding_model"),
    )


_MODELS_SQL = """
c AS (SELECT c_mktsegment AS collection, length(c_mktsegment)::INTEGER * 64 AS embedding_dimension,
  'm' || length(c_mktsegment) % 3 AS embedding_model FROM customer GROUP BY c_mktsegment)
"""


@query(
    "kb_append_check",
    f"""
WITH {_MODELS_SQL}, i AS (
  SELECT CASE WHEN c_custkey % 11 = 0 THEN 'new' ELSE c_mktsegment END AS collection,
    (length(c_mktsegment) * 64 + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END)::INTEGER AS dimension,
    'm' || c_custkey % 3 AS model, c_custkey FROM customer)
SELECT c_custkey, collection, CASE WHEN embedding_dimension IS NULL THEN 'new'
  WHEN embedding_dimension <> dimension THEN 'refused' WHEN embedding_model <> model THEN 'model_differs' ELSE 'ok' END AS status
FROM i LEFT JOIN c USING (collection)
""",
)
def kb_append_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    incoming = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 11 == 0, "new").otherwise(F.col("c_mktsegment")).alias("collection"),
        (F.length("c_mktsegment") * 64 + F.when(key % 7 == 0, 1).otherwise(0)).alias("dimension"),
        F.concat(F.lit("m"), (key % 3).cast("string")).alias("model"),
    )
    checked = kb.append_check(incoming, _catalog_with_models(spark, sf_dir))
    return checked.select("c_custkey", "collection", "status")


@query(
    "kb_model_resolution",
    f"""
WITH {_MODELS_SQL}
SELECT collection, embedding_model, CASE embedding_model WHEN 'm0' THEN 'm0' WHEN 'm1' THEN 'm0' END AS resolved_model FROM c
""",
)
def kb_model_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only m0 is installed, m1 has a replacement, m2 has none."""
    catalog = _catalog_with_models(spark, sf_dir)
    names = catalog.select(F.col("embedding_model").alias("model")).distinct()
    installed = names.where(F.col("model") == "m0")
    swaps = names.where(F.col("model") == "m1").withColumn("replacement", F.lit("m0"))
    resolved = kb.resolve_models(catalog, installed, swaps)
    return resolved.select("collection", "embedding_model", "resolved_model")


@query(
    "metadata_completion",
    """
WITH m AS (SELECT event_id, props, event_type, (event_id % 4)::INT AS k FROM events)
SELECT event_id, CASE k
  WHEN 0 THEN props[1:length(props) - 1] || ',"source":"' || event_type || '","created_at":5}'
  WHEN 1 THEN '{"source":"given","created_at":5}'
  WHEN 2 THEN '{"source":"' || event_type || '","created_at":5}'
  ELSE '{"created_at":1,"source":"' || event_type || '"}' END AS metadata,
  CASE k WHEN 1 THEN 'given' ELSE event_type END AS source, CASE k WHEN 1 THEN 'given' ELSE 'unknown' END AS own_source
FROM m
""",
)
def metadata_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra fields, a given source, bad JSON, a given time."""
    kind = F.col("event_id") % 4
    given = (
        F.when(kind == 0, F.col("props"))
        .when(kind == 1, '{"source":"given"}')
        .when(kind == 2, "{oops")
        .otherwise('{"created_at":1}')
    )
    events = table(spark, sf_dir, "events").select("event_id", "event_type", given.alias("m"))
    done = kb.complete_metadata(F.col("m"), F.col("event_type"), F.lit(5))
    return events.withColumn("metadata", done).select(
        "event_id", "metadata", kb.source_of(F.col("metadata")).alias("source"), kb.source_of(F.col("m")).alias("own_source")
    )


@query(
    "metadata_documents",
    """
SELECT o_orderkey, o_orderstatus AS collection, 'm' || o_orderpriority AS embedding_model, 64 AS embedding_dimension,
  o_custkey AS chunk_count, TIMESTAMP '2024-01-02 03:04:05' + to_milliseconds(o_orderkey % 1000) AS created_at, 2 AS sources
FROM orders
""",
)
def metadata_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored metadata documents with the model under either name and milliseconds in a six-digit field."""
    orders = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, "embedding_model").otherwise("embeddingModel")
    stamp = F.format_string("2024-01-02 03:04:05.%06d", F.col("o_orderkey") % 1000)
    document = F.format_string(
        '{"%s":"m%s","embedding_dimension":64,"chunk_count":%d,"collection":"%s","created_at":"%s","sources":["a","b"]}',
        name, F.col("o_orderpriority"), F.col("o_custkey"), F.col("o_orderstatus"), stamp,
    )
    parsed = orders.select("o_orderkey", kb.parse_metadata_document(document).alias("d"))
    return parsed.select(
        "o_orderkey",
        "d.collection",
        "d.embedding_model",
        "d.embedding_dimension",
        "d.chunk_count",
        "d.created_at",
        F.size("d.sources").alias("sources"),
    )


@query(
    "catalog_documents",
    f"""
WITH c AS ({_CATALOG_SQL})
SELECT collection, '{{"collection":"' || collection || '","chunk_count":' || chunk_count || ',"source_count":' || source_count
  || ',"embedding_dimension":2,"created_at":"' || strftime(created_at, '%Y-%m-%d %H:%M:%S.%f')
  || '","last_modified_timestamp":' || epoch_ms(last_modified) || '}}' AS document
FROM c
""",
)
def catalog_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kb.metadata_document(kb.catalog(kb.storable(_rows(spark, sf_dir))))


# --- stored tables -----------------------------------------------------------------


@query(
    "kb_lifecycle",
    f"""
WITH {_ROWS_SQL},
k AS (
  SELECT CASE collection WHEN 'de' THEN 'german' ELSE collection END AS collection, id, source,
    CASE collection WHEN 'fr' THEN 1 ELSE 2 END AS copies FROM rows WHERE collection <> 'es')
SELECT collection, sum(copies)::BIGINT AS chunk_count, count(DISTINCT source) AS source_count,
  sum(id * copies)::BIGINT AS id_sum FROM k GROUP BY collection
""",
)
def kb_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create, append (twice the same batch), overwrite one collection, rename one, drop one."""
    path = scratch_path(spark, "lifecycle")
    rows = _rows(spark, sf_dir)
    kb.overwrite(rows, path)
    kb.append(rows, path, "second")
    kb.append(rows, path, "second")
    kb.overwrite(rows.where(F.col("collection") == "fr"), path)
    kb.rename(spark, path, "de", "german")
    kb.drop(spark, path, "es")
    return kb.read(spark, path).groupBy("collection").agg(
        F.count("*").alias("chunk_count"), F.countDistinct("source").alias("source_count"), F.sum("id").alias("id_sum")
    )


@query("staged_chunks", "SELECT doc_id::INTEGER AS chunkIndex, text, source, '{}' AS metadata FROM documents")
def staged_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written to a staging table and read back."""
    path = scratch_path(spark, "staged")
    docs = table(spark, sf_dir, "documents")
    staging.save(
        docs.select("text", "source", F.col("doc_id").cast("int").alias("chunkIndex"), F.lit("{}").alias("metadata")), path
    )
    return staging.load(spark, path)


@query(
    "note_search",
    f"""
WITH {_ROWS_SQL}
SELECT id, source FROM rows
WHERE (contains(lower(content), 'the ') OR contains(lower(source), 'the ')) AND created_at >= TIMESTAMP '2024-01-01 00:01:00'
  AND created_at < TIMESTAMP '2024-01-01 00:10:00'
""",
)
def note_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kb.storable(_rows(spark, sf_dir))
    return search_notes(rows, "The ", "2024-01-01 00:01:00", "2024-01-01 00:10:00").select("id", "source")
