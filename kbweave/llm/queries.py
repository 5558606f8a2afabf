"""The queries of this subpackage, each applying one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.llm import ann, collocations, decontam, html_extract, jaccard, line_dedup, pii, quality, resampling, sentencepiece, sharding, toxicity, warc
from kbweave.llm.common import fold, spread
from kbweave.plans.registry import Query, table
from kbweave.session import scratch_path

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PII_KEY = "kbweave"  # a secret in production


def query(name: str, sql: str | None = None):
    """Register a query of this subpackage and, where SQL can state it, its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    scorer = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, scorer).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "segments"
    )


@query("op2_main_text")
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_extract.extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


@query(
    "op3_jaccard",
    """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, min(r.other) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach r USING (doc_id) GROUP BY ALL
""",
)
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), 4, 85)


@query("op4_surrogates")
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.anonymize(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), PII_KEY)


@query(
    "op5_decontamination",
    """
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g
  FROM iw WHERE len(w) >= 5),
m AS (SELECT count(DISTINCT item_id) AS m FROM ig),
weights AS (SELECT g, round(16 * (1 + ln(m / count(*)))) AS w FROM ig, m GROUP BY g, m),
items AS (SELECT item_id, n, sum(w) AS item_w FROM ig JOIN weights USING (g) GROUP BY ALL),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
dg AS (SELECT doc_id, len(w) AS size, unnest(range(0, len(w) - 4)) AS pos,
    unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM dw WHERE len(w) >= 5),
rich AS (SELECT doc_id, item_id, size, n, item_w FROM (SELECT DISTINCT doc_id, size, g FROM dg) JOIN ig USING (g) JOIN weights USING (g) JOIN items USING (item_id, n)
  GROUP BY ALL HAVING sum(w) >= 0.8 * item_w),
starts AS (SELECT *, unnest(range(0, greatest(size - n, 0) + 1)) AS start FROM rich),
inside AS (SELECT DISTINCT s.doc_id, s.item_id, s.n, s.item_w, s.start, d.g FROM starts s JOIN dg d ON d.doc_id = s.doc_id AND d.pos BETWEEN s.start AND s.start + s.n - 5),
scored AS (
  SELECT x.doc_id, x.item_id, x.n, x.start, x.item_w, sum(coalesce(w.w, round(16 * (1 + ln(m))))) AS window_w,
    coalesce(sum(w.w) FILTER (i.g IS NOT NULL), 0) AS shared
  FROM inside x CROSS JOIN m LEFT JOIN weights w ON w.g = x.g LEFT JOIN ig i ON i.g = x.g AND i.item_id = x.item_id GROUP BY ALL)
SELECT doc_id, item_id, start::INTEGER AS start, n::INTEGER AS n_words, similarity FROM (
  SELECT *, shared / (window_w + item_w - shared) AS similarity,
    row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / (window_w + item_w - shared) DESC, start) AS best FROM scored)
WHERE best = 1 AND similarity >= 0.8
""",
)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(
        spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark")
    ).drop("row_key")


@query("op6_multi_index")
def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    field = quality.fit(documents, table(spark, sf_dir, "labels"))
    return quality.score(documents, field).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query(
    "op8_warc",
    """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS data FROM pages),
d AS (SELECT page_id, octet_length(data)::BIGINT AS payload_bytes, sha1(data) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to FROM k
""",
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(warc.page_records(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))), path)
    records = warc.read(spark, path)
    response = F.col("record_type") == "response"
    return records.select(
        F.regexp_extract("record_id", "^urn:page:(.*)$", 1).cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to", "^urn:page:(.*)$", 1).cast("long").alias("refers_to"),
    )


@query("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = sharding.write_shards(documents, scratch_path(spark, "shards"))
    return rows.select(
        "doc_id", "shard", "depth", "shard_bytes", "shard_rows", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )


@query("op10_sentencepiece")
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sentencepiece.tokenize(documents, model_path()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query(
    "op11_collocations",
    """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
runs AS (SELECT lang, unnest(list_transform(range(1, least(5, len(w) - i + 1) + 1), lambda m: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM starts),
f AS (SELECT lang, phrase, string_split(phrase, ' ') AS p, count(*)::HUGEINT AS f FROM runs GROUP BY lang, phrase HAVING count(*) >= 100),
cuts AS (SELECT lang, phrase, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
scored AS (
  SELECT c.lang, c.phrase, c.p, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000 * c.a * t.n) // (x.f * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.p[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.p[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, f, array_to_string(p[s:s + m - 1], ' ') AS phrase FROM (
    SELECT *, unnest(range(1, len(p) - m + 2)) AS s FROM (SELECT *, unnest(range(2, len(p))) AS m FROM f WHERE len(p) > 2))),
most AS (SELECT lang, phrase, max(f) AS most FROM inner_parts GROUP BY lang, phrase),
kept AS (SELECT l.* FROM lowest l LEFT JOIN most m ON m.lang = l.lang AND m.phrase = l.phrase WHERE m.most IS NULL OR 100 * m.most < 100 * l.a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language."""
    return collocations.collocations(spread(table(spark, sf_dir, "documents").select("lang", "text")))


@query(
    "op12_line_dedup",
    """
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM split),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT keyed.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that a document of a larger id holds too, where at least five documents hold them."""
    rows = line_dedup.dedup(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query(
    "op13_resampling",
    """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda x: x::UBIGINT)),
      lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v FROM range(256) r(i))),
texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS (SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM words),
counted AS (SELECT side, id, x, count(*) AS c FROM feats GROUP BY ALL),
hexes AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM counted)),
crcs AS (
  SELECT x, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
    lambda crc, b: xor(crc // 256, t[(xor(crc % 256, b) + 1)::BIGINT])), 4294967295::UBIGINT) % 10000 AS bucket FROM hexes, crc_table),
hashed AS (SELECT side, id, bucket, sum(c)::BIGINT AS c FROM counted JOIN crcs USING (x) GROUP BY ALL),
sums AS (SELECT bucket, sum(c) FILTER (side = 'd') AS s, sum(c) FILTER (side = 'b') AS t FROM hashed GROUP BY bucket),
alls AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (coalesce(s_all, 0)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (coalesce(t_all, 0)::DOUBLE + 10000))))::BIGINT AS gain
  FROM sums, alls),
sized AS (SELECT id AS doc_id, len(w) AS n_words, CASE WHEN len(w) > 0 THEN 2 * len(w) - 1 ELSE 0 END::BIGINT AS n_features FROM words WHERE side = 'd'),
totals AS (SELECT id AS doc_id, sum(c * gain)::BIGINT AS total FROM hashed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
weighted AS (
  SELECT doc_id, n_words, n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END::BIGINT AS weight,
    ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM sized LEFT JOIN totals USING (doc_id)),
scored AS (SELECT doc_id, n_words, n_features, weight, (weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296)))::BIGINT)::BIGINT AS score FROM weighted),
ranked AS (SELECT *, n_words >= 20 AS fit, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END::BIGINT AS rank FROM ranked
""",
)
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return resampling.resample(documents, table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")
