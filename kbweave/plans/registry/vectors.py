"""Vector statistics, quality, search and rerank scores over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.functions import vector_kernels as K
from kbweave.functions import vectors as V
from kbweave.operators.quality import pool_by_model, quality_report, quality_summary
from kbweave.operators.rerank import fallback_scores, with_relevance
from kbweave.operators.search import mismatched_rows, search_topk
from kbweave.plans.registry import query, table


def _entries(df: DataFrame, keys: list[str], vector: str, digits: int = 5) -> DataFrame:
    """One row per vector entry, rounded."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "_v")).select(
        *keys, "pos", F.round(F.col("_v").cast("double"), digits).alias("value")
    )


def _centroids(embeddings: DataFrame) -> DataFrame:
    """One question vector per label: the rounded mean of its vectors, in float."""
    entries = embeddings.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = entries.groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("label").agg(
        F.transform(ordered, lambda s: s["m"].cast("float")).alias("embedding")
    ).withColumnRenamed("label", "query_id")


CENTROIDS_SQL = """
entries AS (
  SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
means AS (SELECT label, pos, round(avg(v), 6)::FLOAT AS m FROM entries GROUP BY label, pos),
centroids AS (SELECT label AS query_id, list(m ORDER BY pos)::DOUBLE[] AS q FROM means GROUP BY label),
scored AS (
  SELECT query_id, vec_id AS id, label,
         round(greatest(-1, least(1, list_cosine_similarity(q, embedding::DOUBLE[]))), 6) AS similarity
  FROM centroids, embeddings {where}),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INTEGER AS rank,
         id, label, similarity FROM scored)
"""
_TOPK_SQL = f"""
WITH {CENTROIDS_SQL.format(where="")}
SELECT query_id, rank, id, similarity FROM ranked WHERE rank <= 20
"""


def centroid_search(spark: SparkSession, sf_dir: str, k: int = 20, **options) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    kb = embeddings.withColumnRenamed("vec_id", "id")
    return search_topk(_centroids(embeddings), kb, k, **options)


@query("vector_topk", _TOPK_SQL)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_search(spark, sf_dir)


@query("vector_topk_grid", _TOPK_SQL)
def vector_topk_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path for question sets that are too large to broadcast."""
    return centroid_search(spark, sf_dir, max_broadcast_questions=3)


@query(
    "vector_topk_in_collection",
    f"""
WITH {CENTROIDS_SQL.format(where="WHERE query_id = label")}
SELECT query_id, rank, id, similarity FROM ranked WHERE rank <= 20
""",
)
def vector_topk_in_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question searches its own knowledge base only."""
    embeddings = table(spark, sf_dir, "embeddings")
    kb = embeddings.select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("collection"))
    questions = _centroids(embeddings).withColumn("collection", F.col("query_id").cast("string"))
    return search_topk(questions, kb, 20, collection="collection").drop("collection")


@query(
    "topk_label_vote",
    f"""
WITH {CENTROIDS_SQL.format(where="")},
votes AS (SELECT query_id, label, count(*) AS votes FROM ranked WHERE rank <= 20 GROUP BY query_id, label)
SELECT query_id, label, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS n FROM votes) WHERE n = 1
""",
)
def topk_label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    votes = centroid_search(spark, sf_dir).join(labels, "id").groupBy("query_id", "label").agg(
        F.count("*").alias("votes")
    )
    best = F.max_by(F.struct("label", "votes"), F.struct("votes", -F.col("label")))
    return votes.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.label", "b.votes")


@query(
    "search_depth_zero",
    f"""
WITH {CENTROIDS_SQL.format(where="")}
SELECT query_id, 0::BIGINT AS hits_at_zero, count(*) FILTER (rank <= 2) AS hits_at_two FROM ranked GROUP BY query_id
""",
)
def search_depth_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A depth of 0 switches retrieval off: no question has a hit, where it has two at a depth of 2."""
    asked = _centroids(table(spark, sf_dir, "embeddings")).select("query_id")
    hits = lambda k: centroid_search(spark, sf_dir, k).groupBy("query_id").agg(F.count("*").alias("n"))
    both = asked.join(hits(0).withColumnRenamed("n", "zero"), "query_id", "left").join(hits(2).withColumnRenamed("n", "two"), "query_id", "left")
    none = F.lit(0).cast("long")
    return both.select("query_id", F.coalesce("zero", none).alias("hits_at_zero"), F.coalesce("two", none).alias("hits_at_two"))


@query(
    "dimension_mismatch",
    "SELECT count(*) FILTER (WHERE len(embedding[1:64 - (vec_id % 2)::INT]) <> 64) AS mismatched_rows FROM embeddings",
)
def dimension_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a search would leave out; every other vector is one entry short."""
    short = F.slice("embedding", F.lit(1), (64 - F.col("vec_id") % 2).cast("int"))
    return mismatched_rows(table(spark, sf_dir, "embeddings").withColumn("embedding", short), 64)


@query(
    "rerank_fallback",
    f"""
WITH {CENTROIDS_SQL.format(where="")}
SELECT query_id, rank, id, similarity, rank AS rerank_rank, round(1 - 0.01 * (rank - 1), 4)::DOUBLE AS score
FROM ranked WHERE rank <= 20
""",
)
def rerank_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fallback_scores(centroid_search(spark, sf_dir))
    return hits.withColumn("score", F.round(F.col("score").cast("double"), 4))


# --- statistics ------------------------------------------------------------------

_STATS_SQL = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT *, list_sum(v) / len(v) AS mean FROM e),
s AS (SELECT *, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / len(v) AS variance FROM m)
"""


@query(
    "vector_stats",
    f"""
WITH {_STATS_SQL}
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(mean, 6) AS mean,
       round(variance, 6) AS variance,
       round(list_sum(list_transform(v, lambda x: pow((x - mean) / sqrt(variance), 3))) / len(v), 5) AS skewness
FROM s
""",
)
def vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    df = df.withColumn("_mean", V.mean(F.col("embedding")))
    df = df.withColumn("_variance", V.variance(F.col("embedding"), F.col("_mean")))
    return df.select(
        "vec_id",
        F.round(V.l2_norm(F.col("embedding")), 6).alias("norm"),
        F.round("_mean", 6).alias("mean"),
        F.round("_variance", 6).alias("variance"),
        F.round(V.skewness(F.col("embedding"), F.col("_mean"), F.col("_variance")), 5).alias("skewness"),
    )


@query(
    "cosine_to_centroid",
    f"""
WITH {CENTROIDS_SQL.format(where="WHERE query_id = label")}
SELECT id AS vec_id, similarity FROM scored
""",
)
def cosine_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise similarity as a column function, joined on the label."""
    embeddings = table(spark, sf_dir, "embeddings")
    centroids = _centroids(embeddings).select(F.col("query_id").alias("label"), F.col("embedding").alias("_q"))
    joined = embeddings.join(centroids, "label")
    return joined.select(
        "vec_id", F.round(V.cosine_similarity(F.col("embedding"), F.col("_q")), 6).alias("similarity")
    )


@query(
    "mean_ignoring_nan",
    """
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 0.0 ELSE
  round(list_sum(list_transform(embedding[2:], lambda x: x::DOUBLE)) / 63, 6) END AS mean
FROM embeddings
""",
)
def mean_ignoring_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry is NaN in every vector, all entries in every seventh."""
    nan = F.lit(float("nan")).cast("float")
    spoiled = F.transform(
        "embedding", lambda x, i: F.when((i == 0) | (F.col("vec_id") % 7 == 0), nan).otherwise(x)
    )
    df = table(spark, sf_dir, "embeddings").select("vec_id", spoiled.alias("v"))
    return df.select("vec_id", F.round(V.mean_ignore_nan(F.col("v")), 6).alias("mean"))


# --- quality ---------------------------------------------------------------------


def spoiled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of the table, damaged in a way its number decides; a tenth stay as they are."""
    v, kind = F.col("embedding"), F.col("vec_id") % 10
    as_float = lambda x: F.lit(x).cast("float")
    first = lambda n, value: F.transform(v, lambda x, i: F.when(i < n, value).otherwise(x))
    damaged = (
        F.when(kind == 1, first(3, as_float(float("nan"))))
        .when(kind == 2, first(2, as_float(float("inf"))))
        .when(kind == 3, first(8, as_float(5000.0)))
        .when(kind == 4, F.transform(v, lambda x: as_float(0.0)))
        .when(kind == 5, F.transform(v, lambda x: as_float(0.5)))
        .when(kind == 6, F.transform(v, lambda x: (x * 300).cast("float")))
        .when(kind == 7, first(1, as_float(20.0)))
        .when(kind == 8, first(24, as_float(0.25)))
        .when(kind == 9, F.slice(v, 1, 60))
        .otherwise(v)
    )
    return table(spark, sf_dir, "embeddings").select("vec_id", damaged.alias("v"))


SPOILED_SQL = """
e AS (SELECT vec_id, (vec_id % 10)::INT AS kind, embedding AS v FROM embeddings),
spoiled AS (
  SELECT vec_id, CASE kind
    WHEN 1 THEN list_transform(v, lambda x, i: CASE WHEN i <= 3 THEN 'nan'::FLOAT ELSE x END)
    WHEN 2 THEN list_transform(v, lambda x, i: CASE WHEN i <= 2 THEN 'inf'::FLOAT ELSE x END)
    WHEN 3 THEN list_transform(v, lambda x, i: CASE WHEN i <= 8 THEN 5000::FLOAT ELSE x END)
    WHEN 4 THEN list_transform(v, lambda x: 0::FLOAT)
    WHEN 5 THEN list_transform(v, lambda x: 0.5::FLOAT)
    WHEN 6 THEN list_transform(v, lambda x: (x * 300::FLOAT)::FLOAT)
    WHEN 7 THEN list_transform(v, lambda x, i: CASE WHEN i <= 1 THEN 20::FLOAT ELSE x END)
    WHEN 8 THEN list_transform(v, lambda x, i: CASE WHEN i <= 24 THEN 0.25::FLOAT ELSE x END)
    WHEN 9 THEN v[1:60]
    ELSE v END::DOUBLE[] AS v
  FROM e),
shares AS (
  SELECT vec_id, v, len(v) AS n,
    len(list_filter(v, lambda x: isnan(x))) AS nans,
    len(list_filter(v, lambda x: isinf(x))) AS infs,
    len(list_filter(v, lambda x: isfinite(x) AND abs(x) > 1000)) AS extremes
  FROM spoiled),
plain AS (SELECT *, CASE WHEN nans + infs = 0 THEN list_sum(v) / n END AS mean FROM shares),
spread AS (
  SELECT *, list_sum(list_transform(v, lambda x: (x - mean) * (x - mean))) / n AS variance,
    sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM plain),
skewed AS (
  SELECT *, CASE WHEN variance < 1e-8 THEN 0
    ELSE list_sum(list_transform(v, lambda x: pow((x - mean) / sqrt(variance), 3))) / n END AS skew FROM spread),
sorted_values AS (
  SELECT vec_id, x, lag(x) OVER (PARTITION BY vec_id ORDER BY x) AS before,
    row_number() OVER (PARTITION BY vec_id ORDER BY x) AS place
  FROM (SELECT vec_id, unnest(v) AS x FROM spoiled)),
runs AS (
  SELECT vec_id, sum(CASE WHEN abs(x - before) < 1e-6 THEN 0 ELSE 1 END)
    OVER (PARTITION BY vec_id ORDER BY place) AS run FROM sorted_values),
clusters AS (
  SELECT vec_id, max(c) AS longest FROM (SELECT vec_id, run, count(*) AS c FROM runs GROUP BY vec_id, run)
  GROUP BY vec_id),
judged AS (
  SELECT vec_id, v, n, mean, variance, CASE
    WHEN n < {expected} THEN 'DIMENSION_MISSING'
    WHEN nans > 0 THEN 'NAN_VALUES'
    WHEN infs > 0 THEN 'INFINITE_VALUES'
    WHEN extremes > 0.1 * n THEN 'EXTREME_VALUES'
    WHEN norm < 1e-6 THEN 'ZERO_VECTOR'
    WHEN variance < 1e-6 THEN 'LOW_VARIANCE'
    WHEN variance > 1e3 THEN 'HIGH_VARIANCE'
    WHEN abs(skew) > 3 THEN 'HIGH_SKEWNESS'
    WHEN longest > 0.3 * n THEN 'ABNORMAL_CLUSTERING'
    ELSE 'NONE' END AS type, nans, infs, extremes, longest
  FROM skewed JOIN clusters USING (vec_id))
"""


@query(
    "vector_quality",
    f"""
WITH {SPOILED_SQL.format(expected=64)}
SELECT vec_id, n::INTEGER AS dimension, type, type <> 'NONE' AS is_anomalous, round(CASE type
    WHEN 'DIMENSION_MISSING' THEN 0.9 WHEN 'NAN_VALUES' THEN nans / n WHEN 'INFINITE_VALUES' THEN infs / n
    WHEN 'EXTREME_VALUES' THEN extremes / n WHEN 'ZERO_VECTOR' THEN 1.0 WHEN 'LOW_VARIANCE' THEN 0.6
    WHEN 'HIGH_VARIANCE' THEN 0.7 WHEN 'HIGH_SKEWNESS' THEN 0.5 WHEN 'ABNORMAL_CLUSTERING' THEN longest / n
    ELSE 0 END, 6)::DOUBLE AS severity
FROM judged
""",
)
def vector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = spoiled_vectors(spark, sf_dir).withColumn("a", K.detect_anomaly(F.col("v"), 64))
    return judged.select(
        "vec_id",
        F.size("v").alias("dimension"),
        "a.type",
        "a.is_anomalous",
        F.round("a.severity", 6).alias("severity"),
    )


@query(
    "vector_quality_report",
    f"""
WITH {_STATS_SQL}
SELECT vec_id, 64 AS dimension, round(mean, 6) AS mean, round(variance, 6) AS variance,
  round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, 'normal' AS status, 'NONE' AS type,
  0.0::DOUBLE AS severity
FROM s
""",
)
def vector_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), expected_dim=64)
    for name in ("mean", "variance", "norm"):
        report = report.withColumn(name, F.round(name, 6))
    return report.drop("embedding")


@query(
    "vector_quality_summary",
    f"""
WITH {SPOILED_SQL.format(expected=0)}
SELECT type, count(*) AS vectors FROM judged GROUP BY type
""",
)
def vector_quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_summary(quality_report(spoiled_vectors(spark, sf_dir), "v")).drop("mean_severity")


@query(
    "vector_repair_exact",
    f"""
WITH {SPOILED_SQL.format(expected=0)},
fixed AS (
  SELECT vec_id, CASE type
    WHEN 'NAN_VALUES' THEN list_transform(v, lambda x: CASE WHEN isnan(x) THEN
      list_sum(list_filter(v, lambda y: NOT isnan(y))) / len(list_filter(v, lambda y: NOT isnan(y))) ELSE x END)
    WHEN 'INFINITE_VALUES' THEN list_transform(v, lambda x: CASE
      WHEN x = 'inf'::DOUBLE THEN list_max(list_filter(v, lambda y: isfinite(y))) ELSE x END)
    WHEN 'EXTREME_VALUES' THEN list_transform(v, lambda x:
      least(greatest(x, mean - 3 * sqrt(variance)), mean + 3 * sqrt(variance)))
    WHEN 'HIGH_VARIANCE' THEN list_transform(v, lambda x: mean + 0.5 * (x - mean))
    ELSE v END AS v
  FROM judged
  WHERE type IN ('NONE', 'NAN_VALUES', 'INFINITE_VALUES', 'EXTREME_VALUES', 'HIGH_VARIANCE', 'HIGH_SKEWNESS'))
SELECT vec_id, generate_subscripts(v, 1)::INTEGER - 1 AS pos, round(unnest(v)::FLOAT::DOUBLE, 2) AS value FROM fixed
""",
)
def vector_repair_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs without noise."""
    judged = spoiled_vectors(spark, sf_dir).withColumn("type", K.detect_anomaly(F.col("v"))["type"])
    noisy = ("ZERO_VECTOR", "LOW_VARIANCE", "ABNORMAL_CLUSTERING")
    fixed = judged.where(~F.col("type").isin(*noisy)).withColumn(
        "v", K.repair_vector(F.col("v"), F.col("type"), F.col("vec_id"))
    )
    return _entries(fixed, ["vec_id"], "v", 2)


@query(
    "vector_repair_seeded",
    """
SELECT vec_id, 64 AS dimension, CASE (vec_id % 10)::INT WHEN 3 THEN 'EXTREME_VALUES' WHEN 7 THEN 'HIGH_SKEWNESS' ELSE 'NONE' END
  AS type, true AS finite, true AS beginning_kept FROM embeddings
""",
)
def vector_repair_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repairs. The noise depends on the row's number, so what it leaves is stated by type and shape.

    A short vector is padded behind its own entries; clamping and skewness leave their anomaly.
    """
    fixed = spoiled_vectors(spark, sf_dir).select(
        "vec_id", "v", K.process_vector(F.col("v"), F.col("vec_id"), 64).alias("fixed")
    )
    kept = F.when(F.col("vec_id") % 10 == 9, F.slice("fixed", 1, 60) == F.col("v")).otherwise(F.lit(True))
    return fixed.select(
        "vec_id",
        F.size("fixed").alias("dimension"),
        K.detect_anomaly(F.col("fixed"), 64)["type"].alias("type"),
        F.forall("fixed", lambda x: F.abs(x) < float("inf")).alias("finite"),
        kept.alias("beginning_kept"),
    )


@query(
    "vector_double_check",
    """
SELECT vec_id, CASE (vec_id % 10)::INT WHEN 3 THEN 'EXTREME_VALUES' WHEN 7 THEN 'HIGH_SKEWNESS' ELSE 'NONE' END AS chunk_type,
  'NONE' AS note_type FROM embeddings
""",
)
def vector_double_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rule (replace above severity 0.8) and note rule (replace at any severity)."""
    checked = spoiled_vectors(spark, sf_dir).select(
        "vec_id",
        K.double_check(F.col("v"), F.col("vec_id")).alias("chunk"),
        K.double_check(F.col("v"), F.col("vec_id"), above=0.0).alias("note"),
    )
    return checked.select(
        "vec_id",
        K.detect_anomaly(F.col("chunk"))["type"].alias("chunk_type"),
        K.detect_anomaly(F.col("note"))["type"].alias("note_type"),
    )


@query(
    "vector_normalize",
    """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x * (1 + vec_id % 5)::FLOAT)::FLOAT)::DOUBLE[] AS v
           FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)
SELECT vec_id, generate_subscripts(v, 1)::INTEGER - 1 AS pos, round(unnest(v)::FLOAT::DOUBLE, 5) AS value FROM u
""",
)
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 5).cast("float")).cast("float"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("v"))
    return _entries(df.withColumn("v", K.normalize_vector(F.col("v"), F.col("vec_id"))), ["vec_id"], "v")


@query(
    "vector_random_unit",
    "SELECT vec_id, 64 AS dimension, 1.0::DOUBLE AS norm, true AS differs FROM embeddings",
)
def vector_random_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit vector per row number, unlike the one of the next number."""
    drawn = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        K.random_unit_vector(F.col("vec_id"), 64).alias("v"),
        K.random_unit_vector(F.col("vec_id") + 1, 64).alias("next"),
    )
    return drawn.select(
        "vec_id",
        F.size("v").alias("dimension"),
        F.round(V.l2_norm(F.col("v")), 5).alias("norm"),
        (F.abs(V.cosine_similarity(F.col("v"), F.col("next"))) < 0.8).alias("differs"),
    )


@query(
    "vector_blob_codec",
    "SELECT vec_id, 256 AS bytes, generate_subscripts(embedding, 1)::INTEGER - 1 AS pos,"
    " round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings",
)
def vector_blob_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to stored bytes and back; two stray bytes at the end do not matter."""
    df = table(spark, sf_dir, "embeddings").select("vec_id", K.vector_to_blob(F.col("embedding")).alias("b"))
    back = df.select(
        "vec_id", F.length("b").alias("bytes"), K.blob_to_vector(F.concat("b", F.unhex(F.lit("0102")))).alias("v")
    )
    return _entries(back, ["vec_id", "bytes"], "v", 6)


# --- model-side arrays -------------------------------------------------------------


@query(
    "token_pooling",
    """
WITH h AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT vec_id, unnest(range(16))::INTEGER AS pos,
  round(unnest(list_transform(range(1, 17), lambda i: ((v[i] + v[i + 16] + v[i + 32]) / 3)::FLOAT::DOUBLE)), 5) AS mean,
  round(unnest(v[33:48]), 5) AS last, round(unnest(v[1:16]), 5) AS first
FROM h
""",
)
def token_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector read as four token vectors, the fourth masked out."""
    hidden = F.array(*[F.slice("embedding", 16 * i + 1, 16) for i in range(4)])
    mask = F.array(*[F.lit(x) for x in (1, 1, 1, 0)])
    df = table(spark, sf_dir, "embeddings").select("vec_id", hidden.alias("h"), mask.alias("m"))
    pooled = df.select(
        "vec_id",
        F.posexplode(
            F.arrays_zip(
                pool_by_model(F.lit("Qwen3"), F.col("h"), F.col("m")).alias("a"),
                pool_by_model(F.lit("qwen"), F.col("h"), F.col("m"), last_token=True).alias("b"),
                pool_by_model(F.lit("bge-m3"), F.col("h"), F.col("m")).alias("c"),
            )
        ).alias("pos", "p"),
    )
    rounded = lambda name: F.round(F.col(f"p.{name}").cast("double"), 5)
    return pooled.select("vec_id", "pos", rounded("a").alias("mean"), rounded("b").alias("last"), rounded("c").alias("first"))


@query(
    "rerank_scores",
    """
WITH l AS (SELECT vec_id, embedding[1]::DOUBLE AS a, (embedding[2] + 2::FLOAT)::FLOAT::DOUBLE AS b FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-b)), 6) AS score, round(1 / (1 + exp(-a)), 6) AS single_score,
  round(exp(b - b) / (exp(a - b) + 1), 6) AS softmax_second
FROM l
""",
)
def rerank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits from the first two entries: as a pair, as a single logit, as a softmax."""
    v = F.col("embedding")
    pair = F.array(F.get(v, F.lit(0)), (F.get(v, F.lit(1)) + F.lit(2.0).cast("float")).cast("float"))
    df = table(spark, sf_dir, "embeddings").select(
        "vec_id", pair.alias("pair"), F.array(F.get(v, F.lit(0))).alias("single")
    )
    df = with_relevance(df, F.col("pair"), F.col("vec_id"))
    df = with_relevance(df, F.col("single"), F.col("vec_id"), "single_score")
    return df.select(
        "vec_id",
        F.round("score", 6).alias("score"),
        F.round("single_score", 6).alias("single_score"),
        F.round(F.get(V.softmax(F.col("pair")), F.lit(1)), 6).alias("softmax_second"),
    )
