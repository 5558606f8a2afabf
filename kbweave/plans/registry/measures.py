"""What builds and stored tables tell about themselves: totals of the write, summaries, opening checks, switches, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kbweave.functions.text import estimate_tokens
from kbweave.functions.vectors import l2_norm
from kbweave.operators import kb
from kbweave.operators.answers import stats_footer
from kbweave.operators.datasets import explode_datasets, observed_stats
from kbweave.operators.sketches import catalog_estimates, estimates, merged, summaries, write_summaries
from kbweave.plans.build import build_from_files, build_from_texts
from kbweave.plans.registry import ORACLES, query, table
from kbweave.plans.registry import datasets as dataset_queries
from kbweave.plans.registry.chat import _FOOTER_SQL
from kbweave.plans.registry.kb import _ROWS_SQL, _rows
from kbweave.plans.registry.text import CHUNKS_SQL
from kbweave.session import scratch_path

# --- totals of the write ----------------------------------------------------------------


@query(
    "observed_build",
    f"""
WITH {CHUNKS_SQL}, p AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id)
SELECT count(*) AS files, sum(n)::BIGINT AS chunks, min(n)::BIGINT AS min_chunks_per_file, max(n)::BIGINT AS max_chunks_per_file FROM p
""",
)
def observed_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files into a knowledge base; files and chunks are counted by the write itself."""
    totals = Observation("build")
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".text"))
    files = table(spark, sf_dir, "documents").select(name.alias("file_name"), F.concat(F.lit("/files/"), name).alias("path"), "text")
    kb.overwrite(build_from_files(files, collection="files", created_at=F.timestamp_seconds(F.lit(1704067200)), split_datasets=False, totals=totals), scratch_path(spark, "observed-kb"))
    found = totals.get
    columns = ["files", "chunks", "min_chunks_per_file", "max_chunks_per_file"]
    return spark.createDataFrame([tuple(found[c] for c in columns)], ", ".join(f"{c} long" for c in columns))


@query("observed_datasets", ORACLES["dataset_stats"])
def observed_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read, added and skipped by format, counted while the texts are written."""
    stats = Observation("datasets")
    texts = dataset_queries.dataset_texts(dataset_queries._pairs(spark, sf_dir)).select("text")
    explode_datasets(texts, stats=stats).write.parquet(scratch_path(spark, "observed-datasets"))
    return observed_stats(spark, stats)


# --- summaries ----------------------------------------------------------------------------


def _ranks_hold(values: DataFrame, found: DataFrame, keys: list[str], name: str, ranks: tuple[float, ...], slack: float) -> DataFrame:
    """``keys, within``: whether every estimated percentile lies within ``slack`` of its rank among the values."""
    columns = [f"{name}_p{round(r * 100)}" for r in ranks]
    joined = values.join(found.select(*keys, *columns), keys)
    below = [F.avg((F.col("value") < F.col(c)).cast("double")).alias(f"_lt{i}") for i, c in enumerate(columns)]
    upto = [F.avg((F.col("value") <= F.col(c)).cast("double")).alias(f"_le{i}") for i, c in enumerate(columns)]
    held = F.lit(True)
    for i, rank in enumerate(ranks):
        held = held & (F.col(f"_lt{i}") <= rank + slack) & (F.col(f"_le{i}") >= rank - slack)
    return joined.groupBy(*keys).agg(*below, *upto).select(*keys, held.alias("within"))


@query(
    "rate_percentiles",
    f"""
WITH {_FOOTER_SQL}
SELECT role, count(*) AS answers, true AS within, min(printf('%.2f', tokens * 1000.0::DOUBLE / millis)::DOUBLE) AS rate_min,
  max(printf('%.2f', tokens * 1000.0::DOUBLE / millis)::DOUBLE) AS rate_max FROM f GROUP BY role
""",
)
def rate_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the rate by role, from summaries of 16 groups of conversations that are merged; each within two percent of its rank."""
    from kbweave.operators.answers import parse_footer

    tokens, millis = estimate_tokens(F.col("text")), F.col("turn") * 250 + 500
    answers = table(spark, sf_dir, "conversations").select(
        "role", (F.col("conv_id") % 16).alias("part"), parse_footer(F.concat(F.col("text"), stats_footer(tokens, millis))).alias("f")
    )
    ranks = (0.25, 0.5, 0.9, 0.99)
    found = estimates(merged(summaries(answers, ["role", "part"], {"rate": F.col("f.rate")}), ["role"]), ["role"], ranks)
    within = _ranks_hold(answers.select("role", F.col("f.rate").alias("value")), found, ["role"], "rate", ranks, 0.02)
    return found.join(within, "role").select("role", F.col("rows").alias("answers"), "within", "rate_min", "rate_max")


@query(
    "kb_summaries",
    f"""
WITH {_ROWS_SQL}
SELECT collection, 2 * count(*) AS chunk_count, true AS sources_close, min(length(content))::DOUBLE AS chars_min, max(length(content))::DOUBLE AS chars_max, true AS within
FROM rows GROUP BY collection
""",
)
def kb_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of two batches from their stored summaries alone; sources within five percent, percentiles within two of their rank."""
    path = scratch_path(spark, "summed-kb")
    rows = _rows(spark, sf_dir)
    kb.overwrite(rows, path)
    write_summaries(spark, path)
    kb.overwrite(rows, path)
    kb.append(rows, path, "second")
    write_summaries(spark, path)
    ranks = (0.1, 0.5, 0.9)
    found = catalog_estimates(spark, path, ranks)
    stored = kb.read(spark, path)
    exact = stored.groupBy("collection").agg(F.countDistinct("source").alias("sources"))
    within = _ranks_hold(stored.select("collection", F.char_length("content").cast("double").alias("value")), found, ["collection"], "chars", ranks, 0.02)
    close = F.abs(F.col("sources_count") - F.col("sources")) <= F.greatest(F.lit(1), 0.05 * F.col("sources"))
    return found.join(exact, "collection").join(within, "collection").select(
        "collection", F.col("rows").alias("chunk_count"), close.alias("sources_close"), "chars_min", "chars_max", "within"
    )


# --- stored tables ------------------------------------------------------------------------


@query(
    "kb_opening_checks",
    f"""
WITH {_ROWS_SQL}
SELECT collection, 'ok' AS status, count(*) AS rows, 0::BIGINT AS unusable FROM rows GROUP BY collection
UNION ALL SELECT DISTINCT source, 'missing', 0, 0 FROM documents
""",
)
def kb_opening_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table is asked for its collections, and for names it does not have."""
    path = scratch_path(spark, "checked-kb")
    rows = _rows(spark, sf_dir)
    kb.overwrite(rows, path)
    wanted = kb.storable(rows).select("collection").unionByName(table(spark, sf_dir, "documents").select(F.col("source").alias("collection"))).distinct()
    return kb.opening_checks(wanted, path)


@query(
    "kb_switch",
    f"""
WITH {_ROWS_SQL}
SELECT collection, count(*) AS before, count(*) FILTER (id % 2 = 0) AS after, count(*) AS still FROM rows GROUP BY collection
""",
)
def kb_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every collection is overwritten by half of its rows: a reader from before ends on the old rows, a new one sees the new rows alone."""
    path = scratch_path(spark, "switched-kb")
    rows = kb.storable(_rows(spark, sf_dir))
    kb.overwrite(rows, path)
    old = kb.read(spark, path)
    counted = lambda df, name: df.groupBy("collection").agg(F.count("*").alias(name))
    keep = lambda df, label: _kept(counted(df, label), label)
    before = keep(old, "before")
    kb.overwrite(rows.where(F.col("id") % 2 == 0), path)
    after, still = keep(kb.read(spark, path), "after"), keep(old, "still")
    none = F.lit(0).cast("long")
    both = before.join(after, "collection", "left").join(still, "collection", "left")
    return both.select("collection", "before", F.coalesce("after", none).alias("after"), F.coalesce("still", none).alias("still"))


def _kept(rows: DataFrame, label: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query(
    "kb_models",
    f"""
WITH {CHUNKS_SQL}
SELECT lang AS collection, m AS embedding_model, count(*) AS rows, m = 'large-model' AS unit_length
FROM chunks, (SELECT unnest(['large-model', 'bge-small']) AS m) GROUP BY lang, m
""",
)
def kb_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models in one table, neither asked to normalise: one follows the setting, the other is always normalised."""
    path = scratch_path(spark, "models-kb")
    documents = table(spark, sf_dir, "documents")
    created = F.timestamp_seconds(F.lit(1704067200))
    for model in ("large-model", "bge-small"):
        kb.append(build_from_texts(documents, collection=F.col("lang"), created_at=created, model=model, normalize=False), path, model)
    stored = kb.read(spark, path)
    norms = stored.groupBy("collection", F.col("model").alias("embedding_model")).agg(F.avg(F.abs(l2_norm(F.col("embedding")) - 1)).alias("off"))
    return kb.models_of(stored).join(norms, ["collection", "embedding_model"]).select("collection", "embedding_model", "rows", (F.col("off") < 1e-3).alias("unit_length"))
