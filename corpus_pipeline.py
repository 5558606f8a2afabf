"""From raw documents to token ids: filter, deduplicate, decontaminate, replace personal data, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's docs. All
but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.llm import decontam, jaccard, pii, quality, sentencepiece
from kbweave.llm.common import spread, written
from kbweave.llm.queries import PII_KEY, model_path
from kbweave.plans.registry import table
from kbweave.session import ship_package


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    ship_package(spark)
    docs = spread(docs)
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more."""
    ship_package(spark)
    return jaccard.one_of_each(spread(docs), 5, 80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    ship_package(spark)
    return decontam.clean(spread(docs), table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and the length of the new text."""
    ship_package(spark)
    out = pii.anonymize(spread(docs), PII_KEY, found="_entities")
    if "n_chars" in docs.columns:
        changed = F.size("_entities") > 0
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether they decode to the text."""
    ship_package(spark)
    rows = sentencepiece.tokenize(spread(docs.select("doc_id", "text")), model_path())
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


STAGES = [
    ("quality", quality_filter),
    ("jaccard", deduplicate),
    ("decontamination", decontaminate),
    ("surrogates", replace_personal_data),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents``; what each stage before it returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
