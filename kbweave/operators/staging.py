"""Chunks staged between extraction and embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAGED_SCHEMA = "text string, source string, chunkIndex int, metadata string"


def save(chunks: DataFrame, path: str) -> None:
    chunks.select("text", "source", "chunkIndex", "metadata").write.mode("overwrite").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder))


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STAGED_SCHEMA).parquet(path)


def load_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Staged files in their JSON-array form."""
    return spark.read.schema(STAGED_SCHEMA).json(path, multiLine=True)


def delete(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(folder) and fs.delete(folder, True))
