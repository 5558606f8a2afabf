"""Vector quality of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.functions import vectors as V
from kbweave.functions.vector_kernels import detect_anomaly


def quality_report(df: DataFrame, vector: str = "embedding", expected_dim: int = -1) -> DataFrame:
    """Add dimension, mean, variance, norm, status, anomaly type and severity of each vector."""
    v = F.col(vector)
    judged = df.withColumn("_anomaly", detect_anomaly(v, expected_dim)).withColumn("mean", V.mean(v))
    return judged.select(
        *df.columns,
        F.size(v).alias("dimension"),
        "mean",
        V.variance(v, F.col("mean")).alias("variance"),
        V.l2_norm(v).alias("norm"),
        F.when(F.col("_anomaly.is_anomalous"), "anomalous").otherwise("normal").alias("status"),
        F.col("_anomaly.type").alias("type"),
        F.col("_anomaly.severity").alias("severity"),
    )


def quality_summary(report: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Vectors and mean severity per anomaly type."""
    return report.groupBy(*(keys or []), "type").agg(
        F.count("*").alias("vectors"), F.avg("severity").alias("mean_severity")
    )


def pool_by_model(model: Column, hidden: Column, mask: Column, last_token: bool = False) -> Column:
    """Qwen models pool over the valid tokens (or take the last one), all others take the first."""
    qwen = V.pool_last(hidden, mask) if last_token else V.pool_mean(hidden, mask)
    return F.when(F.contains(F.lower(model), F.lit("qwen")), qwen).otherwise(V.pool_first(hidden))
