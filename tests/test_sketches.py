"""Summaries merge to what one pass gives, within their bounds."""

import random

from pyspark.sql import functions as F

from kbweave.operators.answers import stats_footer
from kbweave.operators.sketches import estimates, generation_percentiles, merged, summaries


def test_merged_parts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(7), rng.gauss(0, 100) if rng.random() > 0.05 else None, f"s{rng.randrange(500)}") for _ in range(6000)]
    df = spark.createDataFrame(rows, "key string, part int, x double, source string")
    parts = summaries(df, ["key", "part"], {"x": F.col("x")}, {"sources": F.col("source")})
    found = {r["key"]: r for r in estimates(merged(parts, ["key"]), ["key"], (0.1, 0.5, 0.99)).collect()}
    for key in "ab":
        values = sorted(x for k, _, x, _ in rows if k == key and x is not None)
        row = found[key]
        assert row["rows"] == sum(k == key for k, _, _, _ in rows) and row["x_min"] == values[0] and row["x_max"] == values[-1]
        for rank in (0.1, 0.5, 0.99):
            share = sum(v <= row[f"x_p{round(rank * 100)}"] for v in values) / len(values)
            assert abs(share - rank) < 0.02
        assert abs(row["sources_count"] - len({s for k, _, _, s in rows if k == key})) <= 25


def test_groups_without_numbers(spark):
    df = spark.createDataFrame([("a", None, None), ("b", 1.0, "s")], "key string, x double, source string")
    found = {r["key"]: r for r in estimates(summaries(df, ["key"], {"x": F.col("x")}, {"sources": F.col("source")}), ["key"]).collect()}
    assert found["a"]["x_p50"] is None and found["a"]["rows"] == 1 and found["a"]["sources_count"] == 0 and found["b"]["x_p99"] == 1.0
    assert estimates(summaries(df.limit(0), ["key"], {"x": F.col("x")}), ["key"]).count() == 0


def test_generation_percentiles(spark):
    rows = spark.range(1, 101).select(F.lit("m").alias("model"), F.concat(F.lit("text"), stats_footer(F.col("id"), F.lit(1000))).alias("answer"))
    row = generation_percentiles(rows.unionByName(rows.limit(3).withColumn("answer", F.lit("no footer"))), ["model"]).first()
    assert row["rows"] == 103 and row["tokens_min"] == 1 and row["tokens_max"] == 100 and abs(row["rate_p50"] - 50) <= 2
