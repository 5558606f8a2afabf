"""Answers that are revised by late and corrected lines."""

import time

import pytest
from pyspark.sql import functions as F

from kbweave.sources.streams import DONE_LINE, sse_line
from kbweave.streaming.revisions import rocksdb_state, stream_revisions

SCHEMA = "response_id long, seq long, value string"


@pytest.fixture
def run(spark, tmp_path):
    def feed(number, lines, **options):
        frame = spark.createDataFrame([(r, s, t) for r, s, t in lines], "response_id long, seq long, text string")
        frame = frame.withColumn("value", F.when(F.col("text") == "END", DONE_LINE).otherwise(sse_line(F.col("text")))).drop("text")
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stream_revisions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), **options)
        with rocksdb_state(spark):
            writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint")
            query = (writer if options.get("timeout_ms") else writer.trigger(availableNow=True)).start(f"{tmp_path}/out")
        if options.get("timeout_ms"):
            time.sleep(12)
            query.stop()
        else:
            query.awaitTermination(60)
        rows = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()
        return sorted((r["response_id"], r["part"], r["revision"], r["answer"], r["complete"]) for r in rows)

    return feed


def test_revisions(run):
    assert run(0, [(1, 0, "a "), (1, 1, "b"), (1, 2, "END"), (2, 0, "x"), (2, 2, "END")]) == [(1, 0, 1, "a b", True)]
    one = [(1, 0, 1, "a b", True), (2, 0, 1, "xy", True)]
    assert run(1, [(2, 1, "y"), (1, 0, "a ")]) == one  # a line that was missing, and one sent twice
    assert run(2, [(1, 1, "c"), (1, 0, "a ")]) == sorted([*one, (1, 0, 2, "a c", True)])
    assert run(3, [(1, 1, "c")]) == sorted([*one, (1, 0, 2, "a c", True)])


def test_timeout_tells_what_there_is(run):
    assert run(0, [(1, 0, "a"), (1, 2, "END"), (2, 0, "z")], timeout_ms=500) == [(1, 0, 1, "a", False), (2, 0, 1, "z", False)]
    rows = run(1, [(1, 1, "b")], timeout_ms=500)
    assert (1, 0, 2, "ab", True) in rows and len(rows) == 3
