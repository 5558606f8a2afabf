"""Streams give the batch result, survive a restart, and do not gather a hot key."""

import json
import time

from pyspark.sql import functions as F

from kbweave.operators import kb
from kbweave.operators.chat import chat_text_parts, chatml_parts
from kbweave.operators.ordered_text import assemble, assemble_utf8
from kbweave.plans.build import build_from_files
from kbweave.sources.streams import DONE_LINE, join_entries
from kbweave.streaming import logs
from kbweave.streaming.answers import stream_answers
from kbweave.streaming.ingest import stream_into_kb, usable_files, watch_files


def line(text):
    return "data: " + json.dumps({"choices": [{"delta": {"content": text}}]})


def run(stream, tmp_path):
    writer = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_answers_over_batches_and_parts(spark, tmp_path):
    rows = [(1, s, line(f"w{s} ")) for s in range(10)] + [(1, 10, DONE_LINE)]
    rows += [(2, 0, line("x")), (2, 1, line("y"))]  # never ends
    rows += [(3, 0, line("only")), (3, 1, ""), (3, 2, DONE_LINE)]
    source = tmp_path / "in"
    for i, part in enumerate((rows[1::2], rows[0::2])):
        spark.createDataFrame(part, "response_id long, seq long, value string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("response_id long, seq long, value string").option("maxFilesPerTrigger", 1).parquet(str(source))
    got = run(stream_answers(stream, positions=4, timeout_ms=None), tmp_path)
    answers = sorted((r["response_id"], r["part"], r["answer"], r["complete"]) for r in got.collect())
    assert answers == [
        (1, 0, "w0 w1 w2 w3 ", True), (1, 1, "w4 w5 w6 w7 ", True), (1, 2, "w8 w9 ", True), (3, 0, "only", True),
    ]


def test_ingest_restarts_without_copies(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "files", str(tmp_path / "kb"), str(tmp_path / "cp")
    folder.mkdir()
    build = lambda batch: build_from_files(usable_files(batch), collection="c")
    for number in range(3):
        (folder / f"f{number}.txt").write_text(f"text of file number {number}")
        stream_into_kb(watch_files(spark, str(folder)), build, path, checkpoint, "s").awaitTermination()
    assert sorted(r["source"] for r in kb.read(spark, path).collect()) == ["f0.txt", "f1.txt", "f2.txt"]


def test_log_files_are_read_split_by_split(spark, tmp_path, monkeypatch):
    """Entries keep their lines across splits, and no row holds more than a line."""
    folder, blocks = tmp_path / "logs", []
    folder.mkdir()
    for f in range(2):
        entries = [f"2024-01-0{f + 1} 10:00:00.{i:03d} E/error: m{f}-{i}\n  at a\n  at b" for i in range(40)]
        (folder / f"{f}.log").write_text("\n".join(entries) + "\n")

    def joined(lines, *names):
        blocks.append(lines.select("file", "block").distinct().count())
        assert lines.filter(F.instr("value", "\n") > 0).isEmpty()
        return join_entries(lines, *names)

    monkeypatch.setattr(logs, "join_entries", joined)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        logs.stream_logs(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    found = sorted(r["message"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == sorted(f"m{f}-{i}\n  at a\n  at b" for f in range(2) for i in range(40))
    assert len(blocks) == 2 and min(blocks) > 1


def test_parts_hold_a_hot_key(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(50)] + [(2, 0, "user", "hello you")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for fn in (chat_text_parts, chatml_parts):
        whole = {(r["conv_id"]): r["text"] for r in fn(df).collect()}
        parts = fn(df, positions=8).orderBy("conv_id", "part").collect()
        assert len(parts) == 8
        for conv, text in whole.items():
            assert "".join(r["text"] for r in parts if r["conv_id"] == conv) == text
    quiet = chatml_parts(df, thinking=False, add_generation_prompt=True, positions=8).orderBy("part").where("conv_id = 1").collect()
    assert "m48\n\n/no_think" in quiet[-1]["text"] and quiet[-1]["text"].endswith("<|im_start|>assistant\n")


def test_short_chats_are_left_out(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "abcd")], "conv_id long, turn long, role string, text string")
    assert [r["text"] for r in chat_text_parts(df).collect()] == ["用户: abcd"]


def test_bytes_across_parts(spark):
    text = "aé中😀" * 9
    data = text.encode()
    rows = [(1, i, bytearray(data[i * 3 : i * 3 + 3])) for i in range(-(-len(data) // 3))]
    df = spark.createDataFrame(rows, "k long, seq long, b binary")
    for positions in (1, 2, 7, 100):
        parts = assemble_utf8(df, ["k"], "seq", "b", "t", positions).orderBy("part").collect()
        assert "".join(r["t"] for r in parts) == text


def test_assemble_orders_pieces(spark):
    df = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, "b")], "k long, p long, t string")
    assert assemble(df, ["k"], "p", "t", "o").first()["o"] == "abc"


def test_answers_share_a_call(spark, tmp_path):
    """Many responses in few buckets, ids that are null or texts, and lines over two batches; what is unfinished stays in the state."""
    ids = [f"r{i}" for i in range(50)] + [None]
    rows = [(i, s, line(f"{i}-{s} ")) for i in ids for s in range(5)] + [(i, 5, DONE_LINE) for i in ids if i != "r7"]
    source = tmp_path / "in"
    for part in (rows[0::2], rows[1::2]):
        spark.createDataFrame(part, "response_id string, seq long, value string").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("response_id string, seq long, value string").option("maxFilesPerTrigger", 1).parquet(str(source))
    got = run(stream_answers(stream, positions=4, timeout_ms=None, buckets=3), tmp_path)
    assert got.schema["response_id"].dataType.simpleString() == "string"
    want = [(i, 0, "".join(f"{i}-{s} " for s in range(4)), True) for i in ids] + [(i, 1, f"{i}-4 ", True) for i in ids if i != "r7"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_answers_in_one_bucket_time_out_each(spark, tmp_path):
    source = str(tmp_path / "in")
    write = lambda rows: spark.createDataFrame(rows, "response_id long, seq long, value string").coalesce(1).write.mode("append").parquet(source)
    write([(1, 0, line("a")), (2, 0, line("b")), (2, 1, DONE_LINE), (3, 0, line("c"))])
    stream = spark.readStream.schema("response_id long, seq long, value string").parquet(source)
    writer = stream_answers(stream, timeout_ms=1500, buckets=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    query = writer.start(str(tmp_path / "out"))
    time.sleep(10)
    query.stop()
    found = spark.read.schema("response_id long, part long, answer string, complete boolean").parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, "a", False), (2, 0, "b", True), (3, 0, "c", False)]
