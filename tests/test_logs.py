"""Growing logs and counts by window."""

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kbweave.operators.answers import filter_log
from kbweave.sources.log_follow import GrowingLogReader, lines_of, whole_entries
from kbweave.sources.streams import parse_log_lines
from kbweave.streaming.logs import ENTRY_SCHEMA, late_entries, log_counts, stream_growing_logs, stream_log_counts

HEAD = "2024-01-01 00:00:{:02d}.000 I/tag: "


def entry(n, lines=2):
    return HEAD.format(n) + f"entry {n}\n" + "".join(f"  at line {n}.{i} é\n" for i in range(lines))


def reader(path, **options):
    return GrowingLogReader({"path": str(path), **{k: str(v) for k, v in options.items()}})


def test_offsets_stop_at_the_last_header(tmp_path, monkeypatch):
    log = tmp_path / "a.log"
    log.write_bytes("".join(entry(n) for n in range(5)).encode())
    size, last = log.stat().st_size, len("".join(entry(n) for n in range(4)).encode())
    one = reader(tmp_path)
    assert list(one.latestOffset().values()) == [last]
    monkeypatch.setattr("kbweave.sources.log_follow.TAIL_BYTES", 7)
    assert list(reader(tmp_path).latestOffset().values()) == [last]
    assert list(reader(tmp_path, idleSeconds=0).latestOffset().values()) == [size]
    with open(log, "ab") as out:
        out.write(entry(5).encode()[:20])
    assert list(one.latestOffset().values()) == [last]  # a header that is cut is none
    (tmp_path / "_hidden").write_text("x")
    (tmp_path / "other.txt").write_text(entry(1) + entry(2))
    assert len(reader(tmp_path, pattern=r".*\.log").latestOffset()) == 1
    assert len(reader(tmp_path / "missing").latestOffset()) == 0


@pytest.mark.parametrize("split", [1, 7, 50, 1 << 20])
def test_lines_of_ranges(tmp_path, split):
    """Every line of a range is read once, whatever the partitions."""
    log = tmp_path / "a.log"
    data = "".join(entry(n, n % 3) for n in range(9)).encode() + b"\r\n\nlast line without end"
    log.write_bytes(data)
    start = len(entry(0, 0).encode())
    parts = reader(tmp_path, splitBytes=split).partitions({str(log): start}, {str(log): len(data)})
    found = [row for part in parts for row in lines_of(part)]
    assert [line for _, line in found] == [x.removesuffix(b"\r") for x in data[start:].split(b"\n")]
    assert all(data[at : at + len(line)] == line for at, line in found)
    assert not reader(tmp_path).partitions({str(log): len(data)}, {str(log): len(data)})
    again = reader(tmp_path).partitions({str(log): len(data) + 5}, {str(log): len(data)})
    assert [p.start for p in again] == [0]  # the file was replaced by a shorter one


def test_no_header_yet(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("no header\nat all\n")
    from pyarrow import fs

    assert whole_entries(fs.LocalFileSystem(), str(log), 0, log.stat().st_size, False) == 0


def test_growing_files(spark, tmp_path):
    """Files are appended to between batches, in the middle of entries: each entry is there once and whole."""
    folder, out, checkpoint = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    folder.mkdir()
    data = {f"{name}.log": "".join(entry(n, n % 4) for n in range(40)).encode() for name in "abc"}

    def grow(share):
        for name, text in data.items():
            done = (folder / name).stat().st_size if (folder / name).exists() else 0
            with open(folder / name, "ab") as file:
                file.write(text[done : int(len(text) * share)])
        idle = 0 if share == 1 else 3600
        stream_growing_logs(spark, f"file://{folder}", out, checkpoint, idle_seconds=idle).awaitTermination()
        return spark.read.schema(f"{ENTRY_SCHEMA}, batch int").parquet(out)

    assert 0 < grow(0.3).count() < 36
    grow(0.31)
    data["late.log"] = entry(7).encode()
    rows = grow(1).collect()
    found = Counter((r["ts"].second, r["message"]) for r in rows)
    wanted = Counter((n, entry(n, n % 4).split(": ", 1)[1][:-1]) for n in range(40) for _ in "abc") + Counter([(7, entry(7).split(": ", 1)[1][:-1])])
    assert found == wanted
    assert grow(1).count() == len(rows)


def test_window_counts(spark, tmp_path):
    """Shuffled arrival within the delay counts all; what comes after its window was closed is listed."""
    folder, out, checkpoint = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"
    folder.mkdir()
    line = lambda minute, tag: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00.000 W/{tag}: m{minute}\n at x\n"
    batches = [
        [(3, "a"), (1, "a"), (12, "b")], [(9, "a"), (25, "a"), (15, "b")], [(21, "a"), (4, "a"), (40, "b")], [(16, "b"), (31, "b"), (95, "a")],
    ]
    late = []
    for number, entries in enumerate(batches):
        (folder / f"{number}.log").write_text(("no header here\n" if number == 1 else "") + "".join(line(*e) for e in entries))
        time.sleep(0.01)
        stream_log_counts(spark, f"file://{folder}", out, checkpoint, "10 minutes", "10 minutes").awaitTermination()
        mark = max([m for done in batches[:number] for m, _ in done], default=None)
        late += [e for e in entries if mark is not None and e[0] // 10 * 10 + 10 <= mark - 10]
    counted = Counter((m // 10, tag) for entries in batches for m, tag in entries if (m, tag) not in late)
    rows = log_counts(spark, out, "10 minutes").collect()
    assert {(r["window_start"].hour * 6 + r["window_start"].minute // 10, r["tag"]): r["entries"] for r in rows} == counted
    assert {r["window_start"].hour * 6 + r["window_start"].minute // 10 for r in rows if r["closed"]} == {m for m, _ in counted if m * 10 + 10 <= 85}
    listed = late_entries(spark, out).collect()
    assert late == [(4, "a"), (16, "b")]
    assert sorted(r["message"] for r in listed) == sorted([*(f"m{m}\n at x" for m, _ in late), "no header here"])


def test_replayed_batch_counts_once(spark, tmp_path):
    """A batch that runs again finds the same watermark and replaces what it wrote."""
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    (folder / "0.log").write_text("".join(entry(n) for n in range(6)))
    for run in range(2):
        stream_log_counts(spark, f"file://{folder}", out, f"file://{tmp_path}/checkpoint{run}", "1 minute", "1 minute").awaitTermination()
    assert log_counts(spark, out).agg(F.sum("entries")).first()[0] == 6


def test_a_filter_makes_each_line_once(spark):
    """Conditions on three fields do not repeat what the line is made from."""
    made = spark.range(4).select("id", F.format_string("2024-01-02 03:04:05.678 E/tag%d: said: a/b", "id").alias("value"))
    found = filter_log(parse_log_lines(made), start="2024-01-02 00:00:00", min_level="WARNING", tag="tag1")
    assert [(r["id"], r["level"], r["message"]) for r in found.collect()] == [(1, "E", "said: a/b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("format_string") == 1
