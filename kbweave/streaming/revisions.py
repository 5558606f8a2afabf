"""Captured response lines to answers that late and corrected lines revise."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kbweave.operators.ordered_text import PART_POSITIONS
from kbweave.sources.streams import is_done, sse_content

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Answer(StatefulProcessor):
    """One part of one response: its pieces, and what was last told of it."""

    def __init__(self, response_id: str, positions: int, timeout_ms: int | None, keep_ms: int | None):
        self.response_id, self.positions, self.timeout_ms, self.keep_ms = response_id, positions, timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value a part, read and written once a batch: a part has at most ``positions`` pieces.
        self.held = handle.getValueState("held", "seqs array<long>, pieces array<string>, end long, revision int, said string, waits boolean", self.keep_ms)

    def _state(self) -> tuple[dict[int, str], int, int, str, bool]:
        held = self.held.get()  # None without a value: asking first would be one more round to the JVM a part
        return ({}, -1, 0, "", False) if held is None else (dict(zip(held[0], held[1])), *tuple(held)[2:])

    def _keep(self, pieces: dict[int, str], *rest) -> None:
        seqs = sorted(pieces)
        self.held.update((seqs, [pieces[s] for s in seqs], *rest))

    def _answer(self, key, pieces: dict[int, str], end: int, revision: int, said: str, wanted: bool) -> tuple[Row | None, int, str]:
        """The next revision if there is anything new to tell: whole parts always, others only if ``wanted``."""
        first = key[1] * self.positions
        expected = end - first + 1 if end >= 0 else self.positions
        held = [(s, p) for s, p in sorted(pieces.items()) if s < first + expected]
        complete = len(held) >= expected
        text = "".join(p for _, p in held)
        mark = hashlib.sha256(f"{complete}{text}".encode()).hexdigest()
        if not (complete or wanted) or not text or mark == said:
            return None, revision, said
        row = Row(**{self.response_id: key[0], "part": key[1], "revision": revision + 1, "answer": text, "complete": complete})
        return row, revision + 1, mark

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        pieces, end, revision, said, waits = self._state()
        for row in rows:
            pieces[row["seq"]] = row["piece"]
            if row["done"]:
                end = row["seq"] if end < 0 else min(end, row["seq"])
        row, revision, said = self._answer(key, pieces, end, revision, said, wanted=False)
        if row is None and revision == 0 and self.timeout_ms is not None and not waits:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
            waits = True
        self._keep(pieces, end, revision, said, waits)
        if row is not None:
            yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        pieces, end, revision, said, _ = self._state()
        row, revision, said = self._answer(key, pieces, end, revision, said, wanted=True)
        self._keep(pieces, end, revision, said, False)
        if row is not None:
            yield row

    def close(self) -> None:
        pass


def stream_revisions(
    lines: DataFrame, response_id: str = "response_id", seq: str = "seq", line: str = "value", positions: int = PART_POSITIONS,
    timeout_ms: int | None = None, keep_ms: int | None = None,
) -> DataFrame:
    """``response_id, part, revision, answer, complete``: a part when it has all its lines, and again whenever its text changes.

    A line that comes late or is sent again with another text gives the next revision, one that changes nothing gives no row, so the row of
    the highest revision holds the answer. What lacks lines ``timeout_ms`` after its first ones is told incomplete and completed later by its
    own revision. State is kept per (response, part) for ``keep_ms`` after a change (for good without it). The query must start
    within :func:`rocksdb_state`.
    """
    id_type = lines.schema[response_id].dataType.simpleString()
    parsed = lines.select(
        F.col(response_id),
        F.floor(F.col(seq) / positions).cast("long").alias("part"),
        F.col(seq).cast("long").alias("seq"),
        F.coalesce(sse_content(F.col(line)), F.lit("")).alias("piece"),
        F.coalesce(is_done(F.col(line)), F.lit(False)).alias("done"),
    )
    timed = timeout_ms is not None or keep_ms is not None
    return parsed.groupBy(response_id, "part").transformWithState(
        _Answer(response_id, positions, timeout_ms, keep_ms), f"{response_id} {id_type}, part long, revision int, answer string, complete boolean",
        "Append", "ProcessingTime" if timed else "None",
    )


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start within it keep their state in RocksDB, which this kind of state and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
