"""Captured response lines to answers, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kbweave.operators.ordered_text import PART_POSITIONS
from kbweave.sources.streams import is_done, sse_content

# Parts that are not whole yet: one entry each in the first four, their lines in the others, ``owners`` telling whose.
STATE_SCHEMA = "ids array<string>, parts array<long>, ends array<long>, until array<long>, owners array<int>, seqs array<long>, pieces array<string>"
BUCKETS = 1024


class _Part:
    """The lines of one part that have come, its end mark's place, and when it is given up."""

    def __init__(self, end: int = -1, until: int = 0):
        self.pieces: dict[int, str] = {}
        self.end, self.until = end, until

    def is_whole(self, first: int, positions: int) -> bool:
        expected = (self.end - first + 1) if self.end >= 0 else positions
        return sum(1 for s in self.pieces if s < first + expected) >= expected

    def text(self) -> str:
        return "".join(self.pieces[s] for s in sorted(self.pieces))


def _held(state: GroupState) -> dict[tuple[str | None, int], _Part]:
    if not state.exists:
        return {}
    ids, parts, ends, until, owners, seqs, pieces = state.get
    found = [_Part(end, last) for end, last in zip(ends, until)]
    for owner, seq, piece in zip(owners, seqs, pieces):
        found[owner].pieces[seq] = piece
    return dict(zip(zip(ids, parts), found))


def _kept(held: dict[tuple[str | None, int], _Part]) -> tuple:
    lines = [(owner, seq, piece) for owner, part in enumerate(held.values()) for seq, piece in sorted(part.pieces.items())]
    columns = [list(column) for column in zip(*lines)] if lines else [[], [], []]
    return ([k[0] for k in held], [k[1] for k in held], [p.end for p in held.values()], [p.until for p in held.values()], *columns)


def stream_answers(
    lines: DataFrame,
    response_id: str = "response_id",
    seq: str = "seq",
    line: str = "value",
    positions: int = PART_POSITIONS,
    timeout_ms: int | None = 600_000,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``response_id, part, answer, complete`` as soon as a part of a response has all its lines.

    Parts are dealt to ``buckets`` by their (response, part), so one endless response neither lands in one
    task nor grows one state, and a call handles all of a bucket's parts: a call a part costs a
    millisecond or two, however short the part. A part is complete when it has ``positions`` lines,
    or all lines up to the end mark. What stays unfinished is emitted as
    incomplete after the timeout and forgotten. A run that should end by itself
    (``availableNow``) needs ``timeout_ms=None``: a pending timeout keeps it alive.
    """
    id_type = lines.schema[response_id].dataType
    part = F.floor(F.col(seq) / positions).cast("long")
    parsed = lines.select(
        F.pmod(F.xxhash64(F.col(response_id), part), F.lit(buckets)).alias("bucket"),
        F.col(response_id).cast("string").alias("id"),
        part.alias("part"),
        F.col(seq).cast("long").alias("seq"),
        F.coalesce(sse_content(F.col(line)), F.lit("")).alias("piece"),
        F.coalesce(is_done(F.col(line)), F.lit(False)).alias("done"),
    )

    def collect(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ends = _held(state), {}
        now = 0 if timeout_ms is None else state.getCurrentProcessingTimeMs()
        touched = set()
        for rows in batches:
            for name, number, place, piece, done in zip(*(rows[c].tolist() for c in ("id", "part", "seq", "piece", "done"))):
                at = (name, number)
                touched.add(at)
                held.setdefault(at, _Part()).pieces[place] = piece
                if done:
                    ends[at] = min(place, ends.get(at, place))
        for at, end in ends.items():
            held[at].end = end
        told = []
        for at in list(held):
            it = held[at]
            whole = at in touched and it.is_whole(at[1] * positions, positions)
            if at in touched and timeout_ms is not None:
                it.until = now + timeout_ms
            if whole or (timeout_ms is not None and it.until <= now):
                del held[at]
                if text := it.text():
                    told.append((*at, text, whole))
        if held:
            state.update(_kept(held))
            if timeout_ms is not None:
                state.setTimeoutDuration(max(1, min(it.until for it in held.values()) - now))
        elif state.exists:
            state.remove()
        if told:
            yield pd.DataFrame(told, columns=["id", "part", "answer", "complete"])

    found = parsed.groupBy("bucket").applyInPandasWithState(
        collect,
        "id string, part long, answer string, complete boolean",
        STATE_SCHEMA,
        "append",
        GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
    return found.select(F.col("id").cast(id_type).alias(response_id), "part", "answer", "complete")
