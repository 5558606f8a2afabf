"""Chunkers as array expressions: one row in, one array of pieces out, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbweave.functions.text import trim_blank


@dataclass(frozen=True)
class ChunkSpec:
    """Chunk size, overlap and minimum size in characters."""

    size: int = 500
    overlap: int = 100
    min_size: int = 10

    def __post_init__(self) -> None:
        if self.size < 1 or not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and below the chunk size")

    @property
    def step(self) -> int:
        return self.size - self.overlap


def windows(text: Column, spec: ChunkSpec) -> Column:
    """Windows of ``size`` characters, each starting ``step`` after the last.

    Two linear regex passes (the step, and the overlap that follows it) instead
    of one substring per window, so a very long text costs no more per character.
    A last window that only repeats the tail of the one before is left out.
    """
    pattern = F.lit(f"(?s).{{1,{spec.step}}}(?=(.{{0,{spec.overlap}}}))")
    steps = F.regexp_extract_all(text, pattern, F.lit(0))
    tails = F.regexp_extract_all(text, pattern, F.lit(1))
    count = F.greatest(F.lit(1), F.ceil((F.length(text) - spec.overlap) / spec.step).cast("int"))
    return F.slice(F.zip_with(steps, tails, lambda step, tail: F.concat(step, tail)), F.lit(1), count)


def fixed_chunks(text: Column, spec: ChunkSpec = ChunkSpec()) -> Column:
    return F.filter(windows(text, spec), lambda c: F.length(c) >= spec.min_size)


def note_chunks(content: Column, spec: ChunkSpec = ChunkSpec()) -> Column:
    """Long notes are windowed; a note that fits is one chunk whatever its length."""
    return F.when(F.length(content) > spec.size, fixed_chunks(content, spec)).otherwise(F.array(content))


def _resplit(pieces: Column, spec: ChunkSpec) -> Column:
    fitted = F.transform(
        pieces, lambda p: F.when(F.length(p) > spec.size, windows(p, spec)).otherwise(F.array(p))
    )
    return F.filter(
        F.flatten(fitted), lambda c: (F.length(c) >= spec.min_size) & (trim_blank(c) != "")
    )


def paragraph_chunks(text: Column, spec: ChunkSpec = ChunkSpec()) -> Column:
    """Paragraphs end at a blank line; long ones are windowed. Works on uncleaned text."""
    return _resplit(F.transform(F.split(text, r"\n\s*\n", -1), trim_blank), spec)


def section_structs(text: Column) -> Column:
    """``array<struct<title, body>>`` cut at Markdown headings; text before the first has no title."""
    parts = F.split(text, r"(?m)(?=^#{1,6}[ \t])", -1)
    heading = r"^#{1,6}[ \t]+([^\r\n]*)"
    structs = F.transform(
        parts,
        lambda p: F.struct(
            trim_blank(F.regexp_extract(p, heading, 1)).alias("title"),
            trim_blank(F.regexp_replace(p, heading, "")).alias("body"),
        ),
    )
    return F.filter(structs, lambda s: (s["title"] != "") | (s["body"] != ""))


def _titled(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", F.when(title != "", title), F.when(body != "", body))


def section_chunks(text: Column, spec: ChunkSpec = ChunkSpec()) -> Column:
    """One chunk per section: its title, then its text."""
    whole = F.transform(section_structs(text), lambda s: _titled(s["title"], s["body"]))
    return F.filter(whole, lambda c: F.length(c) >= spec.min_size)


def mixed_chunks(text: Column, spec: ChunkSpec = ChunkSpec()) -> Column:
    """Sections first; a section too long for one chunk is windowed and its title repeated."""
    pieces = F.transform(
        section_structs(text),
        lambda s: F.when(F.length(_titled(s["title"], s["body"])) <= spec.size, F.array(_titled(s["title"], s["body"])))
        .otherwise(F.transform(windows(s["body"], spec), lambda b: _titled(s["title"], b))),
    )
    return F.filter(F.flatten(pieces), lambda c: F.length(c) >= spec.min_size)
