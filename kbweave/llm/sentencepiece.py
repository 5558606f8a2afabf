"""SentencePiece BPE ids by a merge-type prefix table.

For every prefix of a piece of text the table stores the last token of that prefix's encoding. A token
found by the automaton ending at a position is that last token exactly if it stands next to the last token of the
prefix before it in some encoding (pair compatibility), and just one token can pass. The ids are
read backwards from the end. Time is linear in the text, whatever its length.

Texts are cut where no piece of the vocabulary can reach across: before a run of white space signs
and around characters the vocabulary does not hold. White space runs share one score
in such models, which makes their merges depend on position; those few pieces are merged by rank directly.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.functions.udfs import once
from kbweave.llm.common import REMEMBERED

SPACE = "▁"
CACHE = 1 << 17  # parts remembered in each of two generations


class PrefixTable:
    """Encoder of one model file. Works for BPE models with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not model.is_control(i) and not model.is_unknown(i):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        self.pieces = {i: piece for piece, i in self.ids.items()}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            raise ValueError("pieces with white space after other characters are not handled")
        self.chars = {piece for piece in self.ids if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        self.tree: dict[str, tuple[str, str]] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        for piece, i in self.ids.items():
            if SPACE + SPACE not in piece and set(piece) <= self.chars and self.merge(piece, self.tree) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        stop = "" if "\n" in self.chars else "\n"
        self.cut = re.compile(f" *[^ {stop}]+| +" + ("|\n" if stop else ""))
        self.fits: dict[int, bool] = {}
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, text: str, tree: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Merges by rank, best score first and leftmost on ties; for vocabulary pieces and white space runs.

        ``tree`` gets the two halves each piece was merged from.
        """
        part = list(text)
        after, before = [*range(1, len(part)), -1], list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int) -> None:
            right = after[left] if left >= 0 else -1
            if right >= 0:
                both = part[left] + part[right]
                if both in self.score:
                    heapq.heappush(heap, (-self.score[both], left, right, both))

        for left in range(len(part) - 1):
            offer(left)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if part[left] and part[right] and after[left] == right and part[left] + part[right] == both:
                if tree is not None:
                    tree[both] = part[left], part[right]
                part[left], part[right] = both, ""
                after[left] = after[right]
                if after[right] >= 0:
                    before[after[right]] = left
                offer(before[left])
                offer(left)
        return [piece for piece in part if piece]

    def spine(self, token: int, right: bool) -> list[tuple[str, float]]:
        """Pieces at the right (left) edge of a token while it forms, each with the rank by which the next one has formed.

        The next piece needs its other half, so that rank is the highest of its own merge and of the merges in that half.
        """
        known = self.spines[right].get(token)
        if known is None:
            piece, up, known = self.pieces[token], float("inf"), []
            while True:
                known.append((piece, up))
                if len(piece) == 1:
                    break
                halves = self.tree[piece]
                up = max(-self.score[piece], self.formed(halves[not right]))
                piece = halves[right]
            known.reverse()
            self.spines[right][token] = known
        return known

    def formed(self, piece: str) -> float:
        """Highest rank among a piece's merges."""
        if len(piece) == 1:
            return float("-inf")
        left, right = self.tree[piece]
        return max(-self.score[piece], self.formed(left), self.formed(right))

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their texts are encoded together.

        Both edges grow from single characters to the tokens; they stay apart if at every moment an edge grows before the two could merge.
        """
        key = left << 32 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = self.fits[key] = self.apart(self.spine(left, True), self.spine(right, False))
        return known

    def apart(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        score, i, j = self.score, 0, 0
        while True:
            (a, up), (b, over) = left[i], right[j]
            both = score.get(a + b)
            if both is None:
                if i + 1 == len(left) and j + 1 == len(right):
                    return True
                if up <= over:
                    i += 1
                else:
                    j += 1
            elif up <= over and up <= -both:
                i += 1
            elif over < -both:
                j += 1
            elif up <= -both:
                i += 1
            else:
                return False

    def walk(self, text: str) -> list[int]:
        """Ids of a text whose characters are all in the vocabulary."""
        last, size = [0] * len(text), [0] * len(text)
        fits, compatible = self.fits, self.compatible
        for end, (token, length) in self.automaton.iter(text):
            if not size[end]:
                start = end - length
                if start >= 0:
                    if not size[start]:
                        continue
                    fit = fits.get(last[start] << 32 | token)
                    if not (compatible(last[start], token) if fit is None else fit):
                        continue
                last[end], size[end] = token, length
        ids, end = [], len(text) - 1
        while end >= 0:
            ids.append(last[end])
            end -= size[end]
        ids.reverse()
        return ids

    def encode_part(self, part: str) -> array:
        if self.chars.issuperset(part) and not part.startswith(SPACE + SPACE):
            return array("i", self.walk(part))
        out = array("i")
        known = ""
        for char in (*part, None):
            if char in self.chars:
                known += char
                continue
            if known:
                if known.startswith(SPACE + SPACE):
                    out.extend(self.ids[piece] for piece in self.merge(known))
                else:
                    out.extend(self.walk(known))
                known = ""
            if char is not None:
                out.extend(self.byte_id[b] for b in char.encode("utf-8", "replace"))
        return out

    def encode(self, text: str) -> array:
        """Ids of a text. Parts are cut and remembered with blanks in place of white space signs, which takes a byte a character."""
        ids = array("i")
        if text:
            seen = self.seen
            for part in self.cut.findall(" " + text.replace(SPACE, " ")):
                found = seen.get(part)
                if found is None:
                    found = self.older.get(part) or self.encode_part(part.replace(" ", SPACE)).tobytes()
                    if len(part) <= 64:
                        if len(seen) >= CACHE:
                            self.older, self.seen = seen, {}
                            seen = self.seen
                        seen[part] = found
                ids.frombytes(found)
        return ids


class Decoder:
    """Bytes that each id stands for; much smaller than the encoder's table."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.shown: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.shown.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.shown.append(b"")
            else:
                self.shown.append(" ⁇ ".encode() if model.is_unknown(i) else piece.replace(SPACE, " ").encode())

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=4)
def table(path: str) -> PrefixTable:
    return PrefixTable(path)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


REMEMBERED.extend([table, decoder])


def encoded(text: Column, model_path: str) -> Column:
    """Ids of a text as ``array<int>``, without begin or end ids; null and empty texts have none."""

    @once("array<int>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = table(model_path)
        for batch in texts:
            ids, offsets = array("i"), [0]
            for value in batch.to_pylist():
                ids.extend(encoder.encode(value or ""))
                offsets.append(len(ids))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))

    return encode(text)


def decoded(ids: Column, model_path: str) -> Column:
    """Text of ids that ``encoded`` returned; null and empty lists read as the empty text.

    Bytes that are no UTF-8, which encoding never gives, become U+FFFD.
    """

    @once("string")
    def decode(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = decoder(model_path)
        for batch in lists:
            values = batch.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.nan_to_num(batch.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            starts = np.concatenate(([0], ends[:-1]))
            yield pa.array([known.decode(values[a:b].tolist()) for a, b in zip(starts, ends)], pa.string())

    return decode(ids)


def round_trip(text: Column, model_path: str) -> Column:
    """``struct<ids, back>``: the ids of a text and what they decode to, by one worker a task."""

    @once("struct<ids:array<int>,back:string>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, known = table(model_path), decoder(model_path)
        for batch in texts:
            ids, offsets, back = array("i"), [0], []
            for value in batch.to_pylist():
                own = encoder.encode(value or "")
                ids.extend(own)
                offsets.append(len(ids))
                back.append(known.decode(own))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else [], pa.int32()))
            yield pa.StructArray.from_arrays([lists, pa.array(back, pa.string())], names=["ids", "back"])

    return run(text)


def tokenize(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """Add the ids of ``text`` and the text they decode to; all rows and columns stay, in any order.

    Null and empty texts get an empty list and an empty text. Existing columns with
    the names ``ids`` and ``back`` are replaced.
    """
    both = F.col("_sentencepiece")
    out = df.withColumn("_sentencepiece", round_trip(F.col(text), model_path))
    return out.withColumn(ids, both["ids"]).withColumn(back, both["back"]).drop("_sentencepiece")
