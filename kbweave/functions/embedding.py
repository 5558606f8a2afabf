"""The embedding contract and its deterministic default."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kbweave.functions.text import is_blank
from kbweave.functions.udfs import once
from kbweave.functions.vector_kernels import lengths_of, to_list_array

TOKEN = r"[\p{L}\p{N}]+"
_TOKENS_PER_SLICE = 1 << 12
_TOKENS_KEPT, _LONGEST_KEPT = 1 << 16, 64
_BLOCK = 32


def words(text: Column) -> Column:
    """Lower-case words; text without any is one token, blank text has none."""
    found = F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))
    # The lambda binds the words to a variable, so the regex runs once per text.
    chosen = F.transform(
        F.array(found), lambda w: F.when((F.size(w) == 0) & ~is_blank(text), F.array(text)).otherwise(w)
    )
    return F.get(chosen, F.lit(0))


class _Digests(dict):
    """The SHA-256 blocks of a token, remembered up to a bound of tokens; long ones are not kept."""

    def __init__(self, dim: int):
        super().__init__()
        self.blocks = [b"%d:" % j for j in range(-(-dim // _BLOCK))]

    def __missing__(self, token: bytes) -> bytes:
        value = b"".join(sha256(block + token).digest() for block in self.blocks)
        if len(token) <= _LONGEST_KEPT:
            if len(self) >= _TOKENS_KEPT:
                self.clear()
            self[token] = value
        return value


def _token_table(tokens: pa.Array, dim: int, digests: _Digests) -> np.ndarray:
    """One row of odd integers from -255 to 255 per token, read from SHA-256 blocks."""
    raw = b"".join(map(digests.__getitem__, tokens.cast(pa.binary()).to_pylist()))
    values = np.frombuffer(raw, dtype=np.uint8).reshape(-1, len(digests.blocks) * _BLOCK)[:, :dim]
    return values.astype(np.int16) * 2 - 255


def _embed_slice(codes: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if len(sizes) == 1:
        # One long text: count its distinct words instead of laying out a row per word.
        sums = np.bincount(codes, minlength=len(table))[None, :] @ table.astype(np.int64)
    else:
        # Counts of the slice's distinct words times their rows; whole numbers below 2^24 are exact in float32.
        used = np.zeros(len(table), dtype=bool)
        used[codes] = True
        place = np.cumsum(used) - 1
        cells = np.repeat(np.arange(len(sizes)) * used.sum(), sizes) + place[codes]
        counts = np.bincount(cells, minlength=len(sizes) * used.sum()).reshape(len(sizes), -1)
        sums = counts.astype(np.float32) @ table[used].astype(np.float32)
    return sums / (255.0 * sizes[:, None])


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Mean of one pseudo-random vector per word, entries in [-1, 1]; empty for blank text.

    A random projection of the bag of words, so cosine follows shared words. It
    stands in for a model: any function from text to ``array<float>`` can replace it.
    """

    @once("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        digests = _Digests(dim)
        for tokens in batches:
            sizes = np.maximum(lengths_of(tokens), 0)
            encoded = tokens.flatten().dictionary_encode()
            table = _token_table(encoded.dictionary, dim, digests)
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            filled = np.flatnonzero(sizes)
            ends = np.cumsum(sizes[filled])
            groups = [(np.flatnonzero(sizes == 0), np.empty(((sizes == 0).sum(), 0)))]
            first = 0
            while first < len(filled):
                offset = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, offset + _TOKENS_PER_SLICE, side="right")))
                part = codes[offset : ends[last - 1]]
                groups.append((filled[first:last], _embed_slice(part, table, sizes[filled[first:last]])))
                first = last
            yield to_list_array(len(tokens), groups)

    return embed(words(text))
