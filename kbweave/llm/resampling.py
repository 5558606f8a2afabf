"""Importance resampling towards a target: documents are drawn by how their hashed features lean to the target texts.

Features are runs of one and two words, hashed by CRC-32 into buckets. The checksums are computed on matrices: the distinct features of a
batch are grouped by length, each group is a two-dimensional array of bytes, and all its checksums advance together, one column a step;
the buckets are then scattered back to the places of the features.

* One pass reads the texts and writes each document's buckets, two bytes a feature, with the task's bucket totals beside them; the totals
  are arrays of fixed size, summed by Spark. Scoring reads only those buckets.
* Ranks need no global sort: scores are whole numbers, so the number of documents with a higher score comes from a histogram of scores,
  and only documents of one score are ordered against each other.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbweave.llm.common import text_batches, written

BUCKETS = 10_000
MATRIX_BYTES = 256  # longer features would be matrices of few rows and many columns: they are hashed one by one
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _crc_table() -> np.ndarray:
    """The 256 steps of CRC-32, by its polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, np.uint32(0xEDB88320) ^ (value >> np.uint32(1)), value >> np.uint32(1))
    return value


_TABLE = _crc_table()


def crc32s(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature, by matrices of features of one length."""
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    out = np.zeros(len(features), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        width = int(lengths[rows[0]]) if len(rows) else 0
        if width > MATRIX_BYTES:
            out[rows] = [zlib.crc32(features[i]) for i in rows.tolist()]
        elif width:
            matrix = np.frombuffer(b"".join([features[i] for i in rows.tolist()]), dtype=np.uint8).reshape(len(rows), width)
            crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
            for column in np.ascontiguousarray(matrix.T):
                crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[rows] = ~crc
    return out


def feature_buckets(texts: list[bytes], buckets: int) -> list[np.ndarray]:
    """The buckets of each text's features: its words in order, then its pairs of neighbours."""
    known: dict[bytes, int] = {}
    ids = [
        np.fromiter((known.setdefault(word, len(known)) for word in words), dtype=np.int64, count=len(words))
        for words in (_WORD.findall(text.lower()) for text in texts)
    ]
    words = list(known)
    flat = np.concatenate([one[:-1] * len(words) + one[1:] for one in ids]) if ids else np.zeros(0, dtype=np.int64)
    pairs, place = np.unique(flat, return_inverse=True)
    joined = [words[a] + b" " + words[b] for a, b in zip((pairs // max(len(words), 1)).tolist(), (pairs % max(len(words), 1)).tolist())]
    of_word, of_pair = (crc32s(features) % np.uint32(buckets) for features in (words, joined))
    out, at = [], 0
    for one in ids:
        n = max(len(one) - 1, 0)
        out.append(np.concatenate([of_word[one], of_pair[place[at : at + n]]]))
        at += n
    return out


def hashed(documents: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n_words, buckets`` of every row (two or four packed bytes a feature), and the features of all rows by bucket."""
    width = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "buckets", "counts"]
        sums = np.zeros(buckets, dtype=np.int64)
        for batch, texts in text_batches(batches):
            found = feature_buckets(texts, buckets)
            for one in found:
                sums += np.bincount(one, minlength=buckets)
            n_words = pa.array([(len(one) + 1) // 2 for one in found], pa.int64())
            packed = pa.array([one.astype(width).tobytes() for one in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, packed, pa.nulls(len(found), pa.list_(pa.int64()))], names=names)
        if sums.any():
            nothing = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([nothing, nothing, pa.nulls(1, pa.binary()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(rows.mapInArrow(run, "doc_id long, n_words long, buckets binary, counts array<long>"), "features")
    totals = rows.where("counts is not null").select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    sums = np.zeros(buckets, dtype=np.int64)
    for bucket, n in totals.collect():  # one row a bucket
        sums[bucket] = n
    return rows.where("counts is null").select("doc_id", "n_words", "buckets"), sums


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, by bucket."""
    buckets, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    pairs = zip(source.tolist(), target.tolist())
    ratio = [(t + 1.0) * (all_source + buckets) / ((s + 1.0) * (all_target + buckets)) for s, t in pairs]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], dtype=np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the mean gain of a document's features, rounded down; 0 without features."""
    width = np.dtype("<u2") if len(gain) <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(value, dtype=width) for value in batch.column(2).to_pylist()]
            weight = [int(gain[one].sum()) // len(one) if len(one) else 0 for one in found]
            sizes = pa.array([len(one) for one in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(documents: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``documents`` (``doc_id``, ``text``; other columns are not read).

    ``target`` has ``text``. The score adds Gumbel noise of the id to the weight, so the best scores are a weighted draw without
    replacement; ``percent`` of the documents with at least ``min_words`` words are drawn and ranked from 1, the others have no rank.
    Ties go to the smaller id, then to fewer features and the smaller weight; equal rows are each drawn on their own. Null and empty texts
    have no feature and weight 0. A null id takes its noise from the text ``null`` and comes last among ties. Empty tables give empty counts.
    """
    rows, source = hashed(documents, buckets)
    _, wanted = hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = written(weighted(rows, gains(source, wanted)).withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= min_words
    # Scores are whole numbers within a fixed range (the gains and the noise are logarithms), so the histogram is bounded.
    sizes = sorted(((score, n) for score, n in scored.where(fit).groupBy("score").count().collect()), reverse=True)
    left = percent * sum(n for _, n in sizes) // 100
    drawn, above = [], 0
    for score, n in sizes:
        if above >= left:
            break
        drawn.append((score, above))
        above += n
    columns = ["doc_id", "n_features", "weight", "score"]
    higher = F.broadcast(documents.sparkSession.createDataFrame(drawn, "score long, higher long"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")) + F.col("higher")
    best = scored.where(fit).join(higher, "score").withColumn("rank", place.cast("long"))
    best = best.select(*columns, F.when(F.col("rank") <= left, F.col("rank")).alias("rank"))
    lowest = drawn[-1][0] if drawn else None
    rest = scored if lowest is None else scored.where(~fit | (F.col("score") < lowest))
    return best.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
