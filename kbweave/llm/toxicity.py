"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is the log of its odds among toxic texts over its odds among the others, each smoothed by an informative
Dirichlet prior from the whole corpus, less a drift that makes ordinary text score below zero. One
linear pass finds every maximal segment. Under the scores' distribution in ordinary text the largest segment
of n tokens follows an extreme-value law: ``E = K n exp(-lambda S)`` segments of score S or more are
expected by chance. Segments with a small E are the toxic passages; a document's score is a logistic function of the
log E values of its best segment and of all its significant segments.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbweave.llm.common import SAMPLE_ROWS, WordIds, labelled_sample, text_batches, written
from kbweave.llm.quality import logistic

BITS = 18
WIDTH = 1 << BITS
BLOCK = 1 << 13
_DROP = bytes(c for c in range(128) if not chr(c).isalnum())
_COUNTS = "block int, kind int, counts binary"
_STATS = "doc_id long, tokens long, best double, total double, found int"
SCORED = "doc_id long, score double, segments array<struct<start:int,tokens:int,score:double>>"


class Tokens(WordIds):
    """Bucket of a word: lower-cased ASCII, without ASCII punctuation, hashed to ``WIDTH`` buckets.

    The fixed number of buckets bounds every table of counts or scores, whatever the vocabulary.
    """

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        plain = word.lower().translate(None, _DROP)
        value = self[word] = self.hash(plain) & (WIDTH - 1)
        return value


def corpus_counts(documents: DataFrame, sample: DataFrame) -> np.ndarray:
    """Numbers of texts that hold each bucket: of all documents, of toxic and of other sampled texts.

    A text counts a bucket once, so one long or repetitive text is one piece of evidence. A task adds into three fixed arrays and hands on the blocks it touched, so what is shuffled is bounded
    by tasks x buckets; the sums, 3 x ``WIDTH`` numbers, go to the driver.
    """
    rows = documents.select("text", F.lit(0).alias("kind")).unionByName(sample.select("text", (2 - F.col("y")).alias("kind")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, sums = Tokens(), np.zeros((3, WIDTH), dtype=np.int64)
        for batch, texts in text_batches(batches):
            for kind, text in zip(batch.column(1).to_pylist(), texts):
                words = text.split()
                if words:
                    sums[kind][np.unique(tokens.of(words)).astype(np.int64)] += 1
        parts = [(b, k, sums[k, b * BLOCK : (b + 1) * BLOCK]) for k in range(3) for b in range(WIDTH // BLOCK)]
        parts = [(b, k, part) for b, k, part in parts if part.any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in parts], pa.int32()), pa.array([k for _, k, _ in parts], pa.int32()), pa.array([p.tobytes() for _, _, p in parts], pa.binary())],
            names=["block", "kind", "counts"],
        )

    def add(key: tuple, group: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BLOCK, dtype=np.int64)
        for part in group:
            for value in part["counts"]:
                total += np.frombuffer(value, dtype=np.int64)
        yield pd.DataFrame({"block": [key[0]], "kind": [key[1]], "counts": [total.tobytes()]})

    sums = np.zeros((3, WIDTH), dtype=np.int64)
    for row in rows.mapInArrow(count, _COUNTS).groupBy("block", "kind").applyInPandas(add, _COUNTS).collect():
        sums[row["kind"], row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], dtype=np.int64)
    return sums


def log_odds(counts: np.ndarray, strength: float = 20_000.0) -> np.ndarray:
    """Shrunken log-odds of each bucket: the difference over the prior, times its z-score's reliability.

    ``strength`` is the weight of the prior in counted buckets. The reliability ``z^2 / (z^2 + 60)`` keeps words of
    a few near copies, which count as several texts, from passing for evidence.
    """
    prior = (counts[0] + 0.5) / (counts[0].sum() + 0.5 * counts.shape[1]) * strength
    toxic, other = counts[1] + prior, counts[2] + prior
    n_toxic, n_other = toxic.sum(), other.sum()
    delta = np.log(toxic / (n_toxic - toxic)) - np.log(other / (n_other - other))
    z = delta / np.sqrt(1 / toxic + 1 / other)
    return (delta * z**2 / (z**2 + 60.0)).astype(np.float64)


def token_scores(table: np.ndarray, found: np.ndarray, span: int = 64) -> np.ndarray:
    """Scores of a text's tokens; a positive token scores zero if the same one stands less than ``span`` tokens before.

    Repeating one word adds no evidence, and would break the assumption of independent scores.
    """
    scores = table[found.astype(np.int64)]
    at = np.flatnonzero(scores > 0)
    if len(at) > 1:
        order = at[np.lexsort((at, found[at]))]
        again = (found[order][1:] == found[order][:-1]) & (np.diff(order) < span)
        scores[order[1:][again]] = 0.0
    return scores


@dataclass(frozen=True)
class Scorer:
    """Token scores with drift, the extreme-value parameters, and the logistic weights of documents."""

    tokens: np.ndarray
    decay: float
    k: float
    weights: tuple[float, ...]
    max_e: float = 0.05


def drifted(odds: np.ndarray, background: np.ndarray) -> tuple[np.ndarray, float]:
    """Scores less the drift that gives ordinary text a clearly negative mean, and the decay rate lambda.

    lambda is the positive root of ``sum p exp(lambda s) = 1``; it exists when the mean is negative and some score is positive.
    """
    share = background / max(background.sum(), 1)
    drift = max(0.1, float(share @ odds) + 0.1)
    scores = odds - drift
    if not (scores[share > 0] > 0).any():
        return scores, 1.0
    low, high = 1e-6, 1.0
    value = lambda rate: float(share @ np.exp(np.clip(rate * scores, -50, 50)))
    while value(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 1 else (low, middle)
    return scores, high


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end, score), in linear time.

    Runs of tokens that do not score above zero are summed first: a segment starts and ends with a positive token, so the pass
    visits positive tokens alone. ``kept`` is a stack of (start, end, total before, total after); ``link[i]`` is the
    last candidate below i whose total before is smaller, which bounds the search as in the known linear algorithm.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[tuple[int, int, float, float]] = []
    link: list[int] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = at, at + 1, float(total[at]), float(total[at + 1])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = link[j]
            if j < 0 or kept[j][3] >= right:
                kept.append((start, end, left, right))
                link.append(j)
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:], link[j:]
    return [(start, end, right - left) for start, end, left, right in kept]


def summary(scorer: Scorer, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Minus log E of the best segment, the sum over all significant segments, and those segments."""
    base = math.log(scorer.k * max(n, 1))
    strong = [(a, b, s) for a, b, s in segments if scorer.decay * s - base > -math.log(scorer.max_e)]
    best = max((scorer.decay * s - base for _, _, s in segments), default=-base)
    return best, sum(scorer.decay * s - base for _, _, s in strong), strong


def inputs(best: np.ndarray, total: np.ndarray, found: np.ndarray) -> np.ndarray:
    """What the logistic function sees of a document."""
    return np.column_stack((np.clip(best, -25, 40) / 10, np.log1p(np.maximum(total, 0)), np.log1p(found)))


def _document_stats(rows: DataFrame, scorer: Scorer) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch, texts in text_batches(batches):
            out = []
            for text in texts:
                found = tokens.of(text.split())
                segments = maximal_segments(token_scores(scorer.tokens, found))
                best, total, strong = summary(scorer, len(found), segments)
                out.append((len(found), best, total, len(strong)))
            cols = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "tokens", "best", "total", "found"])

    return rows.select("doc_id", "text").mapInArrow(run, _STATS)


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Scorer:
    """Learn token scores and their calibration.

    The prior counts all documents. Labels come from at most ``rows`` documents outside the held-out fold: folds 2 to 4
    give the log-odds (equal texts once), fold 1 the extreme-value constant K and the logistic weights. With no labels, or only one,
    all texts get the share of toxic labels as their score.
    """
    sample = written(labelled_sample(documents, labels, "toxic", rows), "sample")
    evidence = sample.filter("fold >= 2").groupBy(F.xxhash64("text")).agg(F.min(F.struct("doc_id", "y", "text")).alias("row")).select("row.*")
    counts = corpus_counts(documents, evidence)
    odds, decay = drifted(log_odds(counts), counts[2] if counts[2].any() else counts[0])
    first = Scorer(odds, decay, 1.0, ())
    stats = _document_stats(sample.filter("fold = 1"), first).join(F.broadcast(sample.select("doc_id", "y")), "doc_id").toPandas()
    y = stats["y"].to_numpy(dtype=np.float64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        return Scorer(odds, decay, 1.0, (0.0, 0.0, 0.0, math.log(share / (1 - share))))
    # Of ordinary texts, n exp(-lambda S) of the best segment is exponential with rate K.
    clean = stats[stats["y"] == 0]
    k = min(max(len(clean) / max(np.exp(np.clip(-clean["best"], -30, 30)).sum(), 1e-9), 1e-6), 1e6)
    scorer = Scorer(odds, decay, k, ())
    again = _document_stats(sample.filter("fold = 1"), scorer).join(F.broadcast(sample.select("doc_id", "y")), "doc_id").toPandas()
    w = logistic(inputs(again["best"].to_numpy(), again["total"].to_numpy(), again["found"].to_numpy()), again["y"].to_numpy(dtype=np.float64), 0.1)
    return Scorer(odds, decay, k, tuple(map(float, w)))


def score(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, score, segments`` of every row; segments are the significant passages in tokens from 0.

    Null and empty texts have no tokens and no segments and get the score of a text without signal. Repeated rows
    are each scored; a null id stays null.
    """
    w = np.array(scorer.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("tokens", pa.int32()), ("score", pa.float64())]))
        for batch, texts in text_batches(batches):
            bests, totals, passages = [], [], []
            for text in texts:
                found = tokens.of(text.split())
                best, total, strong = summary(scorer, len(found), maximal_segments(token_scores(scorer.tokens, found)))
                bests.append(best)
                totals.append(total)
                passages.append([{"start": a, "tokens": b - a, "score": s} for a, b, s in strong])
            x = inputs(np.array(bests), np.array(totals), np.array([len(p) for p in passages]))
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array(passages, kind)], names=["doc_id", "score", "segments"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
