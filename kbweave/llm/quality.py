"""Document quality by a linear-chain conditional random field over lines.

Every line gets features of its own and of the lines next to it. The field labels lines good or bad; the
forward-backward pass gives each line's probability of being good, and the document's quality is the
mean over its lines weighted by their lengths, put on the scale of the labels by a logistic fit.

Lines have no labels of their own: in training, all lines of a document carry the document's label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.functions.udfs import once
from kbweave.llm.common import SAMPLE_ROWS, forget, labelled_sample

TRAIN_LINES = 200_000

_UPPER = bytes(range(65, 91))
_DIGIT = b"0123456789"
_MARKS = bytes(c for c in range(33, 127) if chr(c) not in ".,;:'\"?-()" and not chr(c).isalnum())
_STOPS = b".,;:?"
_LETTER = bytes(c for c in range(256) if c >= 128 or chr(c).isalpha())
_EDGES = (
    (0.0, 1e-9, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),  # capitals among letters
    (0.0, 1e-9, 0.01, 0.03, 0.08, 0.2),  # digits
    (0.0, 1e-9, 0.005, 0.02, 0.05, 0.1, 0.2),  # marks
    (0.0, 1e-9, 0.01, 0.02, 0.04),  # stops
    (0.0, 0.2, 0.4, 0.6, 0.8, 0.95),  # distinct words
    (0.0, 3.0, 4.0, 5.0, 6.5, 9.0),  # bytes a word
    (0.0, 2.0, 5.0, 10.0, 25.0, 60.0, 150.0, 400.0),  # words
    (0.0, 0.05, 0.1, 0.2, 0.4, 0.8),  # share of the most frequent pair of neighbouring words
)
_WIDTH = sum(map(len, _EDGES))
FEATURES = 3 * _WIDTH + 4


def line_values(line: bytes) -> tuple[float, ...]:
    """Raw measures of one line; an empty line measures 0 everywhere."""
    size = len(line)
    words = line.split()
    n = len(words)
    if not n:
        return (0.0,) * len(_EDGES)
    letters = size - len(line.translate(None, _LETTER))
    pairs: dict[bytes, int] = {}
    low = line.lower().split()
    for i in range(n - 1):
        pair = low[i] + b" " + low[i + 1]
        pairs[pair] = pairs.get(pair, 0) + 1
    return (
        (size - len(line.translate(None, _UPPER))) / max(letters, 1),
        (size - len(line.translate(None, _DIGIT))) / size,
        (size - len(line.translate(None, _MARKS))) / size,
        (size - len(line.translate(None, _STOPS))) / size,
        min(1.0, len(set(low)) / n),
        size / n,
        float(n),
        (max(pairs.values()) - 1) / n if pairs else 0.0,
    )


def design(lines: list[bytes], starts: np.ndarray) -> np.ndarray:
    """Feature matrix of consecutive documents' lines; ``starts`` holds each document's first line."""
    values = np.array([line_values(line) for line in lines], dtype=np.float64).reshape(len(lines), len(_EDGES))
    own = np.zeros((len(lines), _WIDTH), dtype=np.float32)
    at = 0
    for j, edges in enumerate(_EDGES):
        bins = np.searchsorted(np.array(edges), values[:, j], side="right") - 1
        own[np.arange(len(lines)), at + bins] = 1
        at += len(edges)
    first = np.zeros(len(lines), dtype=bool)
    first[starts] = True
    last = np.roll(first, -1)
    out = np.zeros((len(lines), FEATURES), dtype=np.float32)
    out[:, :_WIDTH] = own
    out[1:, _WIDTH : 2 * _WIDTH] = own[:-1] * ~first[1:, None]
    out[:-1, 2 * _WIDTH : 3 * _WIDTH] = own[1:] * ~last[:-1, None]
    out[:, -4], out[:, -3], out[:, -2], out[:, -1] = first, last, first & last, 1
    return out


@dataclass(frozen=True)
class Field:
    """Emission weights of the label good, a 2 x 2 table of transitions and the logistic scale of documents."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    offset: float = 0.0


def marginals(emit: np.ndarray, moves: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many documents at once.

    Returns each line's probability of being good, the expected number of each transition, and
    the sum of the documents' log partition functions. Documents advance together line by line, longest
    first, so the work is one pass over the lines.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    score = np.stack((np.zeros_like(emit), emit), 1)
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")  # documents with a line t
    ahead[starts] = score[starts]
    for t in range(1, int(sizes[0])):
        at = starts[: live[t]] + t
        before = ahead[at - 1]
        ahead[at] = score[at] + np.logaddexp(before[:, :1] + moves[0], before[:, 1:] + moves[1])
    for t in range(int(sizes[0]) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        after = score[at + 1] + behind[at + 1]
        behind[at] = np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:])
    both = ahead + behind
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(emit), dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    expected = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            expected[a, b] = np.exp(ahead[at - 1, a] + moves[a, b] + score[at, b] + behind[at, b] - total[at]).sum()
    return good, expected, float(total[starts].sum())


def split_lines(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines of all texts, each text's first line and number of lines; an empty text is one empty line."""
    lines: list[bytes] = []
    starts = np.empty(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        starts[i] = len(lines)
        lines.extend(text.split(b"\n"))
    return lines, starts, np.diff(starts, append=len(lines))


def document_quality(field: Field, texts: list[bytes]) -> np.ndarray:
    """Length-weighted mean of the lines' probabilities of being good; every line also counts one byte."""
    if not texts:
        return np.zeros(0)
    lines, starts, sizes = split_lines(texts)
    good, _, _ = marginals(design(lines, starts) @ field.weights, field.moves, starts, sizes)
    length = np.array([len(line) + 1.0 for line in lines])
    return np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton fit of a logistic regression with intercept; the intercept comes last and is not held back."""
    x = np.column_stack((x, np.ones(len(y))))
    w = np.zeros(x.shape[1])
    hold = np.full(len(w), ridge)
    hold[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[bytes], labels: np.ndarray, steps: int = 120, ridge: float = 1e-4) -> Field:
    """Fit by Adam on the mean conditional log-likelihood of lines; without both labels the score is their share."""
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    if len(set(labels.tolist())) < 2:
        return Field(np.zeros(FEATURES, dtype=np.float32), np.zeros((2, 2)), 0.0, float(_logit(np.array([share]))[0]))
    lines, starts, sizes = split_lines(texts)
    x, y = design(lines, starts), np.repeat(labels, sizes).astype(np.float64)
    inner = np.ones(len(y), dtype=bool)
    inner[starts] = False
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[np.flatnonzero(inner) - 1].astype(int), y[inner].astype(int)), 1)
    theta = np.zeros(FEATURES + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        moves = theta[FEATURES:].reshape(2, 2)
        good, expected, _ = marginals(x @ theta[:FEATURES], moves, starts, sizes)
        grad = np.concatenate(((y - good) @ x, (observed - expected).ravel())) / len(y) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        theta += 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    field = Field(theta[:FEATURES].astype(np.float32), theta[FEATURES:].reshape(2, 2).copy())
    w = logistic(_logit(document_quality(field, texts))[:, None], labels.astype(np.float64))
    return Field(field.weights, field.moves, float(w[0]), float(w[1]))


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS // 4, max_lines: int = TRAIN_LINES) -> Field:
    """Learn from at most ``rows`` labelled documents outside the held-out fold and ``max_lines`` of their lines.

    Only the fit is bounded, so that it stays in the driver's memory; a document that does not
    fit with those before it is left out whole. Without any labelled row the field scores every text 0.5.
    """
    sample = labelled_sample(documents, labels, "quality", rows).orderBy(F.xxhash64("doc_id"), "doc_id")
    texts: list[bytes] = []
    marks: list[int] = []
    lines = 0
    for row in sample.select("text", "y").toLocalIterator():
        text = (row["text"] or "").encode("utf-8", "replace")
        own = text.count(b"\n") + 1
        if lines + own > max_lines:
            continue
        lines += own
        texts.append(text)
        marks.append(row["y"])
    if not texts:
        return Field(np.zeros(FEATURES, dtype=np.float32), np.zeros((2, 2)), 0.0, 0.0)
    return train(texts, np.array(marks))


def score_of(text: Column, field: Field) -> Column:
    """Score of a text, 0 to 1; null and empty texts score as one empty line."""

    @once("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for batch in batches:
            raw = document_quality(field, [value or b"" for value in batch.cast(pa.binary()).to_pylist()])
            yield pa.array(1 / (1 + np.exp(-(field.slope * _logit(raw) + field.offset))), pa.float64())

    return run(text)


def score(documents: DataFrame, field: Field, name: str = "score") -> DataFrame:
    """Every row of ``documents`` with its score, read from its ``text`` alone; a column of that name is replaced.

    Repeated rows are each scored; a null id stays null.
    """
    return documents.withColumn(name, score_of(F.col("text"), field))


def accepted(documents: DataFrame, field: Field, threshold: float = 0.3) -> DataFrame:
    """The documents that score ``threshold`` or more, with their columns."""
    return score(documents, field, "_quality").filter(F.col("_quality") >= threshold).drop("_quality")
