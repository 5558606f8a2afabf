"""Arrow-batched vector quality kernels: detect, repair, normalise.

A batch of vectors is grouped by length into matrices, so numpy handles whole
batches and ragged input still works. Noise depends only on the row key, the
element index and a stream number, never on partitioning or task retries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbweave.functions.udfs import once

# Anomaly types.
TYPES = (
    "NONE",
    "NAN_VALUES",
    "INFINITE_VALUES",
    "EXTREME_VALUES",
    "ZERO_VECTOR",
    "DIMENSION_MISMATCH",
    "DIMENSION_MISSING",
    "DIMENSION_REDUNDANT",
    "LOW_VARIANCE",
    "HIGH_VARIANCE",
    "HIGH_SKEWNESS",
    "ABNORMAL_CLUSTERING",
)
CODE = {name: code for code, name in enumerate(TYPES)}

# Detection thresholds.
ZERO_LIMIT = 1e-8
NORM_LIMIT = 1e-6
EXTREME_LIMIT = 1e3
EXTREME_SHARE = 0.1
VARIANCE_LOW = 1e-6
VARIANCE_HIGH = 1e3
SKEW_LIMIT = 3.0
CLUSTER_GAP = 1e-6
CLUSTER_SHARE = 0.3
CLUSTER_MIN_LENGTH = 10
RANDOM_UNIT_SEVERITY = 0.8

ANOMALY_SCHEMA = "struct<type:string,is_anomalous:boolean,severity:double>"


# --- batches of ragged vectors -------------------------------------------------


def lengths_of(vectors: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)


def matrices(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, row numbers, float64 matrix)`` for each distinct length; NULL rows are left out."""
    sizes = lengths_of(vectors)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))[:-1]
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        if len(rows) == len(sizes) and size > 0:
            yield int(size), rows, values.reshape(-1, size).astype(np.float64)
        else:
            yield int(size), rows, values[starts[rows][:, None] + np.arange(size)].astype(np.float64)


def to_list_array(count: int, groups: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Rows of matrices back into one ``list<float>`` array; rows in no group become NULL."""
    sizes = np.full(count, -1, dtype=np.int64)
    for rows, matrix in groups:
        sizes[rows] = matrix.shape[1]
    offsets = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    flat = np.empty(offsets[-1], dtype=np.float32)
    for rows, matrix in groups:
        flat[offsets[rows][:, None] + np.arange(matrix.shape[1])] = matrix
    missing = sizes < 0
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array(missing) if missing.any() else None
    )


# --- noise ---------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """One splitmix64 finaliser round."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gaussian(keys: np.ndarray, length: int, stream: int) -> np.ndarray:
    """Standard normal noise, one row per key (Box-Muller over hashed counters)."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        base = _mix(keys.astype(np.int64).view(np.uint64) + step * np.uint64(stream + 1))[:, None]
        counter = np.arange(length, dtype=np.uint64)[None, :] * np.uint64(2)
        first = _mix(base + step * (counter + np.uint64(1)))
        second = _mix(base + step * (counter + np.uint64(2)))
    u1 = ((first >> np.uint64(11)).astype(np.float64) + 1.0) / 2.0**53
    u2 = (second >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)


def random_unit(keys: np.ndarray, length: int, stream: int = 0) -> np.ndarray:
    vectors = gaussian(keys, length, stream) * 0.1
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    flat = norms <= NORM_LIMIT
    vectors = vectors / np.where(flat, 1.0, norms)[:, None]
    if length:
        vectors[flat] = np.eye(1, length)
    return vectors


# --- detection -----------------------------------------------------------------


def _longest_cluster(x: np.ndarray) -> np.ndarray:
    """Size of the longest chain of sorted neighbours that are closer than the gap."""
    close = np.diff(np.sort(x, axis=1), axis=1) < CLUSTER_GAP
    run = np.cumsum(close, axis=1)
    before = np.maximum.accumulate(np.where(close, 0, run), axis=1)
    return (run - before).max(axis=1, initial=0) + 1


def detect_matrix(x: np.ndarray, expected: int) -> tuple[np.ndarray, np.ndarray]:
    """Anomaly code and severity of each row; the first rule that fires wins."""
    rows, length = x.shape
    if expected > 0 and length != expected:
        kind = "DIMENSION_MISSING" if length < expected else "DIMENSION_MISMATCH"
        return np.full(rows, CODE[kind]), np.full(rows, 0.9)
    if length == 0:
        return np.full(rows, CODE["ZERO_VECTOR"]), np.ones(rows)

    with np.errstate(all="ignore"):
        nan, inf, size = np.isnan(x), np.isinf(x), np.abs(x)
        nan_share, inf_share = nan.mean(axis=1), inf.mean(axis=1)
        extreme_share = ((size > EXTREME_LIMIT) & ~inf).mean(axis=1)
        norm = np.sqrt((x * x).sum(axis=1))
        mean = x.mean(axis=1, keepdims=True)
        centred = x - mean
        variance = (centred * centred).mean(axis=1)
        skew = (centred**3).mean(axis=1) / np.where(variance < 1e-8, 1.0, variance) ** 1.5
        skew[variance < 1e-8] = 0.0
        cluster = _longest_cluster(x) / length if length >= CLUSTER_MIN_LENGTH else np.zeros(rows)

        rules = (
            ("NAN_VALUES", nan_share > 0, nan_share),
            ("INFINITE_VALUES", inf_share > 0, inf_share),
            ("EXTREME_VALUES", extreme_share > EXTREME_SHARE, extreme_share),
            ("ZERO_VECTOR", (size < ZERO_LIMIT).all(axis=1), 1.0),
            ("ZERO_VECTOR", norm < NORM_LIMIT, 0.8),
            ("LOW_VARIANCE", variance < VARIANCE_LOW, 0.6),
            ("HIGH_VARIANCE", variance > VARIANCE_HIGH, 0.7),
            ("HIGH_SKEWNESS", np.abs(skew) > SKEW_LIMIT, 0.5),
            ("ABNORMAL_CLUSTERING", cluster > CLUSTER_SHARE, cluster),
        )
        hits = [hit for _, hit, _ in rules]
        codes = np.select(hits, [CODE[name] for name, _, _ in rules], CODE["NONE"])
        severity = np.select(hits, [np.broadcast_to(s, rows) for _, _, s in rules], 0.0)
    return codes, severity


# --- repair --------------------------------------------------------------------


def _fill_nan(x: np.ndarray) -> np.ndarray:
    nan = np.isnan(x)
    count = (~nan).sum(axis=1)
    mean = np.where(nan, 0.0, x).sum(axis=1) / np.maximum(count, 1)
    return np.where(nan, mean[:, None], x)


def _fill_inf(x: np.ndarray) -> np.ndarray:
    finite = np.isfinite(x)
    none = ~finite.any(axis=1)
    high = np.where(none, 1.0, np.where(finite, x, -np.inf).max(axis=1))
    low = np.where(none, -1.0, np.where(finite, x, np.inf).min(axis=1))
    return np.where(x == np.inf, high[:, None], np.where(x == -np.inf, low[:, None], x))


def _pad(x: np.ndarray, keys: np.ndarray, expected: int) -> np.ndarray:
    length = x.shape[1]
    extra = expected - length
    noise = gaussian(keys, extra, 1) * 0.1
    if length > 1:
        filled = x[:, np.arange(length, expected) % length] + noise * x.std(axis=1, keepdims=True)
    else:
        filled = noise + (x.mean(axis=1, keepdims=True) if length else 0.0)
    return np.hstack([x, filled])


def repair_matrix(x: np.ndarray, code: int, keys: np.ndarray, expected: int) -> np.ndarray:
    """Repair rows that share one anomaly; types without a repair come back unchanged."""
    name = TYPES[code]
    length = x.shape[1]
    with np.errstate(all="ignore"):
        if name == "NAN_VALUES":
            return _fill_nan(x)
        if name == "INFINITE_VALUES":
            return _fill_inf(x)
        if name == "ZERO_VECTOR":
            return random_unit(keys, length)
        if name == "DIMENSION_MISSING" and length < expected:
            return _pad(x, keys, expected)
        if length == 0:
            return x
        mean, std = x.mean(axis=1, keepdims=True), x.std(axis=1, keepdims=True)
        if name == "EXTREME_VALUES":
            return np.clip(x, mean - 3 * std, mean + 3 * std)
        if name == "HIGH_VARIANCE":
            return mean + 0.5 * (x - mean)
        if name == "LOW_VARIANCE":
            return x + 0.01 * gaussian(keys, length, 2)
        if name == "ABNORMAL_CLUSTERING":
            wave = 0.01 * np.sin(0.1 * np.arange(length))
            return x + (0.02 * gaussian(keys, length, 3) + wave) * std
        if name == "DIMENSION_REDUNDANT":
            shaken = x + 0.005 * gaussian(keys, length, 4)
            norm = np.sqrt((shaken * shaken).sum(axis=1, keepdims=True))
            return np.where(norm > NORM_LIMIT, shaken / norm, shaken)
    return x


def repair_detected(
    x: np.ndarray, codes: np.ndarray, keys: np.ndarray, expected: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, repaired matrix)`` per anomaly; lengths may differ between groups."""
    out = []
    for code in np.unique(codes):
        rows = np.flatnonzero(codes == code)
        out.append((rows, repair_matrix(x[rows], int(code), keys[rows], expected)))
    return out


def as_stored(x: np.ndarray) -> np.ndarray:
    """What a float32 column holds."""
    with np.errstate(over="ignore"):
        return x.astype(np.float32).astype(np.float64)


def normalize_matrix(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if x.shape[1] == 0:
        return x
    codes, _ = detect_matrix(x, -1)
    out = np.empty_like(x)
    for rows, fixed in repair_detected(x, codes, keys, -1):
        out[rows] = as_stored(fixed)
    with np.errstate(all="ignore"):
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        result = out / norm
    tiny = norm[:, 0] < NORM_LIMIT
    if tiny.any():
        result[tiny] = random_unit(keys[tiny], x.shape[1])
    return result


def double_check_matrix(
    x: np.ndarray, keys: np.ndarray, expected: int, above: float
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Detect, repair, detect again; what is still worse than ``above`` becomes a random unit vector."""
    codes, _ = detect_matrix(x, expected)
    out = []
    for rows, fixed in repair_detected(x, codes, keys, expected):
        fixed = as_stored(fixed)
        again, severity = detect_matrix(fixed, expected)
        broken = (again != CODE["NONE"]) & (severity > above) & (codes[rows] != CODE["NONE"])
        if broken.any():
            fixed[broken] = random_unit(keys[rows][broken], fixed.shape[1], 5)
        out.append((rows, fixed))
    return out


# --- columns -------------------------------------------------------------------


def _map_vectors(vectors: pa.Array, keys: pa.Array, fn) -> pa.Array:
    key_values = keys.to_numpy(zero_copy_only=False).astype(np.int64)
    groups = []
    for _, rows, x in matrices(vectors):
        for part, fixed in fn(x, key_values[rows]):
            groups.append((rows[part], fixed))
    return to_list_array(len(vectors), groups)


def detect_anomaly(v: Column, expected_dim: int = -1) -> Column:
    """``struct<type, is_anomalous, severity>`` of a vector."""

    @once(ANOMALY_SCHEMA)
    def detect(vectors: pa.Array) -> pa.Array:
        codes = np.full(len(vectors), CODE["ZERO_VECTOR"])
        severity = np.ones(len(vectors))
        for _, rows, x in matrices(vectors):
            codes[rows], severity[rows] = detect_matrix(x, expected_dim)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.array(TYPES, dtype=object)[codes], pa.string()),
                pa.array(codes != CODE["NONE"]),
                pa.array(severity),
            ],
            names=["type", "is_anomalous", "severity"],
        )

    return detect(v)


def repair_vector(v: Column, kind: Column, key: Column, expected_dim: int = -1) -> Column:
    """Repair by the given anomaly type; ``key`` is a BIGINT that seeds the noise."""

    @once("array<float>")
    def repair(vectors: pa.Array, kinds: pa.Array, keys: pa.Array) -> pa.Array:
        codes = np.array([CODE[k] if k else 0 for k in kinds.to_pylist()], dtype=np.int64)
        key_values = keys.to_numpy(zero_copy_only=False).astype(np.int64)
        groups = []
        for _, rows, x in matrices(vectors):
            for part, fixed in repair_detected(x, codes[rows], key_values[rows], expected_dim):
                groups.append((rows[part], fixed))
        return to_list_array(len(vectors), groups)

    return repair(v, kind, key)


def process_vector(v: Column, key: Column, expected_dim: int = -1) -> Column:
    """Detect and repair once."""

    @once("array<float>")
    def process(vectors: pa.Array, keys: pa.Array) -> pa.Array:
        return _map_vectors(
            vectors,
            keys,
            lambda x, k: repair_detected(x, detect_matrix(x, expected_dim)[0], k, expected_dim),
        )

    return process(v, key)


def normalize_vector(v: Column, key: Column) -> Column:
    """Repair, then scale to unit length; a vector without length becomes a random unit vector."""

    @once("array<float>")
    def normalize(vectors: pa.Array, keys: pa.Array) -> pa.Array:
        return _map_vectors(
            vectors, keys, lambda x, k: [(np.arange(len(x)), normalize_matrix(x, k))]
        )

    return normalize(v, key)


def double_check(v: Column, key: Column, expected_dim: int = -1, above: float = RANDOM_UNIT_SEVERITY) -> Column:
    """Repair twice-checked: chunks and queries use severity 0.8, notes use 0."""

    @once("array<float>")
    def check(vectors: pa.Array, keys: pa.Array) -> pa.Array:
        return _map_vectors(vectors, keys, lambda x, k: double_check_matrix(x, k, expected_dim, above))

    return check(v, key)


def settle_vector(
    v: Column, key: Column, expected_dim: int = -1, above: float = RANDOM_UNIT_SEVERITY, normalize: bool = True
) -> Column:
    """Normalise if asked, then double-check, in one pass through Python."""

    @once("array<float>")
    def settle(vectors: pa.Array, keys: pa.Array) -> pa.Array:
        return _map_vectors(
            vectors,
            keys,
            lambda x, k: double_check_matrix(as_stored(normalize_matrix(x, k)) if normalize else x, k, expected_dim, above),
        )

    return settle(v, key)


def random_unit_vector(key: Column, dim: int) -> Column:
    @once("array<float>")
    def draw(keys: pa.Array) -> pa.Array:
        values = keys.to_numpy(zero_copy_only=False).astype(np.int64)
        return to_list_array(len(values), [(np.arange(len(values)), random_unit(values, dim))])

    return draw(key)


def row_key(*cols: str) -> Column:
    """The BIGINT that seeds a row's noise."""
    return F.xxhash64(*cols)


# --- stored bytes --------------------------------------------------------------


@once(T.ArrayType(T.FloatType()))
def blob_to_vector(blobs: pa.Array) -> pa.Array:
    """Little-endian float32 bytes to a vector; up to three trailing bytes are ignored."""
    decoded = [
        None if b is None else np.frombuffer(b, dtype="<f4", count=len(b) // 4) for b in blobs.to_pylist()
    ]
    return pa.array(decoded, pa.list_(pa.float32()))


@once(T.BinaryType())
def vector_to_blob(vectors: pa.Array) -> pa.Array:
    packed = [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in vectors.to_pylist()]
    return pa.array(packed, pa.binary())
