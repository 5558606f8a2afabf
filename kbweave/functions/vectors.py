"""Vector, logit and token-id expressions. Sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column, term) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + term(x.cast("double")))


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(v, lambda x: x * x))


def mean(v: Column) -> Column:
    return _sum(v, lambda x: x) / F.size(v)


def mean_ignore_nan(v: Column) -> Column:
    """Mean of the entries that are numbers (infinities count); 0 when there are none."""
    numbers = F.filter(v, lambda x: ~F.isnan(x))
    return F.when(F.size(numbers) == 0, 0.0).otherwise(mean(numbers))


def variance(v: Column, mean_value: Column) -> Column:
    return _sum(v, lambda x: (x - mean_value) * (x - mean_value)) / F.size(v)


def skewness(v: Column, mean_value: Column, variance_value: Column) -> Column:
    std = F.sqrt(variance_value)
    return F.when(variance_value < 1e-8, 0.0).otherwise(
        _sum(v, lambda x: F.pow((x - mean_value) / std, F.lit(3.0))) / F.size(v)
    )


def _finite_or(value: Column, fallback: float) -> Column:
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, fallback).otherwise(value)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in [-1, 1]; 0 for a near-zero side or a non-finite result, error on unequal length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    squared_a, squared_b = _sum(a, lambda x: x * x), _sum(b, lambda x: x * x)
    cosine = _sum(products, lambda x: x) / F.sqrt(squared_a * squared_b)
    return (
        F.when(
            F.size(a) != F.size(b),
            F.raise_error(F.format_string("vector lengths differ: %d and %d", F.size(a), F.size(b))).cast("double"),
        )
        .when((squared_a <= 1e-6) | (squared_b <= 1e-6), 0.0)
        .otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _finite_or(cosine, 0.0))))
    )


def sigmoid(x: Column) -> Column:
    """0.5 for a non-finite input, saturated beyond 700."""
    x = x.cast("double")
    finite = (
        F.when(x > 700, 1.0)
        .when(x < -700, 0.0)
        .otherwise(1 / (1 + F.exp(-x)))
    )
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.5).otherwise(finite)


def softmax(logits: Column) -> Column:
    """Shifted by the maximum; any non-finite logit gives the uniform distribution."""
    bad = F.exists(logits, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    exps = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(bad, F.transform(logits, lambda _: 1.0 / F.size(logits))).otherwise(
        F.transform(exps, lambda x: x / total)
    )


def relevance_logit(logits: Column) -> Column:
    """The second logit of a pair or longer, else the only one, else NULL."""
    return F.when(F.size(logits) >= 2, F.get(logits, F.lit(1))).when(
        F.size(logits) == 1, F.get(logits, F.lit(0))
    )


def pool_mean(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask entry is 1."""
    valid = F.transform(
        F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda p: p["m"] == 1), lambda p: p["h"]
    )
    zeros = F.transform(F.get(hidden, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(valid, zeros, lambda acc, h: F.zip_with(acc, h, lambda a, x: a + x.cast("double")))
    return F.transform(total, lambda x: (x / F.greatest(F.size(valid), F.lit(1))).cast("float"))


def pool_last(hidden: Column, mask: Column) -> Column:
    """The last valid token's vector."""
    valid = F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda p: p["m"] == 1)
    return F.element_at(valid, -1)["h"]


def pool_first(hidden: Column) -> Column:
    return F.get(hidden, F.lit(0))


def truncate_ids(ids: Column, max_tokens: int, end_id: int = 2) -> Column:
    """Too many ids: keep ``max_tokens - 1`` and close with the end id."""
    return F.when(
        F.size(ids) > max_tokens, F.concat(F.slice(ids, 1, max_tokens - 1), F.array(F.lit(end_id)))
    ).otherwise(ids)


def truncate_pair_ids(ids: Column, max_tokens: int = 512) -> Column:
    return F.slice(ids, 1, max_tokens)


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(ids))


def token_type_ids(ids: Column) -> Column:
    return F.array_repeat(F.lit(0), F.size(ids))


def drop_special_ids(ids: Column, special: list[int], preserved: list[int]) -> Column:
    dropped = [i for i in special if i not in preserved]
    return F.filter(ids, lambda i: ~i.isin(dropped)) if dropped else ids
