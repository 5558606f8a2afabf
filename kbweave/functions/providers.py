"""Provider detection, endpoint completion and model-name rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URL fragments by provider, tested in this order.
PROVIDER_FRAGMENTS = (
    ("OLLAMA", ("ollama", "localhost")),
    ("DEEPSEEK", ("deepseek",)),
    ("MOONSHOT", ("moonshot",)),
    ("DOUBAO", ("volces", "ark")),
    ("QIANWEN", ("dashscope", "aliyun")),
)
# Endpoint path by provider.
ENDPOINTS = {
    "OLLAMA": "/api/generate",
    "DEEPSEEK": "/v1/chat/completions",
    "MOONSHOT": "/v1/chat/completions",
    "DOUBAO": "/api/completion",
    "QIANWEN": "/v1/services/aigc/text-generation/generation",
    "OPENAI": "/v1/chat/completions",
}
LOCAL_URL = "local"


def detect_provider(url: Column) -> Column:
    kind = F.when(F.lower(url) == LOCAL_URL, "LOCAL")
    for name, fragments in PROVIDER_FRAGMENTS:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.contains(url, F.lit(fragment))
        kind = kind.when(hit, name)
    return kind.otherwise("OPENAI")


def full_endpoint(url: Column, provider: Column) -> Column:
    """Strip one trailing slash and append the provider's path unless it is there."""
    base = F.when(F.endswith(url, F.lit("/")), F.left(url, F.length(url) - 1)).otherwise(url)
    full = F.when(provider == "LOCAL", LOCAL_URL)
    for name, path in ENDPOINTS.items():
        full = full.when(
            provider == name,
            F.when(F.contains(base, F.lit(path)), base).otherwise(F.concat(base, F.lit(path))),
        )
    return full


# Parts of the names of models that follow the setting.
_FOLLOWING = ("bge", "bert", "sentence")


def normalizes_embeddings(model: Column, configured: Column) -> Column:
    """BERT-like models follow the setting; all others are always normalised."""
    name = F.lower(model)
    follows = name.rlike("|".join(_FOLLOWING)) & ~F.contains(name, F.lit("qwen"))
    return F.when(F.coalesce(follows, F.lit(False)), configured).otherwise(F.lit(True))


def must_normalize(model: str | None, configured: bool) -> bool:
    """:func:`normalizes_embeddings` of one model; without a name all vectors are normalised."""
    name = (model or "").lower()
    follows = any(part in name for part in _FOLLOWING) and "qwen" not in name
    return configured if follows else True


def expected_dimension(model: Column, hidden_size: Column) -> Column:
    """The configured hidden size, else a guess from the model's name."""
    name = F.lower(model)
    guess = (
        F.when(F.contains(name, F.lit("qwen")), F.when(name.rlike(r"0\.6b|600m"), 1024).when(name.rlike(r"1\.5b|1500m"), 1536).otherwise(1024))
        .when(
            F.contains(name, F.lit("bge")),
            F.when(name.rlike("small|base"), 768).otherwise(1024),
        )
        .when(F.contains(name, F.lit("bert")), F.when(F.contains(name, F.lit("large")), 1024).otherwise(768))
        .when(F.contains(name, F.lit("sentence")), 768)
        .otherwise(1024)
    )
    return F.coalesce(hidden_size.cast("int"), guess)
