import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbweave.functions import text as X
from kbweave.functions.chunks import ChunkSpec, fixed_chunks, mixed_chunks, paragraph_chunks, windows
from kbweave.functions.providers import detect_provider, expected_dimension, full_endpoint


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        (None, ""),
        ("  a \t\r\n b​\u0007 ", "a b"),
        ("x" * 10, "x" * 10),
        ("x" * 11 + "y", "xxxy"),
        ("-" * 50, "---"),
        ("a　b", "a　b"),
    ],
)
def test_clean(spark, raw, clean):
    assert one(spark, X.clean_text(F.col("t")), t=raw) == clean


def test_clean_unicode_spaces(spark):
    assert one(spark, X.clean_text(F.col("t"), unicode_ws=True), t="a　 b") == "a b"


U = chr(92) + "u"


@pytest.mark.parametrize(
    "raw, decoded",
    [
        (f"{U}4e2d{U}6587!", "中文!"),
        (f"a{U}0024b{U}005cc", "a$b" + chr(92) + "c"),
        (f"{U}12", f"{U}12"),
        (f"{U}d83d{U}de00", chr(0x1F600)),
        (f"{U}d83d x", f"{U}d83d x"),
        ("plain", "plain"),
    ],
)
def test_decode(spark, raw, decoded):
    assert one(spark, X.decode_unicode_escapes(F.col("t")), t=raw) == decoded


def test_escapes_are_read_in_one_pass(spark):
    """Odd neighbours of escapes, against a substitution run by run; the reader in one pass takes every text."""
    run = re.compile(X.ESCAPE_RUN)
    rng = random.Random(5)
    parts = [U, U + "4e2d", U + "D83d", U + "dE00", U + "0022", U + "005c", U + "0000", U + "000a", U + "12", chr(92), '"', "u0041", "中", chr(0x1F600), "\n", "\t", "\x01", "{}", "'", "é", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)] + ["", None, (U + "4e2d" + "x") * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", X._read_as_json(F.col("t")).alias("whole"), X.decode_unicode_escapes(F.col("t")).alias("found")).collect()
    for row in rows:
        text = texts[row["i"]]
        want = text and run.sub(lambda m: bytes.fromhex(m[0].replace(U, "")).decode("utf-16-be"), text)
        assert row["found"] == want and row["whole"] == want, text


def test_encode_takes_odd_texts(spark):
    df = spark.createDataFrame([(0, "一中鿿ꀀ 㿿é" + chr(0x1F600)), (1, None), (2, "")], "i int, t string")
    found = {r["i"]: r["e"] for r in df.select("i", X.encode_chinese(F.col("t")).alias("e")).collect()}
    assert found == {0: f"{U}4e00{U}4e2d{U}9fffꀀ 㿿é" + chr(0x1F600), 1: None, 2: ""}


def test_decode_repeatedly(spark):
    assert one(spark, X.decode_repeatedly(F.col("t")), t=f"{U}005cu4e2d") == "中"


def test_encode(spark):
    assert one(spark, X.encode_chinese(F.col("t")), t="a中b") == f"a{U}4e2db"


@pytest.mark.parametrize(
    "text, still_open, fixed",
    [
        ("```py\nx", True, "```py\nx\n```"),
        ("```a\n```", False, "```a\n```"),
        ("abcdef```", False, "abcdef```\n```"),
        ("a ` b", False, "a ` b`"),
        ("a `b` c", False, "a `b` c"),
        ("\n   ```", True, "\n   ```\n```"),
        ("", False, ""),
    ],
)
def test_fences(spark, text, still_open, fixed):
    assert one(spark, X.has_open_fence(F.col("t")), t=text) is still_open
    assert one(spark, X.fix_code_blocks(F.col("t")), t=text) == fixed


def brute_fences(text):
    """Marker and backtick rules by position."""
    starts = [i for i in range(len(text)) if text.startswith("```", i)]
    markers = [
        i
        for i in starts
        if i == 0 or text[i - 1] in "\n \t" or (text.rfind("\n", 0, i) >= 0 and i - text.rfind("\n", 0, i) <= 4)
    ]
    lone = [i for i, c in enumerate(text) if c == "`" and all(abs(i - p) >= 3 for p in starts)]
    return len(markers) % 2 == 1, text + ("\n```" if len(starts) % 2 else "") + ("`" if len(lone) % 2 else "")


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="`a \n", max_size=14), min_size=30, max_size=30))
def test_fences_match_positions(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", X.has_open_fence(F.col("t")).alias("o"), X.fix_code_blocks(F.col("t")).alias("f")).collect()
    for row in rows:
        assert (row["o"], row["f"]) == (brute_fences(row["t"]) if row["t"] else (False, ""))


def brute_windows(text, size, overlap):
    step, out, start = size - overlap, [], 0
    while text:
        out.append(text[start : start + size])
        if start + size >= len(text):
            break
        start += step
    return out


@settings(max_examples=15, deadline=None)
@given(
    st.lists(st.text(alphabet="abé中\n ", max_size=80), min_size=10, max_size=10),
    st.integers(1, 20),
    st.integers(0, 19),
)
def test_windows(spark, texts, size, overlap):
    spec = ChunkSpec(size, min(overlap, size - 1), 1)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", windows(F.col("t"), spec).alias("w")).collect():
        expected = brute_windows(row["t"], spec.size, spec.overlap)
        assert row["w"] == expected
        joined = "".join(w[spec.overlap :] if i else w for i, w in enumerate(expected))
        assert joined == row["t"]


def test_chunk_minimum(spark):
    spec = ChunkSpec(10, 2, 5)
    assert one(spark, fixed_chunks(F.col("t"), spec), t="a" * 12) == ["a" * 10]
    with pytest.raises(ValueError):
        ChunkSpec(10, 10)


def test_paragraphs_and_sections(spark):
    spec = ChunkSpec(20, 5, 3)
    text = "first one\n \nsecond " + "x" * 30 + "\n\n\n  \n\nend"
    parts = one(spark, paragraph_chunks(F.col("t"), spec), t=text)
    assert parts[0] == "first one" and parts[-1] == "end" and all(len(p) <= 20 for p in parts)
    doc = "intro text\n# One\nbody\n## Two\n" + "y" * 30
    assert one(spark, mixed_chunks(F.col("t"), spec), t=doc) == [
        "intro text", "One\nbody", "Two\n" + "y" * 20, "Two\n" + "y" * 15,
    ]


@pytest.mark.parametrize(
    "url, provider, endpoint",
    [
        ("LOCAL", "LOCAL", "local"),
        ("http://ollama.deepseek/", "OLLAMA", "http://ollama.deepseek/api/generate"),
        ("https://ark.cn/api/completion", "DOUBAO", "https://ark.cn/api/completion"),
        ("https://x.aliyun.com", "QIANWEN", "https://x.aliyun.com/v1/services/aigc/text-generation/generation"),
        ("https://api.example.com//", "OPENAI", "https://api.example.com//v1/chat/completions"),
    ],
)
def test_providers(spark, url, provider, endpoint):
    kind = detect_provider(F.col("u"))
    assert one(spark, kind, u=url) == provider
    assert one(spark, full_endpoint(F.col("u"), kind), u=url) == endpoint


def test_dimension_rules(spark):
    names = {"Qwen3-600M": 1024, "bge-x": 1024, "BGE-base": 768, "bert-large": 1024, "sentence": 768, "other": 1024}
    for name, dim in names.items():
        assert one(spark, expected_dimension(F.col("m"), F.lit(None)), m=name) == dim


def test_masking_and_titles(spark):
    assert one(spark, X.mask_secret(F.col("t")), t="12345678") == "****"
    assert one(spark, X.mask_secret(F.col("t")), t="123456789") == "1234...6789"
    assert one(spark, X.add_thinking_suffix(F.col("t"), True), t="path/think") == "path/think"
    assert one(spark, X.estimate_tokens(F.col("t")), t="abc") == 1
    assert one(spark, X.duration_hms(F.lit(3_661_999)), t="") == "01:01:01"
