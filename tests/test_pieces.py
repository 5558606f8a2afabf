"""Files read in pieces: arrays and long texts cut at many splits give what the whole file gives."""

import contextlib
import json
import random

import pytest
from pyspark.sql import functions as F

from kbweave.functions.chunks import ChunkSpec, fixed_chunks
from kbweave.functions.text import clean_text
from kbweave.operators.datasets import broken_files, explode_datasets, format_elements
from kbweave.sources.json_arrays import read_elements, read_pieces, unread_files
from kbweave.sources.long_texts import read_lines, read_windows


@contextlib.contextmanager
def split_size(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], str(size))
    spark.conf.set(names[1], "1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def put(folder, **texts):
    for name, text in texts.items():
        (folder / f"{name}.json").write_bytes(text.encode() if isinstance(text, str) else text)
    return f"file://{folder}"


def base(rows):
    return [(r["file"].rsplit("/", 1)[1], *r[1:]) for r in rows]


ITEMS = [
    {"instruction": 'quote " and \\ back', "output": "a, b, [c], {d} ]}"},
    {"instruction": "é, ü, 日本,", "output": "\\\\", "input": "\n, ,"},
    {"instruction": "x,y" * 60, "output": ",,,,,"},
    {"messages": [{"role": "user", "content": "q, \"r\""}, {"role": "assistant", "content": "[1, 2"}]},
    {"human": "h,", "assistant": "a" * 300},
    {"deep": {"er": [1, [2, {"x": ["y, z", "\\\" ,"]}]]}},
]


def arrays():
    rng = random.Random(5)
    many = [rng.choice(ITEMS) for _ in range(60)]
    mixed = [rng.choice([1, "text, of [some] length", None, True, [1, "two, three"], {}, [], "", *ITEMS]) for _ in range(60)]
    return many, mixed


@pytest.mark.parametrize("size", [500, 1 << 20])
def test_elements(spark, tmp_path, size):
    many, mixed = arrays()
    wrapped = {"meta": {"a": [1, {"b": 2}], "c": "x, y"}, "examples": mixed[:20], "n": [], "data": many[:15], "tail": 1}
    path = put(
        tmp_path, many=json.dumps(many, ensure_ascii=False), pretty=json.dumps(mixed, indent=2), wrapped=json.dumps(wrapped), empty="[]", blank=" \n", none="",
        one='["a"]', text="plain, text [with] brackets", truncated=json.dumps(many[:30])[:-1], nested=json.dumps([[many[:3]], [[], [[]]]]), spaced="\n [ 1 ,\t2 ,3 ]\n",
    )
    with split_size(spark, size):
        rows = base(read_elements(spark, path).collect())
        pieces = read_pieces(spark, path)
        assert size > 1000 or pieces.rdd.getNumPartitions() > 30
        bad = base(unread_files(spark, path).collect())
    found = {}
    for name, list_name, block, k, element in rows:
        found.setdefault((name, list_name), []).append((block, k, json.loads(element)))
    texts = {key: [x[2] for x in sorted(value, key=lambda v: v[:2])] for key, value in found.items()}
    assert texts == {
        ("many.json", ""): many, ("pretty.json", ""): mixed, ("one.json", ""): ["a"], ("truncated.json", ""): many[:30], ("nested.json", ""): [[many[:3]], [[], [[]]]],
        ("spaced.json", ""): [1, 2, 3], ("wrapped.json", "examples"): mixed[:20], ("wrapped.json", "data"): many[:15],
    }
    reasons = dict(bad)
    assert reasons["text.json"] == "no array or object" and reasons["truncated.json"] == "brackets do not close" and "many.json" not in reasons


@pytest.mark.parametrize("size", [3000, 1 << 20])
def test_datasets_in_pieces_are_whole_datasets(spark, tmp_path, size):
    many, mixed = arrays()
    alpaca = [x for x in many if "instruction" in x]
    star = [{"instruction": "STAR", "output": "a"}] * 1200
    talks = [x for x in many if "instruction" not in x]
    texts = {
        "alpaca": alpaca, "star": star, "talks": talks, "mixed": mixed, "first_number": [1, *alpaca], "dpo": [{"prompt": "p,p", "chosen": "c" * 9, "rejected": ""}] * 3,
        "data": {"data": alpaca[:20], "conversations": talks[:9]}, "conversations": {"conversations": [*talks, {"other": "field, of text"}]}, "cot": [{"question": "q", "rationale": "r,", "answer": "a" * 20}],
    }
    texts = {name: json.dumps(value, ensure_ascii=False) for name, value in texts.items()}
    path = put(tmp_path, **texts, broken='[{"a": "b"}, {"c" "d"}]')
    with split_size(spark, size):
        elements = read_elements(spark, path)
        got = base(format_elements(elements).collect())
        broken = base(broken_files(elements).collect())
    whole = spark.createDataFrame([(f"{n}.json", t) for n, t in texts.items()], "file string, text string")
    wanted = [tuple(r) for r in explode_datasets(whole).select("file", "format", "chunk_index", "total_chunks", "content").collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr) and len(wanted) > 1250
    assert broken == [("broken.json", 1)]


TEXTS = {
    "prose": "\n".join(f"Line {i} with some words,  and\tblanks   " + "." * (i % 30) for i in range(150)),
    "short": "tiny",
    "tiny_tail": "x" * 905,
    "blank": " \n\t\n",
    "controls": ("\x00\x01\n" * 40 + "a​ b\x02 \n") * 30 + "\x00\n" * 15,
    "runs": "\n".join(["====================", "aaaaaaaaaaaaaaaa", "", "  ", "é" * 40] * 60),
    "spaces": "a" + "\n\x03" * 12 + "\n" + "b \x04 \x04 \x04 \x04 \x04 \x04\n\x04 \x04 \x04 \x04 \x04 \x04 \x04c\n" * 20,
    "wide": "日本語のテキスト。" * 300 + "\r\n" + "𝒳" * 700,
}


def test_elements_across_tiny_splits(spark, tmp_path):
    """Strings, elements and names that run over several splits."""
    values = [["a, b", {"c": "d" * 60, "e,": [1, "\\\", ["]}], "x" * 90, 5, {"k": "v, w, x, y, z"}]
    path = put(tmp_path, list=json.dumps(values), wrapped=json.dumps({"conversations": values[1:], "note": "a, b", "data": {"no": "list, here"}}))
    with split_size(spark, 11):
        rows = base(read_elements(spark, path).collect())
    found = {}
    for name, list_name, block, k, element in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        found.setdefault((name, list_name), []).append(json.loads(element))
    assert found == {("list.json", ""): values, ("wrapped.json", "conversations"): values[1:]}


@pytest.mark.parametrize("size, spec", [(900, ChunkSpec()), (700, ChunkSpec(40, 15, 1)), (1 << 20, ChunkSpec(7, 0, 3))])
def test_windows_in_pieces_are_whole_windows(spark, tmp_path, size, spec):
    path = put(tmp_path, **TEXTS)
    with split_size(spark, size):
        got = base(read_windows(spark, path, spec).collect())
        assert size > 1000 or read_lines(spark, path).rdd.getNumPartitions() > 20
    whole = spark.createDataFrame([(f"{n}.json", t) for n, t in TEXTS.items()], "file string, text string")
    chunks = whole.select("file", fixed_chunks(clean_text(F.col("text")), spec).alias("c"))
    chunks = chunks.select("file", F.size("c").alias("n"), F.posexplode("c").alias("i", "content"))
    wanted = [(r["file"], r["i"], r["n"], r["content"]) for r in chunks.collect()]
    assert sorted(got) == sorted(wanted)


def test_windows_across_tiny_splits(spark, tmp_path):
    texts = {"a": "one\ntwo three\n\n" + "four five six\n" * 6, "b": "=====\n=====\n" + "a\x00\n" * 14 + "b"}
    path = put(tmp_path, **texts)
    with split_size(spark, 13):
        got = base(read_windows(spark, path, ChunkSpec(30, 12, 2)).collect())
    whole = spark.createDataFrame([(f"{n}.json", t) for n, t in texts.items()], "file string, text string")
    chunks = whole.select("file", fixed_chunks(clean_text(F.col("text")), ChunkSpec(30, 12, 2)).alias("c")).select("file", F.size("c").alias("n"), F.posexplode("c").alias("i", "content"))
    assert sorted(got) == sorted((r["file"], r["i"], r["n"], r["content"]) for r in chunks.collect())


def test_no_files_with_text(spark, tmp_path):
    path = put(tmp_path, none="", blank="\n \n")
    assert read_windows(spark, path).count() == 0 and read_elements(spark, path).count() == 0
