import json

import pytest
from pyspark.sql import functions as F

from kbweave.functions.chat import chatml
from kbweave.functions.datasets import broken_alpaca_items, close_truncated_array, is_json_content
from kbweave.operators.datasets import explode_datasets, route_texts
from kbweave.operators.prompts import build_prompts, split_prompt
from kbweave.plans.registry.datasets import dataset_edges


def texts(spark, document, **options):
    text = document if isinstance(document, str) else json.dumps(document, ensure_ascii=False)
    df = spark.createDataFrame([(text,)], "text string")
    rows = explode_datasets(df, **options).orderBy("chunk_index").collect()
    return (rows[0]["format"] if rows else None), [r["content"] for r in rows]


@pytest.mark.parametrize(
    "document, expected",
    [
        (
            [{"instruction": "do it", "input": "", "output": "x" * 10}, {"instruction": "b", "completion": "done at last"}],
            ("alpaca", ["指令: do it\n\n输出: xxxxxxxxxx", "指令: b\n\n输出: done at last"]),
        ),
        ([{"instruction": "why so", "input": None, "output": 5}], ("alpaca", ["指令: why so\n\n输入: null\n\n输出: 5"])),
        ([{"output": "no instruction given"}], ("generic", ["output: no instruction given"])),
        (
            [{"question": "q1", "reasoning": "r1", "answer": "a1", "instruction": "z"}],
            ("cot", ["问题: q1\n\n推理过程: r1\n\n答案: a1"]),
        ),
        ([{"instruction": "p1", "chosen": "good", "rejected": "bad"}], ("dpo", ["提示: p1\n\n首选回答: good"])),
        ([{"prompt": "", "chosen": "good", "rejected": "bad"}], (None, [])),
        (
            [{"messages": [{"role": "HUMAN", "content": "hello"}, {"from": "x", "value": "skipped"}]}],
            ("conversation", ["用户: hello"]),
        ),
        (
            [{"conversations": [{"from": "gpt", "value": "hi there"}, {"role": "Bot", "content": "yes"}]}],
            ("conversation", ["gpt: hi there\n\n助手: yes"]),
        ),
        ([{"input": "short", "output": "pair"}, {"human": "a", "assistant": "b"}], ("conversation", ["输入: short\n\n输出: pair", "人类: a\n\n助手: b"])),
        ([{"dialog": [1, "keep me"], "n": 3}], ("conversation", ["dialog:\n- keep me"])),
        ({"data": [{"instruction": "deep one", "response": "ok"}]}, ("alpaca", ["指令: deep one\n\n输出: ok"])),
        ({"examples": [{"question": "q", "rationale": "r", "answer": "a"}], "data": 3}, ("cot", ["问题: q\n\n推理过程: r\n\n答案: a"])),
        (
            {"z": "last", "a": {"b": {"c": "deep enough"}}, "n": 5, "s": "5", "list": [1, 2]},
            ("object", ["z: last\n\na:\nb:\nc: deep enough\n\ns: 5\n\nlist:"]),
        ),
        ([["nested string here", {"k": "nested object"}]], (None, [])),
        ([{"k": "first object"}, ["nested string", ["deeper string"]], "tiny", 5], ("generic", ["k: first object", "nested string", "deeper string"])),
        ([], (None, [])),
        ("[1, 2", (None, [])),
        ("plain text", (None, [])),
    ],
)
def test_formats(spark, document, expected):
    assert texts(spark, document) == expected


def test_minimum_size(spark):
    short = [{"instruction": "a", "output": "b"}]
    assert texts(spark, short, min_size=20)[1] == []
    assert len(texts(spark, short, min_size=20, ignore_min=F.lit(True))[1]) == 1
    marked = [{"instruction": "STAR a", "output": "b"}, {"instruction": "c", "output": "d"}]
    assert len(texts(spark, marked, min_size=50)[1]) == 2
    many = [{"instruction": "STAR", "output": "b"}] * 1000
    assert len(texts(spark, many, min_size=50)[1]) == 1000  # as many as there are
    # A chat is measured before it is trimmed.
    assert texts(spark, [{"messages": [{"role": "user", "content": "abcd"}]}])[1] == ["用户: abcd"]


def test_bad_elements_are_skipped(spark):
    mixed = [{"instruction": "one one", "output": "1"}, 7, {"instruction": "two two", "output": "2"}]
    assert len(texts(spark, mixed)[1]) == 2


def test_detection_and_repair(spark):
    df = spark.createDataFrame([(' {"a":1} ',), ("[1]",), ("{a}",), ("[1",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(is_json_content(F.col("t"))).collect()] == [True, True, False, False, False, False]
    long = '["' + "x" * 1_000_001 + '"'
    fixed = spark.createDataFrame([(long,), ("[1",)], "t string").select(close_truncated_array(F.col("t"))).collect()
    assert fixed[0][0] == long + "]" and fixed[1][0] == "[1]"
    cut = spark.createDataFrame([('[{"a": 1',)], "t string").select(close_truncated_array(F.col("t"))).first()
    assert cut[0] == '[{"a": 1'


def test_broken_lines(spark):
    text = '{\n"instruction": "Say \\"hi\\"",\n"output": none,\n junk\n "instruction": "b"\n'
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(broken_alpaca_items(F.col("t"), 1)).first()[0]
    assert got == ['Instruction: Say \\"hi\\"\n\nOutput: none', "Instruction: b\n\n"]


def test_routing(spark):
    alpaca = json.dumps([{"instruction": "do this", "output": "done"}])
    files = [
        ("a.json", alpaca), ("b.txt", alpaca), ("c.json", "[1, 2, 3, 4, 5, 6]"), ("d.md", "plain text file"),
        ("alpaca.json", json.dumps([{"instruction": "x", "output": ""}])), ("e.txt", "  "),
    ]
    df = spark.createDataFrame(files, "file_name string, text string")
    got = {(r["file_name"], r["route"]): r["content"] for r in route_texts(df).collect()}
    assert set(got) == {
        ("a.json", "dataset"), ("b.txt", "dataset"), ("c.json", "text"), ("d.md", "text"), ("alpaca.json", "dataset"),
    }
    off = {r["route"] for r in route_texts(df, split_datasets=False).collect()}
    assert off == {"text"}
    broken = spark.createDataFrame([("x.json", '[{\n"instruction": "say it",\n"output": "now"\n')], "file_name string, text string")
    assert route_texts(broken, read_broken=True).first()["content"] == "Instruction: say it\n\nOutput: now"


def test_chatml(spark):
    rows = [[("user", "hi"), ("assistant", "yo")], [("system", "s")], [("user", "a /no_think")]]
    df = spark.createDataFrame([(r,) for r in rows], "m array<struct<role:string,content:string>>")
    plain = [r[0] for r in df.select(chatml(F.col("m"), True)).collect()]
    assert plain[1] == "<|im_start|>system\ns\n<|im_end|>\n<|im_start|>assistant\n"
    quiet = [r[0] for r in df.select(chatml(F.col("m"), thinking=False, continue_final=True)).collect()]
    assert quiet[0] == "<|im_start|>user\nhi\n\n/no_think<|im_end|>\n<|im_start|>assistant\nyo\n"
    assert quiet[2] == "<|im_start|>user\na /no_think\n<|im_end|>\n"
    with pytest.raises(ValueError):
        chatml(F.col("m"), True, True, True)


def test_prompts(spark):
    asked = spark.createDataFrame([(1, "q1"), (2, "q2")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 2, "two"), (1, 1, None), (1, 3, "three")], "query_id long, rerank_rank int, content string")
    got = {r["query_id"]: r["prompt"] for r in build_prompts(asked, hits).collect()}
    assert got[2] == "q2"
    assert got[1] == "The following is information related to the question:\nDocument2:\ntwo\n\nDocument3:\nthree\n\nq1"
    split = asked.select(split_prompt(F.lit(" s \n\nu\n\nv ")).alias("s")).first()["s"]
    assert (split["system"], split["user"]) == ("s", "u\n\nv")


def test_dataset_edges_takes_large_sets_of_every_pair(spark, tmp_path):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = dataset_edges(spark, str(tmp_path)).where("kind = 'star'").select("turn", "n", "texts", "first_text").collect()
    assert sorted(map(tuple, found)) == [(t, n, n, "指令: STAR\n\n输出: t") for t in (1, 3, 5) for n in (6, 1200)]
