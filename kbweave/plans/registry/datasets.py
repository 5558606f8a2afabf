"""Dataset formats: JSON derived from the tables, formatted, and compared with plain SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.functions.datasets import broken_alpaca_items, close_truncated_array, is_json_content
from kbweave.operators.chat import question_answer_pairs
from kbweave.operators.datasets import dataset_stats, explode_datasets, route_texts, unread_datasets
from kbweave.operators import kb as kb_table
from kbweave.plans.build import build_from_files
from kbweave.plans.registry import query, table
from kbweave.session import scratch_path, spread

PAIRS_SQL = """
pairs AS (
  SELECT a.conv_id, b.turn, a.text AS q, b.text AS r FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
  WHERE a.role = 'user' AND b.role = 'assistant')
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = question_answer_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", F.col("instruction").alias("q"), F.col("output").alias("r"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))


def _list(item: Column) -> Column:
    return F.concat(F.lit("["), item, F.lit("]"))


def _forms(shapes: dict[str, Column]) -> Column:
    """``array<struct<kind, text>>``."""
    return F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in shapes.items()])


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("content"))


def dataset_texts(pairs: DataFrame) -> DataFrame:
    """``kind, conv_id, turn, text``: each pair as a JSON dataset of every shape."""
    q, r = F.col("q"), F.col("r")
    empty = F.lit("")
    shapes = {
        "alpaca": _list(_json(instruction=q, input=empty, output=r)),
        "alpaca_full": _list(_json(instruction=q, input=F.lit("ctx"), response=r, system=F.lit("sys"))),
        "alpaca_data": _json(version=F.lit(2), data=F.array(F.struct(q.alias("instruction"), r.alias("completion")))),
        "alpaca_two": F.concat(
            F.lit("["), _json(instruction=q, output=r), F.lit(', {"instruction": "a"}, '), _json(output=r), F.lit("]")
        ),
        "cot": _list(_json(question=q, rationale=F.lit("because"), answer=r)),
        "cot_examples": _json(
            examples=F.array(
                F.struct(q.alias("question"), F.lit("thus").alias("chain_of_thought"), r.alias("answer"))
            )
        ),
        "dpo": _list(_json(prompt=q, chosen=r, rejected=F.lit("no"))),
        "dpo_empty": _list(_json(prompt=q, chosen=empty, rejected=F.lit("no"))),
        "human": _list(_json(human=q, assistant=r)),
        "io": _list(_json(input=q, output=r)),
        "messages": _list(_json(messages=F.array(_turn("System", F.lit("s")), _turn("USER", q), _turn("bot", r)))),
        "from": F.concat(
            F.lit('[{"conversations":['), _json(**{"from": F.lit("human"), "value": q}), F.lit(","),
            _json(role=F.lit("tool"), content=r), F.lit("]}]"),
        ),
        "dialog": _list(_json(dialog=q, note=r)),
        "talk_object": _json(conversations=F.array(_turn("user", q), _turn("assistant", r))),
        "plain_object": _json(title=q, n=F.lit(5), more=F.struct(r.alias("body")), tags=F.array(q, F.lit("x"))),
        "generic_list": F.concat(
            F.lit('[{"topic": "first item"}, [["deep text here", "short"]], '), _json(v=r), F.lit(", 7, null]")
        ),
        "numbers": F.lit("[1, 2]"),
        "no_json": F.concat(F.lit("["), q),
    }
    return pairs.select("conv_id", "turn", F.inline(_forms(shapes)))


_TEXTS_SQL = f"""
WITH {PAIRS_SQL},
trimmed AS (SELECT *, rtrim(r, E' \\n\\t\\r') AS rt, rtrim(q, E' \\n\\t\\r') AS qt FROM pairs),
texts AS (
  SELECT 'alpaca' AS kind, 'alpaca' AS format, conv_id, turn, 0 AS chunk_index,
    '指令: ' || q || E'\\n\\n输出: ' || r AS content FROM trimmed
  UNION ALL SELECT 'alpaca_full', 'alpaca', conv_id, turn, 0,
    '指令: ' || q || E'\\n\\n输入: ctx\\n\\n输出: ' || r || E'\\n\\n系统: sys' FROM trimmed
  UNION ALL SELECT 'alpaca_data', 'alpaca', conv_id, turn, 0, '指令: ' || q || E'\\n\\n输出: ' || r FROM trimmed
  UNION ALL SELECT 'alpaca_two', 'alpaca', conv_id, turn, 0, '指令: ' || q || E'\\n\\n输出: ' || r FROM trimmed
  UNION ALL SELECT 'alpaca_two', 'alpaca', conv_id, turn, 1, '输出: ' || r FROM trimmed WHERE length('输出: ' || r) >= 10
  UNION ALL SELECT 'cot', 'cot', conv_id, turn, 0,
    '问题: ' || q || E'\\n\\n推理过程: because\\n\\n答案: ' || r FROM trimmed
  UNION ALL SELECT 'cot_examples', 'cot', conv_id, turn, 0,
    '问题: ' || q || E'\\n\\n推理过程: thus\\n\\n答案: ' || r FROM trimmed
  UNION ALL SELECT 'dpo', 'dpo', conv_id, turn, 0, '提示: ' || q || E'\\n\\n首选回答: ' || r FROM trimmed
  UNION ALL SELECT 'human', 'conversation', conv_id, turn, 0, '人类: ' || q || E'\\n\\n助手: ' || r FROM trimmed
  UNION ALL SELECT 'io', 'conversation', conv_id, turn, 0, '输入: ' || q || E'\\n\\n输出: ' || r FROM trimmed
  UNION ALL SELECT 'messages', 'conversation', conv_id, turn, 0,
    E'系统: s\\n\\n用户: ' || q || E'\\n\\n助手: ' || rt FROM trimmed
  UNION ALL SELECT 'from', 'conversation', conv_id, turn, 0, 'human: ' || q || E'\\n\\ntool: ' || rt FROM trimmed
  UNION ALL SELECT 'dialog', 'conversation', conv_id, turn, 0, 'dialog: ' || q || E'\\n\\nnote: ' || rt FROM trimmed
  UNION ALL SELECT 'talk_object', 'conversation', conv_id, turn, 0, E'role: user\\n\\ncontent: ' || qt FROM trimmed
  UNION ALL SELECT 'talk_object', 'conversation', conv_id, turn, 1, E'role: assistant\\n\\ncontent: ' || rt FROM trimmed
  UNION ALL SELECT 'plain_object', 'object', conv_id, turn, 0, 'title: ' || q || E'\\n\\n'
    || CASE WHEN length('body: ' || r) >= 8 THEN E'more:\\nbody: ' || rt || E'\\n\\n' ELSE '' END
    || E'tags:\\n- ' || q || E'\\n- x' FROM trimmed
  UNION ALL SELECT 'generic_list', 'generic', conv_id, turn, 0, 'topic: first item' FROM trimmed
  UNION ALL SELECT 'generic_list', 'generic', conv_id, turn, 1, 'deep text here' FROM trimmed
  UNION ALL SELECT 'generic_list', 'generic', conv_id, turn, 2, 'v: ' || rt FROM trimmed WHERE length('v: ' || r) >= 8)
"""


@query("dataset_texts", _TEXTS_SQL + "SELECT kind, format, conv_id, turn, chunk_index, content FROM texts")
def dataset_texts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = explode_datasets(dataset_texts(_pairs(spark, sf_dir)))
    return texts.select("kind", "format", "conv_id", "turn", "chunk_index", "content")


@query(
    "dataset_stats",
    _TEXTS_SQL
    + """, n AS (SELECT count(*) AS n FROM pairs),
items AS (
  SELECT unnest([{f: 'alpaca', c: 6}, {f: 'cot', c: 2}, {f: 'dpo', c: 2}, {f: 'conversation', c: 7},
                 {f: 'object', c: 1}, {f: 'generic', c: 5}, {f: NULL, c: 2}], recursive := true)),
added AS (SELECT format, count(*) AS added FROM texts GROUP BY format)
SELECT f AS format, (c * n)::BIGINT AS items, coalesce(added, 0) AS added,
  greatest(c * n - coalesce(added, 0), 0)::BIGINT AS skipped
FROM items CROSS JOIN n LEFT JOIN added ON f = format
""",
)
def dataset_stats_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_stats(dataset_texts(_pairs(spark, sf_dir)).select("text"))


@query(
    "json_generic",
    """
SELECT o_orderkey, 'status: ' || o_orderstatus || E'\\n\\nmeta:\\npriority: ' || o_orderpriority
  || E'\\n\\nlist:\\n- ' || o_orderpriority || E'\\n- end' AS content
FROM orders
""",
)
def json_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested object per order; numbers and blank texts leave no trace."""
    row = _json(
        status=F.col("o_orderstatus"),
        price=F.col("o_totalprice"),
        meta=F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("key")),
        blank=F.lit("  "),
        list=F.array(F.col("o_orderpriority"), F.lit("end")),
    )
    orders = spread(table(spark, sf_dir, "orders")).select("o_orderkey", row.alias("text"))
    return explode_datasets(orders).select("o_orderkey", "content")


@query(
    "json_detect",
    """
WITH t AS (
  SELECT event_id, unnest(['object', 'list', 'cut', 'bare', 'spaced']) AS kind,
    unnest([props, '[' || props || ']', props[1:length(props) - 1], event_type, E' \\n' || props || ' ']) AS text FROM events)
SELECT event_id, kind, kind IN ('object', 'list', 'spaced') AS is_json FROM t
""",
)
def json_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.col("props")
    forms = _forms(
        {
            "object": props,
            "list": F.concat(F.lit("["), props, F.lit("]")),
            "cut": F.left(props, F.length(props) - 1),
            "bare": F.col("event_type"),
            "spaced": F.concat(F.lit(" \n"), props, F.lit(" ")),
        }
    )
    texts = table(spark, sf_dir, "events").select("event_id", F.inline(forms))
    return texts.select("event_id", "kind", is_json_content(F.col("text")).alias("is_json"))


@query(
    "json_repair",
    """
SELECT event_id, '[' || props || ']' AS repaired, '[' || props[1:length(props) - 1] AS beyond_repair FROM events
""",
)
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list without its end is closed whatever its length; one cut inside an element stays as it is."""
    props = F.col("props")
    return table(spark, sf_dir, "events").select(
        "event_id",
        close_truncated_array(F.concat(F.lit("["), props)).alias("repaired"),
        close_truncated_array(F.concat(F.lit("["), F.left(props, F.length(props) - 1))).alias("beyond_repair"),
    )


@query(
    "dataset_edges",
    f"""
WITH {PAIRS_SQL}, sized AS (SELECT conv_id, turn, unnest([3 + conv_id % 4, 1200])::INTEGER AS n, r FROM pairs)
SELECT 'repeated_key' AS kind, conv_id, turn, 0 AS n, 1 AS texts, E'指令: x\\n\\n输出: ' || r AS first_text FROM pairs
UNION ALL SELECT 'wide_blank', conv_id, turn, 0, 1, E'name: \u3000\n\nlist:\n- ' || q FROM pairs
UNION ALL SELECT 'star', conv_id, turn, n, n, E'指令: STAR\n\n输出: ' || r[1] FROM sized
""",
)
def dataset_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of a repeated key, a field of U+3000, short STAR items in small and large sets of every pair."""
    pairs = _pairs(spark, sf_dir)
    quoted = lambda c: F.to_json(F.struct(c.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)
    repeated = F.concat(F.lit('[{"instruction": "x", "output": "first", "output": '), quoted(F.col("r")), F.lit("}]"))
    wide = _json(name=F.lit("\u3000"), list=F.array("q"))
    star = F.concat(F.lit("["), F.array_join(F.array_repeat(_json(instruction=F.lit("STAR"), output=F.left("r", F.lit(1))), F.col("n")), ","), F.lit("]"))
    texts = pairs.select("conv_id", "turn", F.lit(0).alias("n"), F.inline(_forms({"repeated_key": repeated, "wide_blank": wide})))
    sized = pairs.select("conv_id", "turn", "r", F.explode(F.array((3 + F.col("conv_id") % 4).cast("int"), F.lit(1200))).alias("n"))
    # A large set is much work from a short row: dealt out by rows, since tasks of even bytes would be few.
    sized = sized.repartition(4 * spark.sparkContext.defaultParallelism)
    texts = texts.unionByName(sized.select("conv_id", "turn", "n", F.lit("star").alias("kind"), star.alias("text")))
    found = explode_datasets(texts)
    return found.groupBy("kind", "conv_id", "turn", "n").agg(
        F.count("*").cast("int").alias("texts"), F.max_by("content", -F.col("chunk_index")).alias("first_text")
    )


@query(
    "unread_datasets",
    f"""
WITH {PAIRS_SQL}
SELECT 'bare' AS kind, conv_id, turn, 'not valid JSON, nested too deeply, or a number too long' AS reason FROM pairs
UNION ALL SELECT 'cut', conv_id, turn, 'not valid JSON, nested too deeply, or a number too long' FROM pairs
""",
)
def unread_datasets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in brackets that are no JSON are listed with a reason; whole ones and plain texts are not."""
    whole = _list(_json(instruction=F.col("q"), output=F.col("r")))
    forms = {"whole": whole, "bare": F.concat(F.lit("[x "), F.col("q"), F.lit("]")), "cut": F.concat(F.left(whole, F.length(whole) - 3), F.lit("]")), "plain": F.col("r")}
    texts = _pairs(spark, sf_dir).select("conv_id", "turn", F.inline(_forms(forms)))
    return unread_datasets(texts).select("kind", "conv_id", "turn", "reason")


@query(
    "broken_instruction_file",
    f"""
WITH {PAIRS_SQL}, l AS (SELECT conv_id, turn, translate(q, E'\\n"', ' ') AS q, translate(r, E'\\n"', ' ') AS r FROM pairs)
SELECT conv_id, turn, 0 AS pos, 'Instruction: ' || q || E'\\n\\nOutput: ' || r AS item FROM l
UNION ALL SELECT conv_id, turn, 1, 'Instruction: ' || r || E'\\n\\nOutput: 12' FROM l
""",
)
def broken_instruction_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items per text, one per line, in a file that does not parse."""
    flat = lambda c: F.translate(c, '\n"', " ")
    q, r = flat(F.col("q")), flat(F.col("r"))
    text = F.concat(
        F.lit('[{\n  "instruction": "'), q, F.lit('",\n "output": "'), r, F.lit('"\n}, {{\n "instruction": "'), r,
        F.lit('",\n "response": 12,\n'),
    )
    items = _pairs(spark, sf_dir).select("conv_id", "turn", broken_alpaca_items(text).alias("i"))
    return items.select("conv_id", "turn", F.posexplode("i").alias("pos", "item"))


@query(
    "route_texts",
    f"""
WITH {PAIRS_SQL}, texts AS (
  SELECT 'json' AS kind, conv_id, turn, regexp_replace(q, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS q,
    regexp_replace(r, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS r, '[{{"instruction":"' || q || '","output":"' || r || '"}}]' AS raw
  FROM (SELECT conv_id, turn, translate(q, '\\"', '') AS q, translate(r, '\\"', '') AS r FROM pairs)),
broken AS (
  SELECT conv_id, turn, trim(regexp_replace(raw[1:length(raw) - 2], '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS t FROM texts)
SELECT 'json' AS kind, conv_id, turn, 'dataset' AS route, 0 AS chunk_index, 1 AS total_chunks,
  '指令: ' || q || E'\\n\\n输出: ' || r AS content FROM texts
UNION ALL
SELECT 'broken', conv_id, turn, 'text', w::INTEGER, n::INTEGER, substr(t, w * 400 + 1, 500)
FROM (SELECT *, unnest(range(n)) AS w FROM (SELECT *, greatest(1, ceil((length(t) - 100) / 400))::BIGINT AS n FROM broken))
""",
)
def route_texts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole JSON goes to its formatter, JSON cut inside its last element to the windows."""
    plain = lambda c: F.translate(c, '\\"', "")
    whole = F.concat(
        F.lit('[{"instruction":"'), plain(F.col("q")), F.lit('","output":"'), plain(F.col("r")), F.lit('"}]')
    )
    pairs = _pairs(spark, sf_dir).select("conv_id", "turn", whole.alias("w"))
    forms = _forms({"json": F.col("w"), "broken": F.left("w", F.length("w") - 2)})
    name = F.when(F.col("kind") == "json", "a.json").otherwise("a.txt")
    files = pairs.select("conv_id", "turn", F.inline(forms)).withColumn("file_name", name)
    return route_texts(files, read_broken=False).drop("file_name")


@query(
    "file_kb",
    f"""
WITH {PAIRS_SQL}, t AS (
  SELECT conv_id, turn, regexp_replace(translate(q, '\\"', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS q,
    regexp_replace(translate(r, '\\"', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS r, translate(q, E'\\n\\\\"', ' ') AS lq, translate(r, E'\\n\\\\"', ' ') AS lr
  FROM pairs)
SELECT 'd' || conv_id || '-' || turn || '.json' AS source, '指令: ' || q || E'\\n\\n输出: ' || r AS content, 64 AS dimension,
  '{{"fileName":"d' || conv_id || '-' || turn || '.json","fileIndex":' || turn
    || ',"chunkIndex":0,"totalChunks":1,"extractionTime":1704067200000,"processingMethod":"JsonOptimized","source":"d' || conv_id || '-' || turn || '.json","created_at":1704067200000}}' AS metadata FROM t
UNION ALL
SELECT 'l' || conv_id || '-' || turn || '.json', 'Instruction: ' || lq || E'\\n\\nOutput: ' || lr, 64,
  '{{"fileName":"l' || conv_id || '-' || turn || '.json","fileIndex":' || turn
    || ',"chunkIndex":0,"totalChunks":1,"extractionTime":1704067200000,"processingMethod":"JsonOptimized","source":"l' || conv_id || '-' || turn || '.json","created_at":1704067200000}}' FROM t
""",
)
def file_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to stored rows: datasets by their formatter, broken ones by their lines, with the metadata of datasets."""
    q, r = F.col("q"), F.col("r")
    plain = lambda c: F.translate(c, '\\"', "")
    flat = lambda c: F.translate(c, '\n\\"', " ")
    whole = F.concat(F.lit('[{"instruction":"'), plain(q), F.lit('","output":"'), plain(r), F.lit('"}]'))
    lines = F.concat(F.lit('[{{\n"instruction": "'), flat(q), F.lit('",\n"output": "'), flat(r), F.lit('"\n'))
    files = _pairs(spark, sf_dir).select("conv_id", "turn", F.inline(_forms({"d": whole, "l": lines})))
    name = F.concat("kind", F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".json"))
    files = files.select("turn", "text", name.alias("file_name"), F.concat(F.lit("/files/"), name).alias("path"))
    rows = build_from_files(
        files, collection="files", file_index=F.col("turn"), created_at=F.timestamp_seconds(F.lit(1704067200))
    )
    path = scratch_path(spark, "file-kb")
    kb_table.overwrite(rows, path)
    return kb_table.read(spark, path).select("source", "content", "dimension", "metadata")
