"""JSON training datasets as text: detection and formatting in array expressions."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbweave.functions.chat import labelled_turn
from kbweave.functions.text import TRIM_CHARS, trim_blank
from kbweave.functions.udfs import once

FIELDS = "map<string,string>"


# --- shape of the text ---------------------------------------------------------


def has_json_shape(text: Column) -> Column:
    t = trim_blank(text)
    braces = F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))
    brackets = F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]"))
    return F.coalesce(braces | brackets, F.lit(False))


def is_json_content(text: Column) -> Column:
    """The text is one JSON object or array."""
    return has_json_shape(text) & F.try_parse_json(text).isNotNull()


def close_truncated_array(text: Column) -> Column:
    """An array whose closing bracket is missing gets one, if that makes it JSON; any length."""
    t = trim_blank(text)
    closed = F.concat(t, F.lit("]"))
    broken = F.startswith(t, F.lit("[")) & ~F.endswith(t, F.lit("]"))
    return F.when(broken & F.try_parse_json(closed).isNotNull(), closed).otherwise(text)


def json_problem(text: Column) -> Column:
    """Why a text with the shape of JSON is not read as JSON; NULL for all others."""
    broken = has_json_shape(text) & F.try_parse_json(text).isNull()
    return F.when(broken, F.lit("not valid JSON, nested too deeply, or a number too long"))


def _line_value(line: Column) -> Column:
    """The value after the first colon, without its quotes or a closing comma."""
    value = trim_blank(F.regexp_extract(line, r"^[^:]*:((?s).*)$", 1))
    quoted = value.rlike(r'^"(?s).*"')
    bare = F.regexp_replace(value, r",$", "")
    return F.when(quoted, F.regexp_extract(value, r'^"((?s).*)"', 1)).otherwise(bare)


def broken_alpaca_items(text: Column, min_size: int = 10) -> Column:
    """Line-by-line reading of an instruction file that does not parse."""
    mark = "\u0001"
    lines = F.transform(F.split(F.replace(text, F.lit(mark), F.lit("")), r"\n", -1), trim_blank)
    pieces = F.transform(
        lines,
        lambda l: F.when(
            F.contains(l, F.lit('"instruction"')), F.concat(F.lit(mark + "Instruction: "), _line_value(l), F.lit("\n\n"))
        )
        .when(
            F.contains(l, F.lit('"output"')) | F.contains(l, F.lit('"response"')),
            F.concat(F.lit("Output: "), _line_value(l)),
        )
        .otherwise(""),
    )
    items = F.split(F.array_join(pieces, ""), mark, -1)
    return F.filter(items, lambda i: (i != "") & (F.length(i) >= min_size))


# --- one element, given as a map of its fields ------------------------------------


def _has(m: Column, *names: str) -> Column:
    """Any of the fields is there, even if null."""
    found = F.lit(False)
    for name in names:
        found = found | F.map_contains_key(m, F.lit(name))
    return found


def _text(m: Column, name: str) -> Column:
    """The field as text; a JSON null reads as ``null``."""
    return F.coalesce(m[name], F.lit("null"))


def _first(m: Column, *names: str) -> Column:
    chain = F.when(_has(m, names[0]), _text(m, names[0]))
    for name in names[1:]:
        chain = chain.when(_has(m, name), _text(m, name))
    return chain.otherwise("")


def _labelled(label: str, value: Column, end: str = "\n\n") -> Column:
    return F.concat(F.lit(label + ": "), value, F.lit(end))


def is_alpaca(m: Column) -> Column:
    return _has(m, "instruction") & _has(m, "output", "response", "completion")


def is_cot(m: Column) -> Column:
    return _has(m, "question") & _has(m, "rationale", "reasoning", "chain_of_thought") & _has(m, "answer")


def is_dpo(m: Column) -> Column:
    return _has(m, "prompt", "instruction") & _has(m, "chosen") & _has(m, "rejected")


def is_conversation(m: Column) -> Column:
    return (
        _has(m, "conversations", "messages", "dialog")
        | (_has(m, "input") & _has(m, "output"))
        | (_has(m, "human") & _has(m, "assistant"))
    )


def dataset_format(first: Column) -> Column:
    """The format of a dataset, from its first element; NULL when that is no object."""
    return F.when(
        first.isNotNull(),
        F.when(is_alpaca(first), "alpaca")
        .when(is_cot(first), "cot")
        .when(is_dpo(first), "dpo")
        .when(is_conversation(first), "conversation")
        .otherwise("generic"),
    )


def alpaca_text(m: Column) -> Column:
    output = _first(m, "output", "response", "completion")
    return F.concat(
        F.when(_has(m, "instruction"), _labelled("指令", _text(m, "instruction"))).otherwise(""),
        F.when(_has(m, "input") & (_text(m, "input") != ""), _labelled("输入", _text(m, "input"))).otherwise(""),
        F.when(output != "", _labelled("输出", output, "")).otherwise(""),
        F.when(
            _has(m, "system") & (_text(m, "system") != ""),
            F.concat(F.lit("\n\n"), _labelled("系统", _text(m, "system"), "")),
        ).otherwise(""),
    )


def cot_text(m: Column) -> Column:
    reasoning = _first(m, "rationale", "reasoning", "chain_of_thought")
    return F.concat(
        F.when(_has(m, "question"), _labelled("问题", _text(m, "question"))).otherwise(""),
        F.when(reasoning != "", _labelled("推理过程", reasoning)).otherwise(""),
        F.when(_has(m, "answer"), _labelled("答案", _text(m, "answer"), "")).otherwise(""),
    )


def dpo_text(m: Column) -> Column:
    """Prompt and preferred answer; NULL if either is empty."""
    prompt, chosen = _first(m, "prompt", "instruction"), _first(m, "chosen")
    return F.when(
        (prompt != "") & (chosen != ""), F.concat(_labelled("提示", prompt), _labelled("首选回答", chosen, ""))
    )


def _pair_text(m: Column, left: str, left_label: str, right: str, right_label: str) -> Column:
    return F.concat(_labelled(left_label, _text(m, left)), _labelled(right_label, _text(m, right), ""))


def _messages(raw: Column) -> Column:
    return F.from_json(raw, f"array<{FIELDS}>")


def messages_text(messages: Column, with_from: bool) -> Column:
    """Untrimmed chat text of an array of field maps; ``from``/``value`` keep their raw label."""

    def turn(m: Column) -> Column:
        text = F.when(_has(m, "role") & _has(m, "content"), labelled_turn(_text(m, "role"), _text(m, "content")))
        if with_from:
            text = text.when(_has(m, "from") & _has(m, "value"), _labelled_by(_text(m, "from"), _text(m, "value")))
        return text.otherwise("")

    return F.array_join(F.transform(messages, turn), "")


def _labelled_by(label: Column, value: Column) -> Column:
    return F.concat(label, F.lit(": "), value, F.lit("\n\n"))


def _is_array(m: Column, name: str) -> Column:
    return _has(m, name) & F.coalesce(F.startswith(m[name], F.lit("[")), F.lit(False))


def conversation_kind(m: Column) -> Column:
    return (
        F.when(_is_array(m, "conversations"), "conversations")
        .when(_is_array(m, "messages"), "messages")
        .when(_has(m, "human") & _has(m, "assistant"), "pair")
        .when(_has(m, "input") & _has(m, "output"), "io")
        .otherwise("generic")
    )


def conversation_text(m: Column, min_size: int, ignore_min: Column) -> Column:
    """One conversation element; NULL if too short or left to the generic rule.

    Message lists are measured before they are trimmed and always obey the minimum.
    """
    kind = conversation_kind(m)
    listed = F.when(kind == "conversations", messages_text(_messages(m["conversations"]), True)).when(
        kind == "messages", messages_text(_messages(m["messages"]), False)
    )
    paired = F.when(kind == "pair", _pair_text(m, "human", "人类", "assistant", "助手")).when(
        kind == "io", _pair_text(m, "input", "输入", "output", "输出")
    )
    return F.when(F.length(listed) >= min_size, trim_blank(listed)).when(
        ignore_min | (F.length(paired) >= min_size), paired
    )


def has_special_name(first: Column) -> Column:
    """Instruction sets marked STAR keep items of any size, however many there are."""
    return F.coalesce(
        _has(first, "instruction")
        & _has(first, "output", "response")
        & F.contains(_text(first, "instruction"), F.lit("STAR")),
        F.lit(False),
    )


# --- generic JSON of any depth ----------------------------------------------------


def _object_text(obj: dict, min_size: int) -> str | None:
    """Text of an object; nested objects are finished first, from a stack of its own, so depth has no bound here."""
    done: dict[int, str | None] = {}
    stack = [(obj, False)]
    while stack:
        node, ready = stack.pop()
        inner = [v for v in node.values() if isinstance(v, dict)]
        if not ready and inner:
            stack.append((node, True))
            stack.extend((v, False) for v in inner)
            continue
        parts = []
        for key, value in node.items():
            if isinstance(value, str) and value.strip(TRIM_CHARS):
                parts.append(f"{key}: {value}\n\n")
            elif isinstance(value, dict):
                nested = done.pop(id(value))
                if nested is not None:
                    parts.append(f"{key}:\n{nested}\n\n")
            elif isinstance(value, list) and value:
                items = "".join(f"- {item}\n" for item in value if isinstance(item, str))
                parts.append(f"{key}:\n{items}\n")
        text = "".join(parts)
        done[id(node)] = text.strip(TRIM_CHARS) if len(text) >= min_size else None
    return done[id(obj)]


def _generic_texts(value, min_size: int) -> list[str]:
    """Texts of a value in document order; lists may nest to any depth."""
    found: list[str] = []
    stack = [value]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            text = _object_text(item, min_size)
            if text is not None:
                found.append(text)
        elif isinstance(item, list):
            stack.extend(reversed(item))
        elif isinstance(item, str) and item is not value and item.strip(TRIM_CHARS) and len(item) >= min_size:
            found.append(item)
    return found


def generic_texts(documents: Column, min_size: int = 10) -> Column:
    """``array<array<string>>``: the texts of each JSON document, any depth; NULL for one that cannot be read.

    Key order and the difference between ``"5"`` and ``5`` decide the result, and
    nesting has no bound, so this one rule runs as an Arrow UDF.
    """

    @once("array<array<string>>")
    def texts(rows: pa.Array) -> pa.Array:
        def read(document: str | None) -> list[str] | None:
            try:
                return [] if document is None else _generic_texts(json.loads(document), min_size)
            except (ValueError, RecursionError):
                return None

        out = [None if row is None else [read(document) for document in row] for row in rows.to_pylist()]
        return pa.array(out, pa.list_(pa.list_(pa.string())))

    return texts(documents)


def object_fields(text: Column) -> Column:
    """A JSON object as a map of texts; of a repeated key the last value counts."""
    fields = F.from_json(text, FIELDS)

    def last_wins(m: Column) -> Column:
        entries = F.map_entries(m)
        final = lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"])
        return F.when(
            F.size(F.array_distinct(F.map_keys(m))) < F.size(m), F.map_from_entries(F.filter(entries, final))
        ).otherwise(m)

    return F.transform(F.array(fields), last_wins)[0]


# --- one element of a dataset that is read in pieces -------------------------------


def element_texts(element: Column, m: Column, kind: Column, any_size: Column, min_size: int) -> Column:
    """``array<string>``: the texts of one element of a dataset of this format, as :func:`format_datasets` has them."""
    sized = lambda value: F.when(any_size | (F.length(value) >= min_size), value)
    left_over = (kind == "conversation") & m.isNotNull() & (conversation_kind(m) == "generic")
    listed = F.concat(F.lit("["), element, F.lit("]"))
    generic = F.get(generic_texts(F.when(kind == "generic", F.array(listed)).when(left_over, F.array(element)), min_size), F.lit(0))
    one = (
        F.when(kind == "alpaca", sized(alpaca_text(m)))
        .when(kind == "cot", sized(cot_text(m)))
        .when(kind == "dpo", sized(dpo_text(m)))
        .when(kind == "conversation", conversation_text(m, min_size, any_size))
    )
    formatted = F.when(m.isNotNull() & one.isNotNull(), F.array(one))
    return F.coalesce(formatted, generic, F.array().cast("array<string>"))


# --- whole documents --------------------------------------------------------------


@dataclass(frozen=True)
class DatasetColumns:
    """Names of the columns :func:`format_datasets` adds."""

    format: str = "format"
    texts: str = "texts"
    items: str = "items"
    unread: str = "unread"


def format_datasets(
    df: DataFrame, text: str = "text", min_size: int = 10, ignore_min: Column | None = None,
    out: DatasetColumns = DatasetColumns(),
) -> DataFrame:
    """Add ``format``, ``items`` (elements seen), ``texts`` (formatted, in order) and ``unread`` (elements the generic
    rule could not read) to each JSON text.

    The unit is the text: its first element decides the format of all. Everything
    is an expression over that one row, so there is no shuffle and no join.
    Text that is not JSON gets a NULL format and no texts.
    """
    original = df.columns
    ignore = F.lit(False) if ignore_min is None else F.coalesce(ignore_min, F.lit(False))
    t = trim_blank(F.col(text))
    step = df.withColumn("_ignore", ignore).withColumn("_json", F.when(is_json_content(F.col(text)), t))
    is_array, is_object = F.startswith("_json", F.lit("[")), F.startswith("_json", F.lit("{"))
    step = step.withColumn("_top", F.when(is_object, object_fields(F.col("_json"))))
    top = F.col("_top")
    wrapped = F.lit(None).cast("string")
    for name in ("examples", "conversations", "data"):
        wrapped = F.when(_is_array(top, name), top[name]).otherwise(wrapped)
    talks = is_object & ~_is_array(top, "data") & _is_array(top, "conversations")
    step = step.withColumn("_list", F.when(is_array, F.col("_json")).otherwise(wrapped)).withColumn(
        "_talks", F.coalesce(talks, F.lit(False))
    )
    step = step.withColumn("_elements", F.from_json("_list", "array<string>")).withColumn(
        "_maps", F.transform("_elements", object_fields)
    )
    first = F.get("_maps", F.lit(0))
    detected = (
        F.when(F.col("_list").isNull() & is_object, "object")
        .when(F.col("_talks"), "conversation")
        .otherwise(dataset_format(first))
    )
    step = step.withColumn("_format", detected).withColumn(
        "_any_size", F.col("_ignore") | has_special_name(first)
    )
    kind = F.col("_format")
    leftovers = F.transform(
        F.arrays_zip(F.col("_elements").alias("e"), F.col("_maps").alias("m")),
        lambda p: F.when(p["m"].isNotNull() & (conversation_kind(p["m"]) == "generic"), p["e"]),
    )
    step = step.withColumn(
        "_generic",
        generic_texts(
            F.when(kind == "object", F.array("_json"))
            .when(kind == "generic", F.array("_list"))
            .when(kind == "conversation", leftovers),
            min_size,
        ),
    )
    any_size = F.col("_any_size")

    def sized(value: Column) -> Column:
        return F.when(any_size | (F.length(value) >= min_size), value)

    def each(formatter) -> Column:
        return F.transform("_maps", lambda m: F.when(m.isNotNull(), F.array(sized(formatter(m)))))

    talk = F.zip_with(
        F.transform("_maps", lambda m: F.when(m.isNotNull(), conversation_text(m, min_size, any_size))),
        "_generic",
        lambda a, b: F.coalesce(F.when(a.isNotNull(), F.array(a)), b),
    )
    nested = (
        F.when(kind == "alpaca", each(alpaca_text))
        .when(kind == "cot", each(cot_text))
        .when(kind == "dpo", each(dpo_text))
        .when(kind == "conversation", talk)
        .otherwise(F.col("_generic"))
    )
    flat = F.flatten(F.filter(nested, lambda a: a.isNotNull()))
    texts = F.filter(flat, lambda x: x.isNotNull())
    return step.select(
        *original,
        F.col("_format").alias(out.format),
        F.when(kind == "object", 1).otherwise(F.coalesce(F.size("_elements"), F.lit(0))).alias(out.items),
        F.coalesce(texts, F.array().cast("array<string>")).alias(out.texts),
        F.when(kind.isin("object", "generic"), F.coalesce(F.size(F.filter("_generic", lambda a: a.isNull())), F.lit(0)))
        .otherwise(0)
        .alias(out.unread),
    )
