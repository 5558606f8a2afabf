"""Text cleaning and scalar string functions, built from Spark SQL expressions but for the escapes of Chinese letters."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from kbweave.functions.udfs import once

# What Java's String.trim removes.
TRIM_CHARS = "".join(chr(c) for c in range(0x21))

ESCAPE = r"\\u[0-9a-fA-F]{4}"
# One or more escapes that together form valid text: no lone surrogate halves.
# Possessive, since a group repeated by a plain plus recurses once per repetition.
ESCAPE_RUN = (
    r"(?:\\u(?![dD][89a-fA-F])[0-9a-fA-F]{4}"
    r"|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})++"
)
# A backslash that starts none of these escapes.
OTHER_BACKSLASH = (
    r"\\(?!u(?![dD][89a-fA-F])[0-9a-fA-F]{4}"
    r"|u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    r"|(?<=\\u[dD][89abAB][0-9a-fA-F]{2}\\)u[dD][c-fC-F][0-9a-fA-F]{2})"
)
# Letters that are escaped, and ASCII, which the codec leaves as it is.
ASCII_OR_CHINESE = re.compile("[\x00-\x7f\u4e00-\u9fff]+")
FENCE = "```"


def trim_blank(text: Column) -> Column:
    """Strip every leading and trailing character up to U+0020."""
    return F.btrim(text, F.lit(TRIM_CHARS))


def is_blank(text: Column) -> Column:
    return text.isNull() | (trim_blank(text) == "")


def collapse_runs(text: Column) -> Column:
    """A character repeated eleven times or more keeps three copies."""
    return F.regexp_replace(text, r"(.)\1{10,}", "$1$1$1")


def clean_text(text: Column, unicode_ws: bool = False) -> Column:
    """Flatten whitespace, drop control and format characters, collapse runs, trim."""
    space = r"[\s\p{Z}]+" if unicode_ws else r"\s+"
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), space, " ")
    visible = F.regexp_replace(flat, r"[\p{Cntrl}&&[^\r\n\t]]|\p{Cf}", "")
    return trim_blank(collapse_runs(visible))


def contains_unicode_escapes(text: Column) -> Column:
    return F.coalesce(text.rlike(ESCAPE), F.lit(False))


def _rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Replace every match by a function of it: the texts between and the changed matches, woven."""
    between = F.split(text, pattern, -1)
    changed = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.zip_with(between, changed, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _read_as_json(text: Column) -> Column:
    """The text with its escapes read by the JSON reader, in one pass: all that is no such escape is escaped for JSON first."""
    kept = F.replace(F.regexp_replace(text, OTHER_BACKSLASH, r"\\\\"), F.lit('"'), F.lit('\\"'))
    options = {"allowUnquotedControlChars": "true", "maxStringLen": str(2**31 - 1)}
    return F.from_json(F.concat(F.lit('{"v":"'), kept, F.lit('"}')), "v string", options)["v"]


def decode_unicode_escapes(text: Column) -> Column:
    """Replace ``\\uXXXX`` by the character; halves of a pair that stand alone stay as they are."""
    decode = lambda run: F.decode(F.unhex(F.replace(run, F.lit("\\u"), F.lit(""))), "UTF-16BE")
    read = F.coalesce(_read_as_json(text), _rewrite(text, ESCAPE_RUN, decode))
    return F.when(contains_unicode_escapes(text), read).otherwise(text)


def decode_repeatedly(text: Column, extra_rounds: int = 3) -> Column:
    """Decode once and up to three times more; a round without escapes changes nothing."""
    # A fold binds each round's text to a variable; nested calls would repeat it per use.
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(extra_rounds)), text, lambda acc, _: decode_unicode_escapes(acc)
    )


def encode_chinese(text: Column) -> Column:
    """Write U+4E00 to U+9FFF as lower-case ``\\uxxxx``."""

    @once("string")
    def encode(texts: pa.Array) -> pa.Array:
        plain = [None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]
        escaped = lambda run: run[0].encode("ascii", "backslashreplace").decode("ascii")
        return pa.array([None if t is None else ASCII_OR_CHINESE.sub(escaped, t) for t in plain], pa.string())

    return encode(text)


def decode_and_strip(text: Column) -> Column:
    """Decode escapes, then drop C0 controls except TAB, LF and CR, and DEL."""
    return F.regexp_replace(decode_unicode_escapes(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def estimate_tokens(text: Column) -> Column:
    size = F.length(text)
    return (
        F.when(text.isNull() | (size == 0), 0)
        .otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int")))
        .cast("int")
    )


def prompt_budget(text: Column, max_sequence: int) -> Column:
    wanted = F.greatest(F.lit(512), (F.floor(F.length(text) / 4) + 100).cast("int"))
    return F.least(wanted, F.lit(max_sequence))


def prompt_too_long(text: Column, limit: int = 4000) -> Column:
    return F.length(text) > limit


def add_thinking_suffix(text: Column, thinking: bool) -> Column:
    marker = "/think" if thinking else "/no_think"
    return F.when(F.contains(text, F.lit(marker)), text).otherwise(F.concat(text, F.lit("\n" + marker)))


def count_occurrences(text: Column, pattern: str) -> Column:
    """Non-overlapping occurrences; nothing is found in or by an empty string."""
    if not pattern:
        return F.lit(0)
    removed = F.length(text) - F.length(F.replace(text, F.lit(pattern), F.lit("")))
    return F.coalesce((removed / len(pattern)).cast("int"), F.lit(0))


def has_open_fence(text: Column) -> Column:
    """An odd number of fences that open a line, follow a blank, or sit within four of a newline."""
    marker = r"(?:(?<![\s\S])|(?<=[\n \t])|(?<=\n[\s\S]{0,3}))(?=```)"
    return F.coalesce(F.regexp_count(text, F.lit(marker)) % 2 != 0, F.lit(False))


def fix_code_blocks(text: Column) -> Column:
    """Close an odd code fence, then an odd lone backtick (one not within two of a fence start)."""
    fences = F.regexp_count(text, F.lit(r"(?=```)"))
    lone = F.regexp_count(text, F.lit(r"(?<!``)`(?!``)(?!(?<=``)`)(?![\s\S]```)"))
    return F.concat(
        text,
        F.when(fences % 2 != 0, "\n" + FENCE).otherwise(""),
        F.when(lone % 2 != 0, "`").otherwise(""),
    )


def valid_utf8(data: Column) -> Column:
    return F.is_valid_utf8(data)


def mask_secret(secret: Column) -> Column:
    return (
        F.when(secret.isNull() | (secret == ""), "")
        .when(F.length(secret) <= 8, "****")
        .otherwise(F.concat(F.left(secret, F.lit(4)), F.lit("..."), F.right(secret, F.lit(4))))
    )


def preview(text: Column, size: int) -> Column:
    """The first ``size`` characters with an ellipsis when something was cut."""
    return F.when(F.length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def fixed_decimals(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value)


def duration_hms(millis: Column) -> Column:
    seconds = F.floor(millis / 1000)
    return F.format_string(
        "%02d:%02d:%02d",
        F.floor(seconds / 3600),
        F.floor(seconds / 60) % 60,
        seconds % 60,
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_office_document(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike(r"\.(docx?|xlsx?|pptx?)\z"), F.lit(False))


def is_pdf_document(name: Column) -> Column:
    return F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def ignores_min_size(name: Column) -> Column:
    """JSON files of the datasets whose items are kept however short they are."""
    return F.lower(name).endswith(".json") & name.rlike("datasets-sb|alpaca|STAR|star")
