"""File, office and log sources over content derived from the tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.functions.udfs import once
from kbweave.operators.answers import filter_log, level_rank
from kbweave.plans.registry import query, table
from kbweave.session import scratch_path, spread
from kbweave.sources.files import extract_files, quarantine, scan_files, usable
from kbweave.sources.office import A, P, R, REL, S, W
from kbweave.sources.streams import format_log_line, join_entries, parse_log_lines

# --- logs ----------------------------------------------------------------------------

_LOG_SQL = """
l AS (SELECT event_id, date_trunc('milliseconds', ts) AS ts, CASE event_type WHEN 'error' THEN 'E' WHEN 'view' THEN 'D'
  WHEN 'signup' THEN 'W' ELSE 'I' END AS level, event_type AS tag, 'user ' || user_id || E'\\n at: /x ' || props AS message FROM events)
"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a log entry with a second line."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "E").when(kind == "view", "D").when(kind == "signup", "W").otherwise("I")
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit("\n at: /x "), F.col("props"))
    return spread(table(spark, sf_dir, "events")).select(
        "event_id", format_log_line(F.col("ts").cast("timestamp"), level, kind, message).alias("value")
    )


@query("log_parse", f"WITH {_LOG_SQL} SELECT event_id, ts, level, tag, message FROM l")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_log_lines(log_lines(spark, sf_dir))


@query(
    "log_filter",
    f"""
WITH {_LOG_SQL}, r AS (SELECT *, CASE level WHEN 'D' THEN 1 WHEN 'I' THEN 2 WHEN 'W' THEN 3 ELSE 4 END AS level_rank FROM l)
SELECT event_id, level_rank, tag FROM r WHERE level_rank >= 3 AND tag = 'error' AND ts >= TIMESTAMP '2024-01-02'
""",
)
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = parse_log_lines(log_lines(spark, sf_dir))
    found = filter_log(logs, start="2024-01-02 00:00:00", min_level="WARNING", tag="error")
    return found.select("event_id", level_rank(F.col("level")).alias("level_rank"), "tag")


@query("log_continuation", f"WITH {_LOG_SQL} SELECT event_id, ts, level, tag, message FROM l")
def log_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line by line in blocks of one line, so that every second line finds its header in an earlier block."""
    lines = log_lines(spark, sf_dir).select("event_id", F.posexplode(F.split("value", "\n")).alias("block", "value"))
    return parse_log_lines(join_entries(lines.withColumn("place", F.lit(0)), "event_id", "block", "place"))


# --- files ---------------------------------------------------------------------------


def _package(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in parts.items():
            archive.writestr(name, content)
    return buffer.getvalue()


def _rels(*targets: str) -> str:
    items = "".join(f'<Relationship Id="r{i}" Target="{t}"/>' for i, t in enumerate(targets))
    return f'<Relationships xmlns="{REL[1:-1]}">{items}</Relationships>'


def make_docx(lines: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    return _package({"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'})


def make_xlsx(lines: list[str], number: int) -> bytes:
    rows = "".join(
        f'<row><c t="inlineStr"><is><t>{escape(x)}</t></is></c><c/><c><v>{number}</v></c><c t="b"><v>1</v></c></row>'
        for x in lines
    )
    return _package(
        {
            "xl/workbook.xml": f'<workbook xmlns="{S[1:-1]}" xmlns:r="{R[1:-1]}"><sheets>'
            '<sheet name="one" r:id="r0"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": _rels("worksheets/s1.xml"),
            "xl/worksheets/s1.xml": f'<worksheet xmlns="{S[1:-1]}"><sheetData>{rows}</sheetData></worksheet>',
        }
    )


def make_pptx(lines: list[str]) -> bytes:
    runs = "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in lines)
    return _package(
        {
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{P[1:-1]}" xmlns:r="{R[1:-1]}"><p:sldIdLst>'
            '<p:sldId r:id="r0"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": _rels("slides/slide1.xml"),
            "ppt/slides/slide1.xml": f'<p:sld xmlns:p="{P[1:-1]}" xmlns:a="{A[1:-1]}">{runs}</p:sld>',
        }
    )


def office_bytes(kind: Column, text: Column, number: Column) -> Column:
    """Office files that hold the lines of a text."""

    @once("binary")
    def make(kinds: pa.Array, texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for k, t, n in zip(kinds.to_pylist(), texts.to_pylist(), numbers.to_pylist()):
            lines = t.split("\n")
            if k == "docx":
                out.append(make_docx(lines))
            elif k == "xlsx":
                out.append(make_xlsx(lines, n))
            elif k == "pptx":
                out.append(make_pptx(lines))
            else:
                out.append(t.encode())
        return pa.array(out, pa.binary())

    return make(kind, text, number)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a file: by its number a docx, xlsx, pptx, plain text, pdf, or a docx that is none."""
    kinds = F.array(*map(F.lit, ("docx", "xlsx", "pptx", "txt", "pdf", "bad")))
    turns = spread(table(spark, sf_dir, "conversations")).select(
        "conv_id",
        "turn",
        F.regexp_replace("text", r"[\x00-\x08\x0B-\x1F]", "").alias("text"),
        F.element_at(kinds, ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int")).alias("kind"),
    )
    name = F.format_string("%d-%d.%s", "conv_id", "turn", F.replace("kind", F.lit("bad"), F.lit("docx")))
    return turns.select(
        F.concat(F.lit("/files/"), name).alias("path"),
        name.alias("file_name"),
        office_bytes(F.col("kind"), F.col("text"), F.col("turn")).alias("content"),
    )


_FILES_SQL = """
f AS (
  SELECT ['docx', 'xlsx', 'pptx', 'txt', 'pdf', 'bad'][(conv_id + turn) % 6 + 1] AS kind, turn, conv_id || '-' || turn || '.' AS stem,
    regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g') AS text FROM conversations),
x AS (
  SELECT stem || replace(kind, 'bad', 'docx') AS file_name, kind, CASE kind
    WHEN 'xlsx' THEN '工作表: one ' || list_aggregate(list_transform(string_split(text, E'\\n'), lambda l:
      CASE WHEN trim(l, E' \\t') = '' THEN '' ELSE l || ' ' END || turn || '.0 true '), 'string_agg', '')
    WHEN 'pptx' THEN '幻灯片 1: ' || text ELSE text END AS text FROM f)
"""


@query(
    "office_extract",
    f"""
WITH {_FILES_SQL}
SELECT file_name, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS text FROM x
WHERE kind NOT IN ('pdf', 'bad') AND trim(text, E' \\n\\t\\r') <> ''
""",
)
def office_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Office and plain files through the dispatcher."""
    return usable(extract_files(document_files(spark, sf_dir))).select("file_name", "text")


@query(
    "file_quarantine",
    f"""
WITH {_FILES_SQL}
SELECT file_name, '/files/' || file_name AS path,
  CASE kind WHEN 'pdf' THEN 'unsupported file type' ELSE 'BadZipFile: File is not a zip file' END AS error
FROM x WHERE kind IN ('pdf', 'bad')
""",
)
def file_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without text, with the reason."""
    return quarantine(extract_files(document_files(spark, sf_dir)))


@query(
    "file_scan",
    "SELECT source, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS bytes, true AS folders, true AS named FROM documents GROUP BY source",
)
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in a folder for each source, found again with their sizes, folders included."""
    path = scratch_path(spark, "files")
    documents = spread(table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")))
    documents.write.partitionBy("source").text(path)
    files = scan_files(spark, path, "part-*")
    source = F.regexp_extract("path", "/source=([^/]*)/[^/]*$", 1)
    return files.groupBy(source.alias("source")).agg(
        F.sum("length").alias("bytes"), F.bool_and(F.contains("path", F.lit("/source="))).alias("folders"),
        F.bool_and(F.endswith("path", F.concat(F.lit("/"), F.col("file_name")))).alias("named"),
    )
