"""Line sources: log files and captured response streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_HEADER = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3} [^/ \n]+/[^\n]*?: "
DATA_PREFIX = "data: "
DONE_LINE = "data: [DONE]"
DELTA_SCHEMA = "struct<choices:array<struct<delta:struct<content:string>>>>"


def format_log_line(ts: Column, level: Column, tag: Column, message: Column) -> Column:
    return F.format_string("%s %s/%s: %s", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), level, tag, message)


def parse_log_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """``ts, level, tag, message`` per entry; a text without a header is a message of its own.

    Only the test for a header is a pattern; the fields are cut at fixed places and at the first ``/`` and ``: ``.

    The lambdas bind a line and its parts to variables, and a filter on the fields stays above the generator: pushed below plain columns
    it would repeat, for every use of a field, all that the line is made from.
    """
    kept = [c for c in lines.columns if c != line]

    def fields(text: Column) -> Column:
        rest = F.substring(text, F.lit(25), F.length(text))
        slash = F.instr(rest, "/")
        return F.struct(
            text.alias("text"),
            F.coalesce(text.rlike(LOG_HEADER), F.lit(False)).alias("headed"),
            F.substring(rest, F.lit(1), slash - 1).alias("level"),
            F.substring(rest, slash + 1, F.length(rest)).alias("tagged"),
        )

    def entry(part: Column) -> Column:
        text, tagged = part["text"], part["tagged"]
        colon = F.instr(tagged, ": ")
        headed = lambda value: F.when(part["headed"], value)
        return F.struct(
            headed(F.try_to_timestamp(F.left(text, F.lit(23)), F.lit("yyyy-MM-dd HH:mm:ss.SSS"))).alias("ts"),
            headed(part["level"]).alias("level"),
            headed(F.nullif(F.substring(tagged, F.lit(1), colon - 1), F.lit(""))).alias("tag"),
            headed(F.substring(tagged, colon + 2, F.length(tagged))).otherwise(text).alias("message"),
        )

    return lines.select(*kept, F.inline_outer(F.transform(F.transform(F.array(line), fields), entry)))


def join_entries(lines: DataFrame, file: str, block: str, place: str, line: str = "value") -> DataFrame:
    """``file, value``: every entry with all its lines, joined with line ends.

    A line without a header belongs to the last header before it in its file. ``place`` orders the lines of a block, ``block`` the blocks of a
    file. Lines look for their header in their own block; what an entry continues from an earlier block is told by one row a block.
    Lines before a file's first header are entries of their own.
    """
    header = F.when(F.col(line).rlike(LOG_HEADER), F.struct(block, place))
    so_far = Window.partitionBy(file, block).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    own = lines.withColumn("_entry", F.last(header, ignorenulls=True).over(so_far))
    ends = lines.groupBy(file, block).agg(F.max(header).alias("_last"))
    earlier = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(file, block, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    entry = F.coalesce("_entry", "_carried", F.struct(block, place))
    found = own.join(ends, [file, block]).withColumn("_entry", entry)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(block, place, line))), lambda x: x[line])
    return found.groupBy(file, "_entry").agg(F.array_join(texts, "\n").alias(line)).drop("_entry")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all log files below ``path`` with all their lines: ``file, ts, level, tag, message``."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    return parse_log_lines(join_entries(lines, "file", "block", "place"))


def sse_content(line: Column) -> Column:
    """The text piece of one ``data: `` line; NULL for any other line, a bad one or one without text."""
    payload = F.substring(line, len(DATA_PREFIX) + 1, F.length(line))
    parsed = F.from_json(payload, DELTA_SCHEMA, {"mode": "PERMISSIVE"})
    content = F.get(parsed["choices"], F.lit(0))["delta"]["content"]
    return F.when(F.startswith(line, F.lit(DATA_PREFIX)) & (line != DONE_LINE), content)


def is_done(line: Column) -> Column:
    return line == DONE_LINE


def parse_sse(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines that carry text, with the text as ``content``."""
    kept = [c for c in lines.columns if c != line]
    return lines.select(*kept, sse_content(F.col(line)).alias("content")).where(F.col("content").isNotNull())


def sse_line(content: Column) -> Column:
    """The captured form of one text piece."""
    delta = F.struct(F.struct(content.alias("content")).alias("delta"))
    return F.concat(F.lit(DATA_PREFIX), F.to_json(F.struct(F.array(delta).alias("choices"))))
