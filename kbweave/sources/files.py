"""File sets: scan, dispatch by type, extraction with an error column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kbweave.functions.text import clean_text, file_name, is_blank, is_office_document, is_pdf_document
from kbweave.sources.office import extract_office


def scan_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """``path, file_name, length, content`` of every file, folders included."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    return files.select("path", file_name(F.col("path")).alias("file_name"), "length", "content")


def route_of(name: Column) -> Column:
    """Which reader a file takes."""
    return F.when(is_office_document(name), "office").when(is_pdf_document(name), "pdf").otherwise("text")


def extract_files(files: DataFrame, clean: bool = True) -> DataFrame:
    """``path, file_name, text, error``: the text, cleaned on request, or the reason there is none.

    A build cleans by itself and reads broken datasets by their line ends: give it the text as it is.

    Office files go through the parser; for all others the UDF sees NULL and the
    bytes are decoded in the JVM. Text read as office or as plain file is cleaned alike.
    """
    route = route_of(F.col("file_name"))
    office = extract_office(F.col("file_name"), F.when(route == "office", F.col("content")))
    parsed = files.withColumn("_route", route).withColumn("_office", office)
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(F.col("_route") == "office", F.col("_office.text")).when(F.col("_route") == "text", plain)
    error = F.when(F.col("_route") == "pdf", "unsupported file type").otherwise(F.col("_office.error"))
    return parsed.select(
        "path",
        "file_name",
        (F.when(text.isNotNull(), clean_text(text)) if clean else text).alias("text"),
        error.alias("error"),
    )


def usable(extracted: DataFrame) -> DataFrame:
    """Files with text."""
    return extracted.where(F.col("error").isNull() & ~is_blank(F.col("text")))


def quarantine(extracted: DataFrame) -> DataFrame:
    """Files whose extraction failed, with the reason."""
    return extracted.where(F.col("error").isNotNull()).select("path", "file_name", "error")


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, file_name, text`` of UTF-8 files, uncleaned."""
    lines = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("text"),
    )
