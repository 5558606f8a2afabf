"""WARC files as a Spark data source written in Python.

Reading: one partition a file, planned by listing the folder; predicates on record type and headers are pushed down. A record's headers are parsed
first; if a predicate fails, or the ``payload`` option says that its type is not wanted, the payload is skipped by seeking and never decoded.
Writing: each task writes files of bounded size under a temporary name, the commit gives them their names.

Paths are anything ``pyarrow.fs`` opens, so files can be on the shared store of a cluster.
"""

from __future__ import annotations

import base64
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from kbweave.llm.common import bounded

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length long, refers_to string, payload binary"
ROLL_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
MIN_REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in SCHEMA.split(", "))])


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record_bytes(row: dict) -> bytes:
    """One record; headers whose value is null are left out. The digest is stored in base 32, as usual."""
    payload = row["payload"] or b""
    head = [VERSION.decode(), f"WARC-Type: {row['record_type']}", f"WARC-Date: {DATE}"]
    if row["record_id"] is not None:
        head.append(f"WARC-Record-ID: <{_line(row['record_id'])}>")
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    if row["payload_digest"] is not None:
        head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode())
    if row["refers_to"] is not None:
        head += [f"WARC-Refers-To: <{_line(row['refers_to'])}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    if row["payload_length"] is not None:
        head.append(f"X-Payload-Length: {row['payload_length']}")
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    """Header names in lower case with their values; a line without a colon is left out."""
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def header_values(headers: dict[str, str]) -> dict:
    """The columns that headers give; the digest as bare lower-case hex."""
    out = {name: headers.get(header.lower()) for name, header in HEADERS.items()}
    for name in ("record_id", "refers_to"):
        if out[name] is not None:
            out[name] = out[name].removeprefix("<").removesuffix(">")
    if out["payload_digest"] is not None:
        kind, _, value = out["payload_digest"].partition(":")
        out["payload_digest"] = base64.b32decode(value).hex() if kind == "sha1" else out["payload_digest"]
    out["payload_length"] = int(out["payload_length"]) if out["payload_length"] is not None else None
    return out


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:///{path}")
    return fs, inner


@dataclass
class WarcFile(InputPartition):
    path: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload_types: frozenset[str] | None):
        self.path, self.payload_types = path, payload_types
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and null tests of header columns; the others go back to Spark."""
        for test in filters:
            name = getattr(test, "attribute", ("",))
            known = len(name) == 1 and name[0] in HEADERS
            if known and isinstance(test, EqualTo):
                self.tests.append(("in", name[0], (test.value,)))
            elif known and isinstance(test, In):
                self.tests.append(("in", name[0], tuple(test.value)))
            elif known and isinstance(test, IsNull):
                self.tests.append(("null", name[0], True))
            elif known and isinstance(test, IsNotNull):
                self.tests.append(("null", name[0], False))
            else:
                yield test

    def passes(self, values: dict) -> bool:
        return all(values[name] in wanted if kind == "in" else (values[name] is None) == wanted for kind, name, wanted in self.tests)

    def partitions(self) -> list[InputPartition]:
        fs, inner = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(inner, recursive=False))
        return [WarcFile(f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.base_name.endswith(".warc")]

    def records(self, source: pa.NativeFile, size: int) -> Iterator[dict]:
        at, held, start = 0, b"", 0  # held: bytes from start on
        while at < size:
            while True:
                end = held.find(b"\r\n\r\n", at - start)
                if end >= 0 or start + len(held) >= size:
                    break
                more = source.read(1 << 16)
                if not more:
                    break
                held += more
            if end < 0 or not held.startswith(b"WARC/", at - start):
                raise ValueError(f"no record at byte {at} of {self.path}")
            headers = parse_headers(held[at - start : end])
            values, length = header_values(headers), int(headers["content-length"])
            body = start + end + 4
            at = body + length + 4
            if self.passes(values):
                wanted = self.payload_types is None or values["record_type"] in self.payload_types
                if wanted:
                    missing = body + length - start - len(held)
                    if missing > 0:
                        held += source.read(missing)
                    values["payload"] = held[body - start : body - start + length]
                else:
                    values["payload"] = None
                yield values
            if at >= start + len(held):
                source.seek(min(at, size))
                held, start = b"", at
            elif at - start > 1 << 20:
                held, start = held[at - start :], at

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        """Records of one file; Spark asks for a partition without a value if the folder holds no file."""
        if partition is None:
            return
        schema = _arrow_schema()
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.path) as source:
            rows, held = [], 0
            for values in self.records(source, partition.size):
                rows.append(values)
                held += len(values["payload"] or b"") + 500
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, inner = filesystem(self.path)
        fs.create_dir(inner, recursive=True)
        files: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc")
                    out, size = fs.open_output_stream(posixpath.join(inner, "_" + files[-1] + ".part")), 0
                data = record_bytes(row)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = filesystem(self.path)
        fs.create_dir(inner, recursive=True)
        for message in messages:
            for name in message.files if message else ():
                fs.move(posixpath.join(inner, "_" + name + ".part"), posixpath.join(inner, name))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, inner = filesystem(self.path)
        for message in messages:
            for name in message.files if message else ():
                fs.delete_file(posixpath.join(inner, "_" + name + ".part"))


class WarcDataSource(DataSource):
    """Format ``warc``: options ``path``, and ``payload``: ``all`` or record types, comma-separated, whose payloads are read."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        wanted = self.options.get("payload", "all")
        return WarcReader(self.options["path"], None if wanted == "all" else frozenset(wanted.split(",")))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known; predicates reach Python sources only with this setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame) -> DataFrame:
    """WARC records of ``page_id, url, html`` rows, a null html as an empty payload.

    Of equal payloads of at least 1000 bytes the row with the largest page_id is the response and the others are revisits of it, without payload;
    smaller payloads are all responses. A row without an id is a record without one; a repeated row with
    the largest id is a response each time.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    groups = rows.filter(F.col("payload_length") >= MIN_REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(bounded(groups.filter("n > 1 and first is not null").drop("n")), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("payload_length") >= MIN_REVISIT_BYTES)
    urn = lambda name: F.concat(F.lit("urn:page:"), F.col(name).cast("string"))
    return rows.select(
        urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        "payload_digest", "payload_length", F.when(again, urn("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str) -> None:
    """Write records (the columns of ``SCHEMA``) as WARC files below ``path``."""
    register(records.sparkSession)
    records.write.format("warc").option("path", path).mode("append").save()


def read(spark: SparkSession, path: str, payload: str = "all") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()
