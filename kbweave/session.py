"""Session helpers: shared scratch folder and plan-size estimates."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FALLBACK: dict[str, str] = {}
_SHIPPED: set[str] = set()
SPREAD_BYTES = 8 << 20
# A repeated key in JSON keeps its last value instead of making the text unreadable. Arrow batches of whole
# documents are kept short, so that a Python worker holds a few megabytes of text at a time.
SETTINGS = {
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: str = "*", app_name: str = "kbweave", **conf: str) -> SparkSession:
    """A local session with the settings used by the tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be invisible to the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.master.startswith("local"):
        if context.applicationId not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK[context.applicationId] = tempfile.mkdtemp(prefix="kbweave-")
        return _LOCAL_FALLBACK[context.applicationId]
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/kbweave/{label}-{uuid.uuid4().hex}"


def written_below_scratch(df: DataFrame, label: str) -> DataFrame:
    """The rows, written once below the shared folder and read back: nothing before them is computed again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Stored rows, marked for broadcast if they are counted to be few; else joins shuffle them."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; no job is started."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def estimated_scan_tasks(df: DataFrame) -> int:
    """How many tasks a scan-only plan of this size splits into."""
    conf = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "134217728b")
    digits = "".join(ch for ch in conf if ch.isdigit())
    unit = conf[len(digits):].strip().lower()
    scale = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    return estimated_bytes(df) // (int(digits) * scale[unit]) + 1


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor, and the session settings it needs."""
    context = spark.sparkContext
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="kbweave-zip-"), "kbweave")
    archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a small input one task per core, and more of them where a core's share is large.

    A file with one row group is one task however many cores there are. An input
    that already splits into enough tasks is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_scan_tasks(df) >= cores:
        return df
    return df.repartition(max(cores, estimated_bytes(df) // SPREAD_BYTES))
