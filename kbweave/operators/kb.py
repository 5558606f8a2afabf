"""Knowledge-base tables: Parquet partitioned by collection and by write batch.

A write replaces its own (collection, batch) partitions, so a build step or a
streaming batch that runs twice after a failure leaves one copy.

A reader sees a batch as a whole or not at all. While a write runs, and until its
dimensions are checked, a marker in ``_pending`` hides its label. An overwrite is
switched on by one folder in ``_commits``, which at once shows the new rows and hides the
partitions they replace; those are deleted by the next write or by :func:`purge`, so
readers that began before the switch finish on the old rows.

A stored row's key is (collection, batch, row_id): the write numbers its rows, so
notes, documents and repeated appends of the same documents share a table without
clashes. ``id`` stays what the build called the row and may repeat.
"""

from __future__ import annotations

import re
import uuid
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GUARD_BROADCAST_ROWS = 100_000
HIDDEN_FILTERS = 1000
PENDING, COMMITS, PURGED = "_pending", "_commits", "_purged"
KB_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("model", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("batch", T.StringType()),
    ]
)


# --- rows ------------------------------------------------------------------------


def source_of(metadata: Column) -> Column:
    """The ``source`` of a metadata text, ``unknown`` when it or the JSON is missing."""
    return F.coalesce(F.get_json_object(metadata, "$.source"), F.lit("unknown"))


def complete_metadata(metadata: Column, source: Column, created_millis: Column) -> Column:
    """Add ``source`` and ``created_at`` where missing; bad JSON starts from an empty object.

    The new fields are spliced in before the closing brace, so that the fields
    already there keep their JSON types.
    """
    keys = F.json_object_keys(metadata)
    body = F.when(keys.isNotNull(), F.regexp_extract(metadata, r"^\s*\{((?s).*)\}\s*$", 1)).otherwise("")
    known = F.coalesce(keys, F.array().cast("array<string>"))
    source_json = F.to_json(F.struct(source.alias("source")))
    extra = F.concat_ws(
        ",",
        F.when(F.rtrim(body) != "", body),
        F.when(
            ~F.array_contains(known, "source") & (F.coalesce(source, F.lit("")) != ""),
            F.substring(source_json, F.lit(2), F.length(source_json) - 2),
        ),
        F.when(
            ~F.array_contains(known, "created_at"),
            F.concat(F.lit('"created_at":'), created_millis.cast("bigint").cast("string")),
        ),
    )
    return F.concat(F.lit("{"), extra, F.lit("}"))


def storable(rows: DataFrame) -> DataFrame:
    """Rows with text and a vector."""
    return rows.where((F.col("content") != "") & (F.size("embedding") > 0))


# --- writing ---------------------------------------------------------------------


def _write(rows: DataFrame, path: str, batch: str, rebalance: bool, max_records_per_file: int) -> None:
    rows = rows if "model" in rows.columns else rows.withColumn("model", F.lit(None).cast("string"))
    stored = storable(rows).withColumns(
        {"batch": F.lit(batch), "dimension": F.size("embedding"), "row_id": F.monotonically_increasing_id()}
    ).select(*KB_SCHEMA.names)
    if rebalance:
        stored = stored.hint("rebalance", F.col("collection"))
    (
        stored.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy("collection", "batch")
        .parquet(path)
    )


def append(
    rows: DataFrame, path: str, batch: str, rebalance: bool = False, max_records_per_file: int = 500_000
) -> None:
    """Add rows under a batch label; the same label again replaces that batch's rows.

    A row of another dimension than its collection already has fails the write, as do two dimensions in the rows of one collection; the
    write then leaves nothing behind. Another model than the collection's own only warns.

    The write needs no shuffle. Where every task holds rows of many collections,
    ``rebalance`` shuffles them into fewer, even files; a collection that owns
    most rows is split over many tasks and small ones are joined.
    """
    spark = rows.sparkSession
    purge(spark, path)
    _put(spark, path, PENDING, batch)
    try:
        _write(guarded(rows, path, batch), path, batch, rebalance, max_records_per_file)
        _require_one_dimension(spark, path, batch, alone=False)
    except Exception:
        _remove_batch(spark, path, batch)
        raise
    finally:
        _take(spark, path, PENDING, batch)


def _require_one_dimension(spark: SparkSession, path: str, batch: str, alone: bool) -> None:
    """Fail if the written rows, with the other ones of their collections unless ``alone``, have several dimensions; warn of several models.

    Rows of writes that are still running count too: of two that began with different dimensions the later one fails.
    """
    everything = _stored(spark, path)
    mine = everything.where(F.col("batch") == batch)
    touched = everything.join(mine.select("collection").distinct(), "collection", "left_semi")
    facts = (mine if alone else touched).groupBy("collection").agg(
        F.min("dimension").alias("low"), F.max("dimension").alias("high"), F.min("model").alias("first"), F.max("model").alias("last")
    )
    found = facts.where("low <> high or first <> last").limit(20).collect()
    for row in found:
        if row["low"] != row["high"]:
            raise ValueError(f"collection {row['collection']} has dimension {row['low']}, got {row['high']}")
    for row in found:
        warnings.warn(f"collection {row['collection']} holds vectors of {row['first']} and {row['last']}", stacklevel=3)


def guarded(rows: DataFrame, path: str, batch: str) -> DataFrame:
    """The rows, with an error at run time for one whose dimension is not its collection's.

    The rows a write replaces do not count. Names and dimensions of collections are
    broadcast if they are few, which is counted; else the join shuffles.
    """
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return rows
    known = _stored(spark, path).where(F.col("batch") != batch).groupBy("collection").agg(F.min("dimension").alias("_known"))
    few = known.limit(GUARD_BROADCAST_ROWS + 1).count() <= GUARD_BROADCAST_ROWS
    joined = rows.join(F.broadcast(known) if few else known, "collection", "left")
    size = F.size("embedding")
    message = F.format_string("collection %s has dimension %d, got %d", F.col("collection"), F.col("_known"), size)
    wrong = (F.col("embedding").isNotNull()) & (size > 0) & (size != F.col("_known"))
    return joined.withColumn(
        "embedding", F.when(wrong, F.raise_error(message).cast("array<float>")).otherwise(F.col("embedding"))
    ).drop("_known")


def overwrite(
    rows: DataFrame, path: str, rebalance: bool = False, max_records_per_file: int = 500_000
) -> str:
    """Replace each collection that occurs in ``rows``, keep the others; returns the new batch label.

    The new rows are shown and the old ones hidden at one moment, for all collections together. A write that fails or dies before
    that changes nothing for readers. The label is new each time, so it tells which collections this write touched.
    """
    spark = rows.sparkSession
    purge(spark, path)
    batch = f"full-{uuid.uuid4().hex}"
    _put(spark, path, PENDING, batch)
    try:
        _write(rows, path, batch, rebalance, max_records_per_file)
        _require_one_dimension(spark, path, batch, alone=True)
        everything = _stored(spark, path)
        written = everything.where(F.col("batch") == batch).select("collection").distinct()
        others = everything.where(F.col("batch") != batch).select("collection", "batch").distinct()
        # One row a replaced partition, in one file: the folder's _SUCCESS is the switch.
        others.join(written, "collection", "left_semi").coalesce(1).write.parquet(_below(spark, path, COMMITS, batch))
    except Exception:
        _remove_batch(spark, path, batch)
        raise
    finally:
        _take(spark, path, PENDING, batch)
    return batch


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows that are no longer or not yet replaced, those of running writes included."""
    return _without_replaced(spark.read.schema(KB_SCHEMA).parquet(path), _commits(spark, path))


def _without_replaced(rows: DataFrame, commits: dict[str, bool]) -> DataFrame:
    spark = rows.sparkSession
    folders = [folder for folder, purged in commits.items() if not purged]
    if not folders:
        return rows
    hidden = spark.read.schema("collection string, batch string").parquet(*folders)
    few = hidden.limit(HIDDEN_FILTERS + 1).collect()
    if len(few) > HIDDEN_FILTERS:
        return rows.join(hidden.distinct(), ["collection", "batch"], "left_anti")
    for row in few:  # conditions on folders: what is hidden is not read
        rows = rows.where((F.col("collection") != row["collection"]) | (F.col("batch") != row["batch"]))
    return rows


def read(spark: SparkSession, path: str, collection: str | None = None) -> DataFrame:
    """The rows as of the last finished writes."""
    running = _names(spark, path, PENDING)  # before the commits: a write that ends in between is seen as a whole
    commits = _commits(spark, path)
    switched = {folder.rsplit("/", 1)[1] for folder in commits}
    waiting = [_unescaped(spark, name) for name in running if name not in switched]
    kb = _without_replaced(spark.read.schema(KB_SCHEMA).parquet(path), commits)
    kb = kb.where(~F.col("batch").isin(waiting)) if waiting else kb
    return kb if collection is None else kb.where(F.col("collection") == collection)


def purge(spark: SparkSession, path: str) -> int:
    """Delete the partitions that finished overwrites have replaced; returns how many. Any write does this first."""
    fs, _ = _fs(spark, path)
    gone = 0
    for folder, purged in _commits(spark, path).items():
        if purged:
            continue
        for row in spark.read.schema("collection string, batch string").parquet(folder).toLocalIterator():
            gone += bool(fs.delete(_batch_folder(spark, path, row["collection"], row["batch"]), True))
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, PURGED), True).close()
    return gone


# --- folders ---------------------------------------------------------------------


def _escaped(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)


def _unescaped(spark: SparkSession, name: str) -> str:
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name)


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _below(spark: SparkSession, path: str, kind: str, label: str) -> str:
    return f"{path.rstrip('/')}/{kind}/{_escaped(spark, label)}"


def _put(spark: SparkSession, path: str, kind: str, label: str) -> None:
    fs, marker = _fs(spark, _below(spark, path, kind, label))
    fs.create(marker, True).close()


def _take(spark: SparkSession, path: str, kind: str, label: str) -> None:
    fs, marker = _fs(spark, _below(spark, path, kind, label))
    fs.delete(marker, True)


def _names(spark: SparkSession, path: str, kind: str) -> list[str]:
    fs, folder = _fs(spark, f"{path.rstrip('/')}/{kind}")
    return [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []


def _commits(spark: SparkSession, path: str) -> dict[str, bool]:
    """Folders of finished overwrites, and whether what they replaced is deleted."""
    fs, _ = _fs(spark, path)
    at = lambda folder, name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
    folders = [f"{path.rstrip('/')}/{COMMITS}/{name}" for name in _names(spark, path, COMMITS)]
    return {folder: at(folder, PURGED) for folder in folders if at(folder, "_SUCCESS")}


def _batch_folder(spark: SparkSession, path: str, collection: str, batch: str):
    _, folder = _folder(spark, path, collection)
    return spark._jvm.org.apache.hadoop.fs.Path(folder, f"batch={_escaped(spark, batch)}")


def _remove_batch(spark: SparkSession, path: str, batch: str) -> None:
    """Delete the partitions of a write that failed."""
    fs, folder = _fs(spark, path)
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, f"collection=*/batch={_escaped(spark, batch)}")) or []:
        fs.delete(status.getPath(), True)


def _folder(spark: SparkSession, path: str, collection: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path, f"collection={_escaped(spark, collection)}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def rename(spark: SparkSession, path: str, old: str, new: str) -> bool:
    """Move a collection to a free name. The name is only in the folder, so no row is rewritten."""
    purge(spark, path)
    fs, source = _folder(spark, path, old)
    _, target = _folder(spark, path, new)
    if not fs.exists(source) or fs.exists(target):
        return False
    return bool(fs.rename(source, target))


def drop(spark: SparkSession, path: str, collection: str) -> bool:
    fs, folder = _folder(spark, path, collection)
    return bool(fs.exists(folder) and fs.delete(folder, True))


def validate(spark: SparkSession, path: str, collection: str) -> int:
    """Row count of a collection; an error if the folder or a column is missing."""
    fs, folder = _folder(spark, path, collection)
    if not fs.exists(folder):
        raise ValueError(f"no collection {collection!r} below {path}")
    missing = _missing_columns(spark, path)
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return read(spark, path, collection).count()


def _missing_columns(spark: SparkSession, path: str) -> list[str]:
    present = set(spark.read.parquet(path).columns)
    return [name for name in KB_SCHEMA.names if name not in present and name != "model"]


def opening_checks(wanted: DataFrame, path: str) -> DataFrame:
    """``collection, status, rows, unusable`` of each wanted ``collection`` before it is opened.

    ``missing``: nothing stored under the name. ``empty``: no usable row. ``mixed dimensions``: a question can only meet some of them.
    ``unusable`` counts rows without text, or whose vector has another length than the row says.
    """
    spark = wanted.sparkSession
    missing = _missing_columns(spark, path)
    if missing:
        return wanted.select("collection", F.lit(f"columns missing: {', '.join(missing)}").alias("status"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("unusable"))
    bad = (F.coalesce("content", F.lit("")) == "") | ~F.coalesce(F.size("embedding") == F.col("dimension"), F.lit(False)) | (F.size("embedding") <= 0)
    facts = read(spark, path).groupBy("collection").agg(
        F.count("*").alias("rows"), F.count_if(bad).alias("unusable"), F.min("dimension").alias("low"), F.max("dimension").alias("high")
    )
    status = (
        F.when(F.col("rows").isNull(), "missing").when(F.col("unusable") == F.col("rows"), "empty")
        .when(F.col("low") != F.col("high"), "mixed dimensions").otherwise("ok")
    )
    none = F.lit(0).cast("long")
    return wanted.select("collection").join(facts, "collection", "left").select(
        "collection", status.alias("status"), F.coalesce("rows", none).alias("rows"), F.coalesce("unusable", none).alias("unusable")
    )


def models_of(kb: DataFrame) -> DataFrame:
    """``collection, embedding_model, rows``: the models a collection's vectors come from, in long form."""
    return kb.groupBy("collection", F.col("model").alias("embedding_model")).agg(F.count("*").alias("rows"))


# --- catalog ---------------------------------------------------------------------


def is_listed(name: Column) -> Column:
    """Names that start with a dot or an underscore are hidden."""
    return ~name.rlike(r"^[._]")


def list_collections(kb: DataFrame) -> DataFrame:
    return kb.select("collection").distinct().where(is_listed(F.col("collection")))


def catalog(kb: DataFrame) -> DataFrame:
    """One row per collection. The distinct sources are counted, not gathered into one row.

    A stored table has its dimensions as a column, so no vector is read.
    """
    dims = F.col("dimension") if "dimension" in kb.columns else F.size("embedding")
    return kb.groupBy("collection").agg(
        F.count("*").alias("chunk_count"),
        F.countDistinct("source").alias("source_count"),
        F.min(dims).alias("embedding_dimension"),
        (F.min(dims) != F.max(dims)).alias("mixed_dimensions"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("last_modified"),
    )


def sources(kb: DataFrame) -> DataFrame:
    """The source list in long form: a collection may have more sources than one row can hold."""
    return kb.groupBy("collection", "source").agg(F.count("*").alias("chunk_count"))


def build_totals(chunks: DataFrame, file: str = "source") -> DataFrame:
    """Files and chunks of a build."""
    per_file = chunks.groupBy(file).agg(F.count("*").alias("chunks"))
    return per_file.agg(
        F.count("*").alias("files"),
        F.sum("chunks").alias("chunks"),
        F.min("chunks").alias("min_chunks_per_file"),
        F.max("chunks").alias("max_chunks_per_file"),
    )


def append_check(incoming: DataFrame, catalog_rows: DataFrame) -> DataFrame:
    """Each incoming ``(collection, dimension, model)`` against the catalog's.

    Another dimension refuses the append, another model only warns.
    """
    known = catalog_rows.select(
        "collection",
        F.col("embedding_dimension").alias("kb_dimension"),
        F.col("embedding_model").alias("kb_model"),
    )
    joined = incoming.join(known, "collection", "left")
    status = (
        F.when(F.col("kb_dimension").isNull(), "new")
        .when(F.col("kb_dimension") != F.col("dimension"), "refused")
        .when(~F.col("kb_model").eqNullSafe(F.col("model")), "model_differs")
        .otherwise("ok")
    )
    return joined.withColumn("status", status)


def require_appendable(checked: DataFrame) -> DataFrame:
    """The checked rows, with an error at run time for a refused one."""
    message = F.format_string(
        "collection %s has dimension %d, got %d", F.col("collection"), F.col("kb_dimension"), F.col("dimension")
    )
    guarded = F.when(F.col("status") == "refused", F.raise_error(message).cast("string")).otherwise(F.col("status"))
    return checked.withColumn("status", guarded)


def resolve_models(catalog_rows: DataFrame, models: DataFrame, replacements: DataFrame) -> DataFrame:
    """Add the model to use per collection: its own if installed, else its replacement."""
    installed = models.select(F.col("model").alias("embedding_model"), F.lit(True).alias("_installed"))
    swaps = replacements.select(F.col("model").alias("embedding_model"), "replacement")
    joined = catalog_rows.join(installed, "embedding_model", "left").join(swaps, "embedding_model", "left")
    return joined.withColumn(
        "resolved_model", F.when(F.col("_installed"), F.col("embedding_model")).otherwise(F.col("replacement"))
    ).drop("_installed", "replacement")


# --- metadata documents of existing stores -----------------------------------------


def parse_metadata_document(document: Column) -> Column:
    """The fields of a stored metadata document.

    The model is written under two names, and the time's six digits hold
    milliseconds (``.000123`` is 123 ms).
    """
    fields = F.from_json(document, "map<string,string>")
    stamp = fields["created_at"]
    base = F.to_timestamp(F.left(stamp, F.lit(19)), "yyyy-MM-dd HH:mm:ss")
    digits = F.regexp_extract(stamp, r"\.(\d{6})$", 1)
    micros = F.when(F.startswith(digits, F.lit("000")), digits.cast("int") * 1000).otherwise(digits.cast("int"))
    created = F.timestamp_micros(F.unix_micros(base) + F.coalesce(micros, F.lit(0)).cast("bigint"))
    return F.struct(
        fields["collection"].alias("collection"),
        F.coalesce(fields["embedding_model"], fields["embeddingModel"]).alias("embedding_model"),
        fields["embedding_dimension"].cast("int").alias("embedding_dimension"),
        fields["chunk_count"].cast("bigint").alias("chunk_count"),
        fields["file_count"].cast("bigint").alias("file_count"),
        F.from_json(fields["files"], "array<string>").alias("files"),
        F.from_json(fields["sources"], "array<string>").alias("sources"),
        created.alias("created_at"),
        fields["last_modified_timestamp"].cast("bigint").alias("last_modified_timestamp"),
        fields["model_type"].alias("model_type"),
        fields["vector_store_type"].alias("vector_store_type"),
        fields["modeldir"].alias("modeldir"),
        fields["rerankerdir"].alias("rerankerdir"),
    )


def metadata_document(catalog_rows: DataFrame) -> DataFrame:
    """``collection, document``: the catalog as JSON documents."""
    wanted = [c for c in catalog_rows.columns if c not in ("created_at", "last_modified", "mixed_dimensions")]
    return catalog_rows.select(
        "collection",
        F.to_json(
            F.struct(
                *wanted,
                F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
                F.unix_millis("last_modified").alias("last_modified_timestamp"),
            )
        ).alias("document"),
    )


def check_name(name: str) -> str:
    """A collection name that can be listed."""
    if not name.strip() or re.match(r"[._]", name):
        raise ValueError(f"not a usable collection name: {name!r}")
    return name
