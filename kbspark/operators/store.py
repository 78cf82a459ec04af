"""Chunk store: metadata assembly, overwrite by key, upload reconciliation and table copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from pyspark.sql.types import StructType

from ..constants import BATCH_DOCS, DEFAULT_LANGUAGE, UPLOAD_RETRIES
from ..session import scratch_path, stored

# Loader fields of a chunk with their defaults (fixed values).
LOADER_DEFAULTS = {
    "author": "", "keywords": "", "subject": "", "title": "", "chunk_idx": 0, "chunk_offset": None, "page": 1, "total_pages": 1,
}
_LOADER_TYPES = {
    "author": "string", "keywords": "string", "subject": "string", "title": "string",
    "chunk_idx": "bigint", "chunk_offset": "bigint", "page": "bigint", "total_pages": "bigint",
}


def metadata_struct(loader: Callable[[str], Column], general: Callable[[str], Column], given: list[str], described: list[str]) -> Column:
    """Defaults, then the fields that the loader has ``given``, then those of the entry; unknown fields are dropped. ``loader`` and ``general``
    give the column of a field, ``described`` are the fields of the entries."""
    fields: list[Column] = []
    for name, default in LOADER_DEFAULTS.items():
        kind = _LOADER_TYPES[name]
        value = loader(name).cast(kind) if name in given else F.lit(None).cast(kind)
        fields.append(F.coalesce(value, F.lit(default).cast(kind)).alias(name))
    fields += [
        general("kb_id").alias("kb_id"),
        general("project_id").alias("project_id"),
        F.coalesce(general("language"), F.lit(DEFAULT_LANGUAGE)).alias("language"),
        general("source_file").alias("source_file"),
        F.coalesce(general("source_type"), F.lit("pdf")).alias("source_type"),
        general("custom").alias("custom"),
    ]
    fields += [general(c).alias(c) for c in ("embedding_model", "created_at") if c in described]
    return F.struct(*fields)


def assemble_metadata(loader: DataFrame, general: DataFrame) -> DataFrame:
    """Metadata of the loader's rows with those of their entries, by ``kb_id``; see :func:`metadata_struct`."""
    rows = loader.alias("l").join(general.alias("g"), "kb_id")
    entry = lambda c: F.col(c) if c == "kb_id" else F.col(f"g.{c}")
    made = metadata_struct(lambda c: F.col(f"l.{c}"), entry, loader.columns, general.columns)
    keep = [F.col("l._id").alias("_id")] if "_id" in loader.columns else []
    return rows.select("kb_id", *keep, made.alias("metadata"))


def first_metadata(chunks: DataFrame) -> DataFrame:
    """Metadata of the first chunk of every entry."""
    return chunks.groupBy("kb_id").agg(F.min_by("metadata", F.struct("metadata.chunk_idx", "_id")).alias("metadata"))


def fixed_batch(index: Column, size: int = BATCH_DOCS) -> Column:
    """Batch number of the item with a 0-based index."""
    return F.floor(index / size)


def overwrite_by_key(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The store without the keys that arrive, plus the arriving rows."""
    return store.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def upsert(incoming: DataFrame, path: str, keys: list[str], partitions: list[str]) -> None:
    """Put rows in a store partitioned by ``partitions``, in place of the rows with their ``keys``. Other partitions are neither read nor written.

    The new content of the touched partitions is written to the shared folder first, since a partition cannot be read and replaced at once.
    """
    spark = incoming.sparkSession
    fresh = stored(incoming, scratch_path(spark, "upsert"))
    if exists(spark, path):
        old = spark.read.schema(fresh.schema).parquet(path)
        # few values, whatever the size of the store: sent to the rows, since rows dealt by them would be a task for each partition
        touched = F.broadcast(fresh.select(*partitions).distinct())
        old = old.join(touched, partitions, "left_semi").select(*fresh.columns)
        fresh = stored(overwrite_by_key(old, fresh, keys), scratch_path(spark, "upsert"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table is there, by the file system that Spark uses for the path."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def reconcile(expected: DataFrame, sent: DataFrame, keys: list[str], retries: int = UPLOAD_RETRIES) -> DataFrame:
    """Stored against expected rows per batch: complete, partial or missing, and what to do next.

    ``expected`` has the keys, ``expected`` and ``retries``; a partial batch is deleted and sent again until it
    used up its retries.
    """
    counted = sent.groupBy(*keys).agg(F.count(F.lit(1)).alias("stored"))
    joined = expected.join(counted, keys, "full")
    status = (
        F.when(F.col("expected").isNull(), "unexpected")
        .when(F.coalesce(F.col("stored"), F.lit(0)) == F.col("expected"), "ok")
        .when(F.coalesce(F.col("stored"), F.lit(0)) == 0, "missing")
        .otherwise("partial")
    )
    out = joined.withColumns({"status": status, "stored": F.coalesce("stored", F.lit(0)), "retries": F.coalesce("retries", F.lit(0))})
    action = (
        F.when(F.col("status") == "ok", "skip")
        .when(F.col("status") == "unexpected", "delete")
        .when(F.col("retries") >= retries, "give up")
        .when(F.col("status") == "partial", "delete and send")
        .otherwise("send")
    )
    return out.withColumn("action", action)


def copy_table(source: DataFrame, path: str, id_col: str = "_id") -> DataFrame:
    """Copy a table with its ids and report rows read and written. The rows read are counted by the write itself."""
    seen = Observation("copy")
    source.observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col(id_col).isNull()).alias("without_id")).write.mode("overwrite").parquet(path)
    counts = seen.get
    written = source.sparkSession.read.parquet(path)
    return written.groupBy().agg(
        F.lit(counts["read"]).alias("rows_read"),
        F.count(F.lit(1)).alias("rows_written"),
        F.lit(counts["without_id"]).alias("without_id"),
    )


def copy_rows(source: DataFrame, path: str, schema: str, id_col: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Copy rows into a table of another schema: (report, failures).

    A row fails if its id is null, if another row has its id (of these the one with the smallest hash of its content is copied) or if a value
    does not fit the type of its column. Failures keep the id, the reasons and the row as JSON, so that a later run can take them as its source;
    nothing fails silently and nothing stops the copy. ``report``: rows_read, rows_written, rows_failed.
    """
    spark = source.sparkSession
    target = StructType.fromDDL(schema)
    missing = [f.name for f in target if f.name not in source.columns]
    if missing:
        raise ValueError(f"the source has no {missing}")
    content = F.to_json(F.struct(*source.columns))
    fitted = {f.name: F.col(f.name).try_cast(f.dataType) for f in target}
    bad = [F.when(F.col(n).isNotNull() & c.isNull(), F.lit(f"type of {n}")) for n, c in fitted.items()]
    marked = source.select(
        F.struct(*[c.alias(n) for n, c in fitted.items()]).alias("row"), F.col(id_col).alias("id"), content.alias("content"),
        F.array_compact(F.array(F.when(F.col(id_col).isNull(), F.lit("no id")), *bad)).alias("reasons"),
    )
    marked = stored(marked.withColumn("place", F.struct(F.xxhash64("content").alias("hash"), F.monotonically_increasing_id().alias("row"))), scratch_path(spark, "copy"))
    # ids that come twice are found with partial counts; only their rows are compared
    fit = F.size("reasons") == 0
    first = marked.where(fit).groupBy("id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    judged = marked.join(first.select(F.col("id").alias("of_id"), "first"), F.col("id") == F.col("of_id"), "left")
    again = fit & F.col("first").isNotNull() & (F.col("place") != F.col("first"))
    judged = judged.withColumn("reasons", F.when(again, F.array(F.lit("repeated id"))).otherwise(F.col("reasons")))
    failed = F.size("reasons") > 0
    judged.where(~failed).select("row.*").write.mode("overwrite").parquet(f"{path}/rows")
    judged.where(failed).select(F.col("id").cast("string").alias("id"), "reasons", "content").write.mode("overwrite").parquet(f"{path}/failures")
    failures = spark.read.schema("id string, reasons array<string>, content string").parquet(f"{path}/failures")
    counts = [marked.agg(F.count(F.lit(1)).alias("rows_read")), spark.read.schema(target).parquet(f"{path}/rows").agg(F.count(F.lit(1)).alias("rows_written"))]
    counts.append(failures.agg(F.count(F.lit(1)).alias("rows_failed")))
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]), failures  # a row each


def write_artifacts(spark: SparkSession, pages: DataFrame, sections: DataFrame, chunks: DataFrame, path: str) -> dict[str, str]:
    """Pages and sections as one JSON record per document, chunks as JSON lines."""
    out = {name: f"{path}/{name}" for name in ("pages", "sections", "chunks")}
    for name, df, order in (("pages", pages, "page"), ("sections", sections, "section_no")):
        fields = [c for c in df.columns if c != "doc_id"]
        record = F.sort_array(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias(name)
        df.groupBy(F.col("doc_id").alias("document")).agg(record).write.mode("overwrite").json(out[name])
    chunks.write.mode("overwrite").json(out["chunks"])
    return out
