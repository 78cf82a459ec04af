"""Running streams over the data that is there, and the log and metric streams."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import versions
from ..operators.events import metric_columns
from ..sources.logs import drop_health_checks, normalise_records


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", name_filter: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def drain(stream: DataFrame, path: str, partition_by: list[str] | None = None) -> list[dict]:
    """Append everything that is available to a file sink with its checkpoint, then stop; the progress of the micro-batches."""
    writer = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").outputMode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]


def drain_batches(stream: DataFrame, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Write ``change`` of every micro-batch into a folder of its own; a repeated batch overwrites its folder.

    With partial aggregates as the change, a reader that merges the folders needs no state in the stream and no watermark: a row counts
    however late it comes. Old folders can be merged into one at any time.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")

    query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save)
    query.trigger(availableNow=True).start().awaitTermination()


def drain_versions(stream: DataFrame, path: str, partitions: list[str], name: str) -> None:
    """Add every micro-batch to a table that changes by versions; a repeated batch is in already and is not added again.

    Closed partitions are compacted beside the stream (:func:`kbspark.operators.versions.compact`), in the same process or while it rests.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        versions.append(batch, path, partitions, mark=(name, batch_id))

    query = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").foreachBatch(save)
    query.trigger(availableNow=True).start().awaitTermination()


# --- event log -----------------------------------------------------------------------------------------------


def ingest_records(raw: DataFrame) -> DataFrame:
    """Normalised records without health checks, with the partition date; late and repeated records too."""
    return drop_health_checks(normalise_records(raw)).withColumn("event_date", F.to_date("ts"))


def stored_records(spark: SparkSession, path: str) -> DataFrame:
    """The log as it was ingested, each record once. Repeats have equal dates, so a query of some days reads only these."""
    return spark.read.parquet(f"{path}/data").dropDuplicates(["event_date", "event_id"])


COUNTS = ("queries", "feedbacks", "positive", "negative")


def partial_metrics(logs: DataFrame, width: str, keys: tuple[str, ...], slide: str | None = None) -> DataFrame:
    """Query and feedback counts and a sketch of the users per event-time window and key, of one micro-batch."""
    grouped = logs.groupBy(F.window("ts", width, slide), *keys).agg(*metric_columns(), F.hll_sketch_agg("user_id").alias("users"))
    return grouped.select(F.col("window.start").alias("window_start"), *keys, *COUNTS, "users")


def merged_metrics(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The metrics of all micro-batches so far."""
    grouped = spark.read.parquet(f"{path}/data").groupBy("window_start", *keys)
    return grouped.agg(*[F.sum(c).alias(c) for c in COUNTS], F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


def first_queries(turns: DataFrame, order: str = "created_at") -> DataFrame:
    """The first query of every session that is not empty, with its place; of a table, a micro-batch, or such first queries."""
    asked = turns.where(F.coalesce("user_query", F.lit("")) != "")
    first = F.min(F.struct(order, "user_query")).alias("first")
    return asked.groupBy("session_id").agg(first).select("session_id", f"first.{order}", "first.user_query")
