"""Embedding job: each text is embedded once per model, whatever table it comes from.

Vectors are kept under a hash of the text, in a table that changes by versions. A run embeds the texts whose hash is not there yet, one of each.
They are dealt to the tasks by length, so that the texts of a model's batch are about equally long and are not padded to one long text. The
size of a model's vectors is found with one text when the model is first used; vectors of another size are errors of the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import partition_name
from ..functions.vectors import normalise
from ..session import scratch_path, stored
from . import knn, versions

BATCH_CHARS = 20_000_000  # characters that one task embeds, about
_HASH = 16  # folders of a model, by the first digit of the hash
PROBE = "dimension probe"


def text_key(text: Column) -> Column:
    """A text's address: SHA-256 of its UTF-8 bytes."""
    return F.sha2(text, 256)


def dimensions(spark: SparkSession, model: str) -> int:
    """Size of a model's vectors, from one text."""
    one = spark.createDataFrame([(PROBE,)], "text string")
    return one.select(F.size(knn.EMBEDDERS[model](F.col("text"))).alias("n")).first()["n"]


def known_dimensions(spark: SparkSession, path: str, model: str) -> int:
    """The size found when the model was first used with this cache."""
    sizes = f"{path}/sizes"
    now = versions.manifest(spark, sizes)
    if now is not None:
        row = versions.read(spark, sizes).where(F.col("model") == model).agg(F.min("dims")).first()[0]
        if row is not None:
            return row
    dims = dimensions(spark, model)
    versions.append(spark.createDataFrame([(model, dims)], "model string, dims int"), sizes, [])
    return dims


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """One row per different text, with its address; nulls have none."""
    return docs.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"))


def refresh(docs: DataFrame, path: str, model: str, text: str = "text", unit: bool = True) -> dict[str, int]:
    """Embed the texts of ``docs`` that the cache at ``path`` has no vector of: how many texts there are, were embedded and failed.

    A text fails if the model gives null, elements that are not finite or another size than its first vector; it is tried again in the next
    run. Nothing is written if nothing is new.
    """
    spark = docs.sparkSession
    vectors = f"{path}/vectors"
    wanted = _texts(docs, text).withColumn("shelf", F.substring("key", 1, 1))
    dims = known_dimensions(spark, path, model)
    now = versions.manifest(spark, vectors)
    shelf = partition_name(F.lit(model), keep_old=False)
    if now is not None:
        have = versions.read(spark, vectors).where((F.col("model") == model)).select(F.col("key").alias("known"), F.col("shelf").alias("of"))
        new = wanted.join(have, (F.col("key") == F.col("known")) & (F.col("shelf") == F.col("of")), "left_anti")
    else:
        new = wanted
    new = stored(new.withColumn("chars", F.length("text")), scratch_path(spark, "new-texts"))
    n, chars = new.agg(F.count(F.lit(1)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    total = wanted.count()
    if n == 0:
        return {"texts": total, "embedded": 0, "failed": 0}
    tasks = max(spark.sparkContext.defaultParallelism, -(-chars // BATCH_CHARS))
    by_length = new.repartitionByRange(tasks, "chars", "key").sortWithinPartitions("chars")
    made = by_length.withColumn("_v", knn.EMBEDDERS[model](F.col("text")))
    made = made.withColumn("vector", (normalise("_v") if unit else F.col("_v")).cast("array<double>"))
    made = stored(made.select("key", F.lit(model).alias("model"), shelf.alias("model_partition"), "shelf", "vector"), scratch_path(spark, "new-vectors"))
    good = made.where(knn.finite() & (F.size("vector") == dims))
    embedded = good.count()
    if embedded:
        versions.append(good, vectors, ["model_partition", "shelf"])
    return {"texts": total, "embedded": embedded, "failed": n - embedded}


def with_vectors(docs: DataFrame, path: str, model: str, text: str = "text") -> DataFrame:
    """``docs`` with ``vector`` from the cache, null where the text has none."""
    spark = docs.sparkSession
    vectors = f"{path}/vectors"
    if versions.manifest(spark, vectors) is None:
        return docs.withColumn("vector", F.lit(None).cast("array<double>"))
    have = versions.read(spark, vectors).where(F.col("model") == model).select(F.col("key").alias("_known"), F.col("vector"))
    return docs.withColumn("_key", text_key(F.col(text))).join(have, F.col("_key") == F.col("_known"), "left").drop("_key", "_known")
