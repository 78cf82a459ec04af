"""Helpers shared by the operators: words as bytes, numbering without one task per key, small tables for broadcast."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..session import prepare, scratch_path, stored

# A table is broadcast by these operators only when Spark has counted it and found at most this many rows.
BROADCAST_ROWS = 100_000
# Rows that one numbering task sorts, about.
ROWS_PER_SALT = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later jobs do not compute it again and lineage ends."""
    return stored(df, scratch_path(df.sparkSession, name))


def extended(df: DataFrame, **more: str) -> StructType:
    """A copy of the schema of ``df`` with more columns (name=type)."""
    out = StructType(list(df.schema.fields))
    for name, kind in more.items():
        out = out.add(name, kind)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; a null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def batches(source: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, to bound what a task holds as Python objects."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows, else ``df`` as it is.

    Give it a stored table: it is counted.
    """
    return F.broadcast(df) if df.count() <= limit else df


def hash_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``: those whose hash of ``key`` is lowest, by a share that a count gives. Repeatable, without a shuffle."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * rows / n))


def salt_count(rows: int) -> int:
    return max(32, min(20_000, -(-rows // ROWS_PER_SALT)))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, salts: int) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in column ``name``.

    Rows of a key are dealt over ``salts`` parts by a hash of ``order``; each part is numbered on its own and starts where the parts before it
    end. A key with a third of all rows therefore still spreads. The counts are one row per key and part. Rows that are equal in ``order`` keep
    no defined order, so ``order`` should identify a row.
    """
    salt, base, count = fresh(df, "_salt", "_base", "_count")
    parts = df.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = parts.groupBy(*keys, salt).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(*keys).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, salt, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(*keys, salt).orderBy(*order)
    ranked = parts.withColumn(name, F.row_number().over(inside).cast("long") - 1)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, salt)]
    joined = ranked.alias("r").join(bases.alias("b"), _all(same))
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col(f"r.{name}") + F.col(f"b.{base}")).alias(name))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
