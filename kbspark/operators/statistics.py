"""Corpus statistics of a table that changes: signed counts per change, merged when they are read.

Every upsert or delete adds what it brings and what it takes away as (term, df, dl) with a sign. Reading sums them, so statistics cost in
proportion to the changed rows and never a scan of the corpus. :func:`fold` merges the changes into one when they have become many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import versions
from .bm25 import term_statistics

_COLUMNS = ["term", "df", "dl"]


def change(path: str, added: DataFrame | None = None, removed: DataFrame | None = None, text: str = "text", mark: tuple[str, int] | None = None) -> int:
    """Record that the texts of ``added`` came and those of ``removed`` went; the version of the statistics that knows it.

    With ``mark`` (stream, batch) a change that is recorded already is not recorded again.
    """
    parts = [(df, sign) for df, sign in ((added, 1), (removed, -1)) if df is not None]
    if not parts:
        raise ValueError("nothing changed")
    signed = [term_statistics(df, text=text).select("term", (sign * F.col("df")).alias("df"), (sign * F.col("dl")).alias("dl")) for df, sign in parts]
    both = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    return versions.append(_merged(both), path, [], mark)


def _merged(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))
    return out.where((F.col("df") != 0) | (F.coalesce("dl", F.lit(0)) != 0)).select(*_COLUMNS)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(term, df, dl) as :func:`kbspark.operators.bm25.term_statistics` counts them over the table as it is now."""
    return _merged(versions.read(spark, path, version)).where("df > 0")


def fold(spark: SparkSession, path: str) -> int:
    """Merge all changes into one data folder; the sums stay the same."""
    now = versions.manifest(spark, path)
    if now is None:
        raise FileNotFoundError(path)
    new = versions._next(versions.read(spark, path), now, now.partitions)
    root, found = versions._write(_merged(versions.read(spark, path, now.version)), path, now.partitions)
    new.parts = {part: [root] for part in found}
    versions._commit(spark, path, new)
    return new.version
