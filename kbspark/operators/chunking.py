"""Texts to chunk rows. A text is one row, so splitting needs no shuffle: every row becomes an array and is exploded."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..constants import (
    BATCH_ITEMS, BATCH_TOKENS, FILE_CHUNK_OVERLAP, FILE_CHUNK_SIZE, FILE_SEPARATORS, L0_OVERLAP, L0_SIZE, L1_OVERLAP, L1_SIZE,
    SPAN_SEPARATORS,
)
from ..functions import splitters as sp, text as tx

PIECES = T.ArrayType(
    T.StructType(
        [
            T.StructField("chunk_index", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("char_start", T.LongType()),
            T.StructField("char_end", T.LongType()),
        ]
    )
)

_PIECE = pa.struct([("chunk_index", pa.int64()), ("text", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64())])
_AT_ONCE = 256  # texts whose pieces are Python objects at a time

Splitter = Callable[[str, int, int, list], list]
SPLITTERS: dict[str, Splitter] = {"separator": sp.span_pieces, "recursive": sp.recursive_pieces}


def register_splitter(name: str, split: Splitter) -> None:
    """Add a splitter: (text, size, overlap, separators) to (number, piece, start, end) tuples."""
    SPLITTERS[name] = split


def pieces(text: Column, splitter: str, size: int, overlap: int, separators: list[str]) -> Column:
    """Chunks of a text column as an array of structs."""
    split = SPLITTERS[splitter]

    def some(texts: pa.Array) -> pa.Array:
        own = [split(x, size, overlap, separators) if x is not None else [] for x in texts.to_pylist()]
        edges = np.cumsum([0, *map(len, own)], dtype=np.int32)
        columns = zip(*(p for found in own for p in found), strict=True) if edges[-1] else [[]] * 4
        parts = [pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)]
        return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(parts, fields=list(_PIECE)))

    def run(texts: pa.Array) -> pa.Array:
        made = [some(texts.slice(low, _AT_ONCE)) for low in range(0, len(texts), _AT_ONCE)]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(_PIECE))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # the annotations of this module are strings
    return F.arrow_udf(run, PIECES)(text)


def _exploded(df: DataFrame, made: Column, text: str) -> DataFrame:
    return df.withColumn("_p", F.explode(made)).drop(text).select("*", "_p.*").drop("_p")


def split_simple(df: DataFrame, text: str = "text", size: int = L0_SIZE, overlap: int = L0_OVERLAP, separators=None) -> DataFrame:
    return _exploded(df, pieces(F.col(text), "separator", size, overlap, separators or SPAN_SEPARATORS), text)


def split_recursive(df: DataFrame, text: str = "text", size: int = FILE_CHUNK_SIZE, overlap: int = FILE_CHUNK_OVERLAP, separators=None) -> DataFrame:
    return _exploded(df, pieces(F.col(text), "recursive", size, overlap, separators or FILE_SEPARATORS), text)


def split_hierarchical(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Parent (L0) and child (L1) chunks with offsets into the header-free text.

    Children are cut from the parent's text and both levels leave one generator, so the text is read once.
    """
    doc = F.col(doc_id).cast("string")
    parents = split_simple(df.withColumn(text, tx.without_headers(F.col(text))), text, L0_SIZE, L0_OVERLAP)
    cut = parents.withColumn("_l1", pieces(F.col("text"), "separator", L1_SIZE, L1_OVERLAP, SPAN_SEPARATORS))
    parent_id = tx.chunk_id(doc, "L0", F.col("char_start"), F.col("char_end"))
    whole = F.array(
        F.struct(
            F.lit(0).cast("long").alias("chunk_index"), F.col("text").alias("text"),
            F.lit(0).cast("long").alias("char_start"), (F.col("char_end") - F.col("char_start")).alias("char_end"),
        )
    )
    children = F.when(F.size("_l1") > 0, F.col("_l1")).otherwise(whole)
    none = F.lit(None).cast("string")
    own = F.struct(
        F.lit("L0").alias("chunk_level"), parent_id.alias("chunk_id"), none.alias("parent_chunk_id"),
        F.col("chunk_index").alias("chunk_index"), F.col("text").alias("text"),
        F.col("char_start").alias("char_start"), F.col("char_end").alias("char_end"),
    )
    below = F.transform(
        children,
        lambda c: F.struct(
            F.lit("L1").alias("chunk_level"),
            tx.chunk_id(doc, "L1", F.col("char_start") + c["char_start"], F.col("char_start") + c["char_end"]).alias("chunk_id"),
            parent_id.alias("parent_chunk_id"), c["chunk_index"].alias("chunk_index"), c["text"].alias("text"),
            (F.col("char_start") + c["char_start"]).alias("char_start"), (F.col("char_start") + c["char_end"]).alias("char_end"),
        ),
    )
    keep = [c for c in df.columns if c != text]
    return cut.select(*keep, F.inline(F.concat(F.array(own), below)))


def chunk_records(df: DataFrame, page: Column | None = None) -> DataFrame:
    """Pages to file chunks numbered from 0, page from 1, with the number of pages kept."""
    numbered = df.withColumn("page", (F.coalesce(page if page is not None else F.lit(None).cast("long"), F.lit(0)) + 1).cast("long"))
    return split_recursive(numbered).withColumnRenamed("chunk_index", "chunk_idx").withColumnRenamed("char_start", "chunk_offset").drop("char_end")


def greedy_batch_numbers(sizes: Column, max_sum: int = BATCH_TOKENS, max_items: int = BATCH_ITEMS) -> Column:
    """Batch number of every item of an ordered array of sizes (the items of one document)."""

    def run(arrays: pd.Series) -> pd.Series:
        return pd.Series([sp.greedy_batches(a, max_sum, max_items) if a is not None else None for a in arrays], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.LongType()))(sizes)
