"""Stored approximate vector index: cells found on a bounded sample, a folder per cell, product-quantised codes before exact scores.

The fit sees at most SAMPLE_ROWS vectors, those with the smallest hash of their id; every row of the table is indexed. A search reads the folders
of the cells that its queries probe. In a folder the codes are scored first, from one small table per query and part of the vector, and only the
``refine`` best rows of a batch and query are scored on their vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..constants import K_EMB
from ..functions.vectors import knn_score
from . import topk
from .knn import _cosines, _matrix, _stack, dimensions, finite, with_cells

SAMPLE_ROWS = 16_384
SAMPLE_VALUES = 8_000_000  # elements of all sampled vectors
ROWS_PER_CELL = 2_000  # wanted
SAMPLED_PER_CELL = 16  # sampled rows that a cell needs, which bounds the number of cells
PART = 4  # elements that one byte of a code stands for
LEVELS = 256
ROWS_PER_FILE = 500_000
REFINE = 50


@dataclass
class Codebook:
    """Cell centres, and for every part of a vector the values that its codes stand for."""

    centres: np.ndarray  # cells x dims
    levels: np.ndarray  # parts x levels x PART

    def encode(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Codes of what the centre leaves of each vector."""
        rest = self._parts(vectors - self.centres[cells])
        out = np.empty(rest.shape[:2], dtype=np.uint8)
        for p, levels in enumerate(self.levels):
            out[:, p] = (-2.0 * rest[:, p] @ levels.T + (levels * levels).sum(axis=1)).argmin(axis=1)
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products of every part of every query with its levels: queries x parts x levels."""
        return np.einsum("qpd,pld->qpl", self._parts(queries), self.levels)

    def _parts(self, vectors: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(vectors), len(self.levels) * PART))
        wide[:, : vectors.shape[1]] = vectors
        return wide.reshape(len(vectors), len(self.levels), PART)


def _means(x: np.ndarray, start: np.ndarray, rounds: int, unit: bool) -> np.ndarray:
    """k-means from the given centres; an empty cell keeps its centre."""
    centres = start.copy()
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1) if unit else (-2.0 * x @ centres.T + (centres * centres).sum(axis=1)).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def fit(chunks: DataFrame, rows: int, dims: int, cells: int | None = None, rounds: int = 8) -> Codebook:
    """Codebook from a sample of ``chunks`` (doc_id, vector of ``dims`` finite elements), of which there are ``rows``."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dims))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = chunks if rows <= most else chunks.where(place < int((1 << 30) * most / rows))
    x = _stack([r["vector"] for r in chosen.orderBy(place, "doc_id").limit(most).select("vector").collect()] or [np.zeros(dims)])
    wanted = cells or -(-rows // ROWS_PER_CELL)
    k = max(1, min(wanted, len(x) if cells else len(x) // SAMPLED_PER_CELL or 1))
    centres = _means(x, x[:k], rounds, unit=True)
    near = (x @ centres.T).argmax(axis=1)
    parts = -(-dims // PART)
    rest = np.zeros((len(x), parts * PART))
    rest[:, :dims] = x - centres[near]
    rest = rest.reshape(len(x), parts, PART)
    n = min(LEVELS, len(x))
    return Codebook(centres, np.stack([_means(rest[:, p], rest[:n, p], rounds, unit=False) for p in range(parts)]))


def _save(spark: SparkSession, book: Codebook, id_type: str, path: str) -> None:
    rows = [(id_type, 0, [])]
    rows += [("centre", i, v.tolist()) for i, v in enumerate(book.centres)] + [("part", i, v.ravel().tolist()) for i, v in enumerate(book.levels)]
    spark.createDataFrame(rows, "kind string, number int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")


def codebook(spark: SparkSession, path: str) -> tuple[Codebook, str]:
    """The stored codebook, whose size is bounded by that of the sample, and the type of the ids."""
    rows = sorted(spark.read.parquet(f"{path}/codebook").collect(), key=lambda r: r["number"])
    pick = lambda kind: np.array([r["vector"] for r in rows if r["kind"] == kind], dtype=np.float64)
    levels = pick("part")
    id_type = next(r["kind"] for r in rows if r["kind"] not in ("centre", "part"))
    return Codebook(pick("centre"), levels.reshape(len(levels), -1, PART)), id_type


def write(chunks: DataFrame, path: str, by: tuple[str, ...] = (), cells: int | None = None, mode: str = "overwrite") -> None:
    """Index ``chunks`` (doc_id, vector, ``by``) in ``path``; with ``mode="append"`` they join the cells of the index that is there.

    Vectors that are not finite, or of another size than most, are left out (:func:`kbspark.operators.knn.rejects` lists them).
    """
    spark = chunks.sparkSession
    if mode == "append":
        book, _ = codebook(spark, path)
        usable = chunks.where(finite() & (F.size("vector") == book.centres.shape[1]))
        n = usable.count()
    else:
        dims = dimensions(chunks) or 1
        usable = chunks.where(finite() & (F.size("vector") == dims))
        n = usable.count()
        book = fit(usable, n, dims, cells)
        _save(spark, book, topk.id_type_of(chunks), path)
    shipped = spark.sparkContext.broadcast(book)

    @F.pandas_udf(T.BinaryType())
    def coded(vectors: pd.Series, cells: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=object)
        return pd.Series([c.tobytes() for c in shipped.value.encode(_stack(vectors), cells.to_numpy())], dtype=object)

    own = usable.select(F.col("doc_id").cast(topk.id_type_of(chunks)), topk.key_column(by).alias("_key"), F.col("vector").cast("array<double>").alias("vector"))
    placed = with_cells(own, book.centres)
    rows = placed.withColumn("code", coded("vector", "cell"))
    # a large cell becomes several files: rows are dealt by id over as many as the fullest cells may need
    files = max(1, -(-n // ROWS_PER_FILE))
    dealt = rows.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(files)))
    dealt.write.mode(mode).partitionBy("cell").parquet(f"{path}/rows")


@dataclass
class _Rows:
    codes: np.ndarray
    vectors: np.ndarray


@dataclass
class _Queries:
    vectors: np.ndarray
    tables: np.ndarray | None  # None: too many for tables, all rows are scored
    refine: np.ndarray


def _load(batch: pa.RecordBatch) -> _Rows:
    return _Rows(np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1), _matrix(batch))


def _take(rows: _Rows, part: np.ndarray) -> _Rows:
    return _Rows(rows.codes[part], rows.vectors[part])


def _scores(queries: _Queries, rows: _Rows) -> np.ndarray:
    """Cosines of the rows that the codes put first for a query; -inf for the others. Within a cell the centre's share is the same for all."""
    n = len(rows.codes)
    out = np.full((len(queries.vectors), n), -np.inf)
    for q, (vector, most) in enumerate(zip(queries.vectors, queries.refine, strict=True)):
        if most < n:
            table, near = queries.tables[q], np.zeros(n)
            for p in range(rows.codes.shape[1]):
                near += table[p][rows.codes[:, p]]
            first = np.argpartition(-near, most)[:most]
            out[q, first] = _cosines(vector[None], rows.vectors[first])[0]
        else:
            out[q] = _cosines(vector[None], rows.vectors)[0]
    return out


def search(
    queries: DataFrame, path: str, probes: int, by: tuple[str, ...] = (), k: int = K_EMB, refine: int = REFINE, max_queries: int = topk.MAX_QUERIES
) -> DataFrame:
    """Approximate :func:`kbspark.operators.knn.search` over the indexed rows: the ``probes`` nearest cells of a query, in each batch of a cell the
    ``refine`` rows (``k`` at least) that the codes put first. With all cells and ``refine`` as large as the table it is exact.

    Queries within the bounds are shipped to the tasks and only the folders of their cells are read; more meet the rows in blocks of a cell.
    """
    spark = queries.sparkSession
    book, id_type = codebook(spark, path)
    kcol = F.col("k").cast("int") if "k" in queries.columns else F.lit(k)
    usable = finite() & (F.size("vector") == book.centres.shape[1])
    q = queries.where(usable).select(F.col("query_id").cast("string").alias("query_id"), "vector", kcol.alias("k"), topk.key_column(by).alias("_own"))
    q = q.groupBy("query_id", "_own").agg(F.min("vector").alias("vector"), F.max("k").alias("k"))
    q = with_cells(q, book.centres, min(probes, len(book.centres)))
    key = F.concat_ws("\u0001", F.col("cell").cast("string"), "_own").alias("_key")
    q = q.select("query_id", "vector", "k", "cell", key)
    rows = spark.read.schema(f"doc_id {id_type}, _key string, vector array<double>, code binary, cell int").parquet(f"{path}/rows")
    rows = rows.select("doc_id", "vector", "code", "cell", F.concat_ws("\u0001", F.col("cell").cast("string"), "_key").alias("_key"))
    small = topk.bounded_rows(q, max_queries * probes, F.size("vector"))

    def pack(vectors: np.ndarray, ks: np.ndarray) -> _Queries:
        return _Queries(vectors, book.tables(vectors), np.maximum(ks, refine))

    if small is not None:
        mine: dict[str, list] = {}
        for r in small:
            mine.setdefault(r["_key"], []).append(r)
        packs = {}
        for name, own in mine.items():
            ks = np.array([r["k"] for r in own])
            packs[name] = np.array([r["query_id"] for r in own], dtype=object), ks, pack(_stack([r["vector"] for r in own]), ks)
        probed = rows.where(F.col("cell").isin(sorted({r["cell"] for r in small}))).drop("cell")
        local = topk.scan_topk(probed, packs, _load, _take, _scores, id_type)
    else:
        sized = F.size("vector").alias("_size")
        local = topk.block_topk(
            rows.drop("cell").select("*", sized), q.drop("cell").select("*", sized), lambda f: pack(_stack(f["vector"]), f["k"].to_numpy()),
            _load, _take, _scores, id_type,
        )
    return topk.merge_topk(local).select("query_id", "doc_id", F.col("value").alias("cosine"), knn_score(F.col("value")).alias("score"), "rank")
