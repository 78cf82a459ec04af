"""Top-k of a table of queries against a table of rows without emitting pairs.

Two physical forms, both exact:

* *few queries* - the query side is counted first; when it fits a fixed bound it is shipped to the tasks and every
  task keeps a running top k over its rows. The large side is neither shuffled nor replicated.
* *many queries* - both sides are cut into blocks of bounded size and block pairs meet in a co-group. A key with
  very many rows becomes many blocks, so no task sees more than one block of each side.

Only k rows per query leave a task; a window merges them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import scratch_path, stored

MAX_QUERIES = 4096
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 2_000
BLOCK_VALUES = 5_000_000  # vector elements or tokens of one block
MAX_QUERY_VALUES = 8_000_000  # vector elements or tokens of all queries that are shipped to the tasks
MAX_CELLS = 4_000_000

RESULT = "query_id string, doc_id {id_type}, value double, k int"


class LocalTopK:
    """Running best ``k`` values per query with ties broken by the smaller id, for all queries of a pack at once.

    With ``digits`` the values come unrounded and are ranked as rounded; only those that may be among the best are rounded.
    """

    def __init__(self, k: np.ndarray, digits: int | None = None):
        self.k, self.digits = np.asarray(k), digits
        self.slack = 0.0 if digits is None else 10.0**-digits
        self.floor = np.full(len(k), -np.inf)
        self._values = np.full((len(k), int(self.k.max(initial=0))), -np.inf)  # -inf: nothing yet
        self._ids: np.ndarray | None = None

    @property
    def values(self) -> list[np.ndarray]:
        """The best values of each query so far."""
        return [own[own > -np.inf] for own in self._values]

    @property
    def ids(self) -> list[np.ndarray | None]:
        """Their ids; None where there are none."""
        return [self._ids[q, : len(v)] if len(v) else None for q, v in enumerate(self.values)]

    def add(self, values: np.ndarray, ids: np.ndarray, queries: np.ndarray | None = None) -> None:
        """``values`` is queries x rows, for all queries or those numbered in ``queries``; ``-inf`` marks rows that do not match."""
        if values.shape[1] == 0:
            return
        best, floor = values.max(axis=1), self.floor if queries is None else self.floor[queries]
        lines = np.flatnonzero((best >= floor - self.slack) & (best > -np.inf))
        if not len(lines):
            return
        q = lines if queries is None else queries[lines]
        part = values if len(lines) == len(values) else values[lines]
        limit = np.maximum(np.maximum(floor[lines], _lower_bounds(part, self.k[q])) - self.slack, np.finfo(np.float64).min)
        line, row = np.divmod(np.flatnonzero(part >= limit[:, None]), part.shape[1])
        found = part[line, row] if self.digits is None else np.round(part[line, row], self.digits)
        if self._ids is None:
            self._ids = np.zeros(self._values.shape, dtype=ids.dtype)
        elif self._ids.dtype != ids.dtype:
            self._ids = self._ids.astype(np.result_type(self._ids, ids))
        held, place = np.nonzero(self._values[q] > -np.inf)
        line = np.concatenate([held, line])
        all_values, all_ids = np.concatenate([self._values[q[held], place], found]), np.concatenate([self._ids[q[held], place], ids[row]])
        order = np.lexsort((all_ids, -all_values, line))
        line = line[order]
        rank = np.arange(len(line)) - np.searchsorted(line, line)
        kept = rank < self.k[q[line]]
        at, rank, order = q[line[kept]], rank[kept], order[kept]
        self._values[at, rank], self._ids[at, rank] = all_values[order], all_ids[order]
        full = rank == self.k[at] - 1
        self.floor[at[full]] = all_values[order[full]]

    def frame(self, query_ids: np.ndarray) -> pd.DataFrame:
        if self._ids is None:
            return pd.DataFrame(columns=["query_id", "doc_id", "value", "k"])
        q, rank = np.nonzero(self._values > -np.inf)
        return pd.DataFrame({"query_id": query_ids[q], "doc_id": self._ids[q, rank], "value": self._values[q, rank], "k": self.k[q].astype("int32")})


def _lower_bounds(values: np.ndarray, k: np.ndarray) -> np.ndarray:
    """For each line a value that at least ``k`` of its values reach (-inf if there are fewer): the k-th largest of the maxima of groups of columns."""
    n, most = values.shape[1], int(k.max())
    if n <= most:
        return np.where(k <= n, values.min(axis=1), -np.inf)
    groups = min(n, max(64, 4 * most))
    wide = n // groups
    tops = np.sort(values[:, : wide * groups].reshape(len(values), wide, groups).max(axis=1), axis=1)
    return tops[np.arange(len(k)), groups - np.maximum(k, 1)]


def plain_ids(ids) -> np.ndarray:
    """Ids as a sortable numpy array (text as fixed-width unicode)."""
    ids = np.asarray(ids)
    return ids.astype(str) if ids.dtype == object else ids


def key_column(by: tuple[str, ...]) -> Column:
    return F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in by]) if by else F.lit("")


def bounded_rows(df: DataFrame, limit: int, size: Column | None = None, budget: int = MAX_QUERY_VALUES) -> list | None:
    """All rows when there are at most ``limit`` and their ``size`` sums up to at most ``budget``, else ``None``.

    The sizes are summed by Spark first, so neither many rows nor a few huge ones reach the driver.
    """
    head = df.limit(limit + 1)
    if size is not None:
        n, total = head.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        if n > limit or total > budget:
            return None
    rows = head.collect()
    return None if len(rows) > limit else rows


def matching(rows: DataFrame, queries: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """The rows whose ``by`` columns some query has; nulls match nulls. The join is on the raw columns, so it filters before anything is scored."""
    if not by:
        return rows
    names = [f"_by_{i}" for i in range(len(by))]
    keys = queries.select(*[F.col(c).alias(n) for c, n in zip(by, names)]).distinct()
    same = [rows[c].eqNullSafe(F.col(n)) for c, n in zip(by, names)]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    return rows.join(keys, condition, "left_semi")


def merge_topk(local: DataFrame) -> DataFrame:
    """Final ranks from the tasks' candidates."""
    order = Window.partitionBy("query_id").orderBy(F.col("value").desc(), "doc_id")
    return local.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= F.col("k")).drop("k")


# Scores one batch: (query pack, row pack) -> queries x rows matrix. Packs are what the two loaders return.
Kernel = Callable[[object, object], np.ndarray]


def scan_topk(
    rows: DataFrame,
    packs: dict[str, tuple[np.ndarray, np.ndarray, object]],
    load: Callable[[pa.RecordBatch], object],
    take: Callable[[object, np.ndarray], object],
    kernel: Kernel,
    id_type: str,
    digits: int | None = None,
) -> DataFrame:
    """Few queries: ``packs`` maps a key to (query ids, k, kernel input) and travels as a broadcast. ``digits``: see :class:`LocalTopK`."""
    shipped = rows.sparkSession.sparkContext.broadcast(packs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shipped.value
        best = {key: LocalTopK(k, digits) for key, (_, k, _) in queries.items()}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = plain_ids(batch.column("doc_id").to_numpy(zero_copy_only=False))
            keys = batch.column("_key").dictionary_encode()
            codes = keys.indices.to_numpy(zero_copy_only=False)
            loaded = load(batch)
            for code, key in enumerate(keys.dictionary.to_pylist()):
                if key not in queries:
                    continue
                qids, _, pack = queries[key]
                here = np.flatnonzero(codes == code)
                step = max(1, MAX_CELLS // max(1, len(qids)))
                for lo in range(0, len(here), step):
                    part = here[lo:lo + step]
                    best[key].add(kernel(pack, take(loaded, part)), ids[part])
        for key, top in best.items():
            out = top.frame(queries[key][0])
            if len(out):
                yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    schema = RESULT.format(id_type=id_type)
    return rows.mapInArrow(_typed(run, id_type), schema)


def _result_schema(id_type: str) -> pa.Schema:
    id_arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[id_type]
    return pa.schema([("query_id", pa.string()), ("doc_id", id_arrow), ("value", pa.float64()), ("k", pa.int32())])


def _typed(run, id_type: str):
    schema = _result_schema(id_type)

    def typed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return typed


def with_blocks(rows: DataFrame, queries: DataFrame, row_id: str, query_id: str, most_queries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Assign both sides to block pairs (``_key``, ``_rb``, ``_qb``) of bounded size.

    Block numbers come from the rows and values (``_size``) per key, so a hot key is spread over as many tasks as its size
    asks for. The small table of block numbers is stored: its size is then known, and Spark broadcasts it below its own bound.
    """

    def blocks_of(most: int) -> Column:
        return F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("_size") / BLOCK_VALUES)).cast("int")

    row_blocks = rows.groupBy("_key").agg(blocks_of(BLOCK_ROWS).alias("_nr"))
    query_blocks = queries.groupBy("_key").agg(blocks_of(most_queries or BLOCK_QUERIES).alias("_nq"))
    blocks = stored(row_blocks.join(query_blocks, "_key"), scratch_path(rows.sparkSession, "blocks"))
    rows, queries = rows.drop("_size"), queries.drop("_size")
    spread_rows = rows.join(blocks, "_key").withColumns(
        {
            "_rb": F.pmod(F.xxhash64(row_id), F.col("_nr")).cast("int"),
            "_qb": F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)),
        }
    )
    spread_queries = queries.join(blocks, "_key").withColumns(
        {
            "_qb": F.pmod(F.xxhash64(query_id), F.col("_nq")).cast("int"),
            "_rb": F.explode(F.sequence(F.lit(0), F.col("_nr") - 1)),
        }
    )
    return spread_rows.drop("_nr", "_nq"), spread_queries.drop("_nr", "_nq")


def block_topk(
    rows: DataFrame,
    queries: DataFrame,
    pack: Callable[[pd.DataFrame], object],
    load: Callable[[pa.RecordBatch], object],
    take: Callable[[object, np.ndarray], object],
    kernel: Kernel,
    id_type: str,
    digits: int | None = None,
    most_queries: int | None = None,
) -> DataFrame:
    """Many queries: co-group the block pairs and keep each pair's top k. Both sides carry ``_size``, their number of values.

    A block of rows stays Arrow columns: its tokens or elements never become Python objects. ``most_queries`` in a
    block decide how often the rows are copied.
    """
    spread_rows, spread_queries = with_blocks(rows, queries, "doc_id", "query_id", most_queries)

    schema = _result_schema(id_type)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = right.to_pandas()
        top = LocalTopK(asked["k"].to_numpy() if len(asked) else np.empty(0, dtype=int), digits)
        if left.num_rows and len(asked):
            batch = left.combine_chunks().to_batches()[0]
            ids, packed, loaded = plain_ids(batch.column("doc_id").to_numpy(zero_copy_only=False)), pack(asked), load(batch)
            step = max(1, MAX_CELLS // len(asked))
            for lo in range(0, batch.num_rows, step):
                part = np.arange(lo, min(lo + step, batch.num_rows))
                top.add(kernel(packed, take(loaded, part)), ids[part])
        out = top.frame(asked["query_id"].to_numpy().astype(object))
        return pa.Table.from_arrays([pa.array(out[f.name], from_pandas=True).cast(f.type) for f in schema], schema=schema)

    keys = ["_key", "_rb", "_qb"]
    return spread_rows.groupBy(*keys).cogroup(spread_queries.groupBy(*keys)).applyInArrow(run, RESULT.format(id_type=id_type))


def id_type_of(df: DataFrame, column: str = "doc_id") -> str:
    kind = df.schema[column].dataType.simpleString()
    return kind if kind in ("bigint", "int") else "string"
