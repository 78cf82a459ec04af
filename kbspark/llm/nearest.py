"""Approximate nearest neighbours by cosine: lists of an inverted file, scanned with early abandoning.

Vectors are scaled to length one, turned by a random rotation and dealt to the list of their nearest centre. A query reads its nearest lists.
Within a list the rotated vectors lie in column blocks: after each block the distance so far, scaled up to all dimensions, is tested against
the distance of the k-th best; a candidate that is farther with high confidence is abandoned. What survives is scored on the original vectors
in double precision.

Centres are fitted on a bounded sample and the number of lists to read is chosen on it; every row is indexed. A list of any size is cut into
parts that a task streams its queries past, so neither a list nor its queries are ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import hash_sample, materialise

FIT_ROWS = 16_384  # rows that centres are fitted on, about
CHECK_QUERIES = 256  # of these, for choosing how many lists are read
MAX_LISTS = 1024
PART_ROWS = 8_192
BLOCK = 16  # dimensions tested at a time
CONFIDENCE = 2.1  # a candidate at distance r is abandoned with probability about exp(-c * CONFIDENCE**2)
AIM = 0.97  # recall on the sample
K = 5


def usable(vector: str) -> Column:
    """Not null, not empty, all components there and finite, not all zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & whole & F.exists(vector, lambda x: x != 0)


@dataclass
class Index:
    """Rotation, centres and how many lists to read; its size is bounded by MAX_LISTS."""

    rotation: np.ndarray
    centres: np.ndarray
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very large and very small components stay finite
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def fit(sample: np.ndarray, rows: int, k: int = K, seed: int = 11, rounds: int = 8) -> Index:
    """Spherical k-means on the sample; ``rows`` is the size of the whole table, whose root is the number of lists."""
    random = np.random.default_rng(seed)
    dims = sample.shape[1]
    rotation = np.linalg.qr(random.standard_normal((dims, dims)))[0].astype(np.float32)
    x = _unit(sample) @ rotation
    lists = int(max(1, min(MAX_LISTS, round(rows**0.5), len(x) // 8)))
    centres = x[random.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        lengths = np.linalg.norm(sums, axis=1)
        full = lengths > 0
        centres[full] = sums[full] / lengths[full, None]
    own = (x @ centres.T).argmax(axis=1)
    chosen = random.choice(len(x), min(len(x), CHECK_QUERIES), replace=False)
    near = x[chosen] @ x.T
    near[np.arange(len(chosen)), chosen] = -2
    best = np.argsort(-near, axis=1, kind="stable")[:, :k]
    order = np.argsort(-(x[chosen] @ centres.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each list in a query's order
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(AIM * len(needed)))]) + 1 if len(needed) else 1
    return Index(rotation, centres, min(lists, probes))


def _scan(blocks: list[np.ndarray], originals: np.ndarray, lengths: np.ndarray, ids: np.ndarray, own: int, q: np.ndarray, query: np.ndarray, k: int):
    """The k best of one part for one query: scores and ids, nearest first, ties to the smaller id."""
    n, dims = len(ids), len(q)
    seed = min(n, max(64, 4 * k))
    far = np.zeros(seed)
    for i, block in enumerate(blocks):
        d = block[:seed] - q[i * BLOCK : i * BLOCK + block.shape[1]]
        far += np.einsum("ij,ij->i", d, d)
    others = far[ids[:seed] != own]
    bound = float(np.partition(others, k - 1)[k - 1]) if len(others) >= k else np.inf
    alive, sums, seen = np.arange(n), np.zeros(n), 0
    for i, block in enumerate(blocks):
        d = (block if len(alive) == n else block[alive]) - q[i * BLOCK : i * BLOCK + block.shape[1]]
        sums = sums + np.einsum("ij,ij->i", d, d)
        seen += block.shape[1]
        limit = bound * 1.0001 + 1e-6 if seen == dims else bound * seen / dims * (1 + CONFIDENCE / np.sqrt(seen)) ** 2 + 1e-6
        stay = sums <= limit
        if not stay.all():
            alive, sums = alive[stay], sums[stay]
    other = ids[alive] != own
    alive, sums = alive[other], sums[other]
    if len(alive) > k:  # ties at the k-th distance stay
        near = sums <= np.partition(sums, k - 1)[k - 1] * 1.0001 + 1e-6
        alive = alive[near]
    scores = (originals[alive] * query).sum(axis=1) / (lengths[alive] * np.sqrt((query * query).sum()))
    top = np.lexsort((ids[alive], -scores))[:k]
    return scores[top], ids[alive][top]


def search(vectors: DataFrame, key: str, vector: str, queries: Column, k: int = K) -> DataFrame:
    """For each usable row where ``queries`` holds, its ``k`` nearest other usable rows: query_id, rank, vec_id, score.

    Rows with a null key, unusable vectors, and vectors of another length than the most frequent one take no part. Rows with one key are one
    row: the smallest vector stays. A query with fewer others gets all that exist. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    base = vectors.where(F.col(key).isNotNull() & usable(vector)).select(
        F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("vector"), queries.alias("asks")
    )
    sizes = base.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dims = sizes[0]["dims"]
    base = base.where(F.size("vector") == dims).groupBy("id").agg(F.min("vector").alias("vector"), F.max("asks").alias("asks"))
    base = materialise(base, "vectors")
    rows = base.count()
    sample = hash_sample(base, F.col("id"), FIT_ROWS).select("id", "vector").toPandas().sort_values("id")
    index = fit(np.array(sample["vector"].tolist()).reshape(-1, dims), rows, k)
    sent = spark.sparkContext.broadcast(index)

    def listed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in source:
            x = _unit(_matrix(batch.column(1), dims)) @ own.rotation
            at = pa.array((x @ own.centres.T).argmax(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), at], names=["id", "vector", "asks", "list"])

    dealt = materialise(base.mapInArrow(listed, "id long, vector array<double>, asks boolean, list int"), "vector-lists")
    counts = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}  # a row per list
    lists = len(index.centres)
    parts = np.array([-(-counts.get(i, 0) // PART_ROWS) for i in range(lists)], dtype=np.int64)
    filled = np.array([counts.get(i, 0) for i in range(lists)], dtype=np.int64)

    def asked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in source:
            x = _unit(_matrix(batch.column(1), dims)) @ own.rotation
            order = np.argsort(-(x @ own.centres.T), axis=1, kind="stable")
            read = filled[order].cumsum(axis=1)
            enough = np.maximum(own.probes, (read < 20 * (k + 1)).sum(axis=1) + 1)
            at, where, part = [], [], []
            for i in range(len(x)):
                for one in order[i, : enough[i]].tolist():
                    for p in range(int(parts[one])):
                        at.append(i), where.append(one), part.append(p)
            which = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), pa.array(part, pa.int32()), pa.array([1] * len(at), pa.int32()), batch.column(0).take(which), batch.column(1).take(which)],
                names=["list", "part", "kind", "id", "vector"],
            )

    layout = "list int, part int, kind int, id long, vector array<double>"
    number = F.lit(0)
    for i in np.flatnonzero(parts > 1).tolist():
        number = F.when(F.col("list") == i, F.pmod(F.xxhash64("id"), F.lit(int(parts[i]))).cast("int")).otherwise(number)
    rowside = dealt.select("list", number.cast("int").alias("part"), F.lit(0).alias("kind"), "id", "vector")
    queryside = dealt.where("asks").select("id", "vector").mapInArrow(asked, layout)

    def scanned(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        held, gathered_ids, gathered, ready = None, [], [], None
        for batch in source:
            found: list[tuple[int, int, float]] = []
            at = np.stack([np.asarray(batch.column(i), dtype=np.int64) for i in range(3)], axis=1)
            if not len(at):
                continue
            ids, matrix = np.asarray(batch.column(3), dtype=np.int64), _matrix(batch.column(4), dims)
            edges = np.flatnonzero((np.diff(at, axis=0) != 0).any(axis=1)) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(at)], strict=True):
                place, kind = (int(at[s, 0]), int(at[s, 1])), int(at[s, 2])
                if place != held:
                    held, gathered_ids, gathered, ready = place, [], [], None
                if kind == 0:
                    gathered_ids.append(ids[s:e]), gathered.append(matrix[s:e])
                    continue
                if ready is None:
                    originals, members = np.concatenate(gathered), np.concatenate(gathered_ids)
                    turned = _unit(originals) @ own.rotation
                    blocks = [np.ascontiguousarray(turned[:, j : j + BLOCK]) for j in range(0, dims, BLOCK)]
                    ready = blocks, originals, np.sqrt((originals * originals).sum(axis=1)), members
                turned = _unit(matrix[s:e]) @ own.rotation
                for i in range(e - s):
                    scores, near = _scan(*ready, int(ids[s + i]), turned[i], matrix[s + i], k)
                    found += [(int(ids[s + i]), int(b), float(a)) for a, b in zip(scores, near, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())],
                names=["query_id", "vec_id", "score"],
            )

    both = rowside.union(queryside).repartition("list", "part").sortWithinPartitions("list", "part", "kind", "id")
    near = both.mapInArrow(scanned, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
