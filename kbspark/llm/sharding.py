"""Sharding by best-fit-decreasing bin packing.

Rows with equal texts are one group that is never split. Groups sorted by size each enter the bin with the least remaining capacity that still
holds them, found in a balanced tree of the remaining capacities; a bin is opened only if none does. For a given number of shards the smallest
capacity is sought at which they suffice.

Only groups above a small share of a shard are placed one by one; there can be no more of them than that share allows. The others are
dealt by hash into bundles of about that share, which are placed like groups, so that the packing on the driver has a bounded number of items
however many groups there are.
"""

from __future__ import annotations

from dataclasses import dataclass
from random import Random

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, materialise, numbered, salt_count

SHARDS = 40
# Bundles for each shard; a group larger than a shard divided by this is placed by itself.
BUNDLES = 512
ROW_BYTES = 16
_SEARCH = 24


@dataclass(slots=True)
class _Node:
    key: tuple[int, int]
    rank: float
    left: _Node | None = None
    right: _Node | None = None


class RemainingCapacities:
    """Balanced tree (a treap with repeatable ranks) of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self._root: _Node | None = None
        self._random = Random(7)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self._root, key)
        self._root = self._merge(self._merge(low, _Node(key, self._random.random())), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the smallest remaining capacity of at least ``size``, or None."""
        low, high = self._split(self._root, (size, -1))
        node = high
        if node is None:
            self._root = low
            return None
        while node.left is not None:
            node = node.left
        first, rest = self._split(high, (node.key[0], node.key[1] + 1))
        self._root = self._merge(low, rest)
        return node.key

    def _split(self, node: _Node | None, key: tuple[int, int]) -> tuple[_Node | None, _Node | None]:
        """Keys below ``key``, and the others."""
        if node is None:
            return None, None
        if node.key < key:
            node.right, high = self._split(node.right, key)
            return node, high
        low, node.left = self._split(node.left, key)
        return low, node

    def _merge(self, low: _Node | None, high: _Node | None) -> _Node | None:
        if low is None or high is None:
            return low or high
        if low.rank < high.rank:
            low.right = self._merge(low.right, high)
            return low
        high.left = self._merge(low, high.left)
        return high


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size, bins numbered as they are opened. Sizes above the capacity get a bin of their own."""
    tree, out, bins = RemainingCapacities(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_tightest(sizes[i])
        if found is None:
            found = (max(capacity, sizes[i]), bins)
            bins += 1
        out[i] = found[1]
        tree.add((found[0] - sizes[i], found[1]))
    return out


def balanced(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing bins at the smallest capacity found for which ``shards`` bins suffice."""
    if not sizes:
        return []
    low, high = max(max(sizes), -(-sum(sizes) // shards)), max(sizes) + -(-sum(sizes) // shards)
    best = best_fit_decreasing(sizes, low)
    if max(best) < shards:
        return best
    best = best_fit_decreasing(sizes, high)  # suffices: each bin but the last is filled to the average at least
    for _ in range(_SEARCH):
        middle = (low + high) // 2
        if middle in (low, high):
            break
        found = best_fit_decreasing(sizes, middle)
        if max(found) < shards:
            best, high = found, middle
        else:
            low = middle
    return best


def size_of(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def assign(docs: DataFrame, group: Column, size: Column, shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """``docs`` with ``shard``, from 0, so that equal values of ``group`` share one and the sums of ``size`` are as equal as groups allow.

    Null groups are one group. Groups are known by a 64-bit hash; two that share one merely stay together. No row is shuffled but those of
    the group sums. An empty table stays empty.
    """
    g, b, shard = fresh(docs, "_group", "_bundle", "shard")
    keyed = docs.withColumn(g, F.xxhash64(group))
    sums = materialise(keyed.groupBy(g).agg(F.sum(size).alias("bytes")), "shard-groups")
    total = sums.agg(F.sum("bytes")).first()[0] or 0
    share = max(1, total // (shards * bundles))
    large = materialise(sums.where(F.col("bytes") > share), "shard-large")  # fewer than shards * bundles rows
    part = F.pmod(F.col(g), F.lit(shards * bundles))
    small = sums.where(F.col("bytes") <= share).groupBy(part.alias(b)).agg(F.sum("bytes").alias("bytes"))
    singles = [(r[0], int(r[1])) for r in large.orderBy(F.desc("bytes"), g).collect()]
    bundled = [(r[0], int(r[1])) for r in small.orderBy(F.desc("bytes"), b).collect()]
    bins = balanced([s for _, s in singles] + [s for _, s in bundled], shards)
    spark = docs.sparkSession
    own = spark.createDataFrame([(k, i) for (k, _), i in zip(singles, bins, strict=False)], "large_group long, large_shard int")
    rest = spark.createDataFrame([(k, i) for (k, _), i in zip(bundled, bins[len(singles) :], strict=True)], "bundle long, bundle_shard int")
    out = keyed.withColumn(b, part)
    out = out.join(F.broadcast(own), F.col(g) == F.col("large_group"), "left").join(F.broadcast(rest), F.col(b) == F.col("bundle"), "left")
    return out.select(*docs.columns, F.coalesce("large_shard", "bundle_shard").alias(shard))


def shard_documents(docs: DataFrame, key: str, text: str, shards: int = SHARDS) -> DataFrame:
    """Per document: ``key``, ``size``, ``text_crc32``, ``shard`` and ``slot``, its number in the shard.

    A null text has no bytes and is in a group of its own with other nulls. Repeated rows get slots of their own.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    own = own.select(
        "key", size_of("text").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    own = materialise(own, "shard-documents")
    placed = materialise(assign(own, F.col("text_hash"), F.col("size"), shards), "shard-placed")
    out = numbered(placed, ["shard"], ["key", "text_hash"], "slot", salt_count(placed.count()))
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")
