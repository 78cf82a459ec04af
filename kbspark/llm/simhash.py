"""SimHash near-duplicates by anchor points.

Fingerprints of 64 bits link when at most four bits differ; one half of the two then differs in at most two bits. Anchors are the words of a
covering code over a half: the perfect Hamming code of 31 bits, whose balls of radius one cover every word once, times the last bit. Two halves
that differ in at most two bits have a word between them at distance one from both at most, and that word's anchor lies within the covering
radius plus one of both. So each half is replicated to every anchor that its words at distance one at most are covered by: 17 at most, chosen
by the code and not by the data. Fingerprints are compared on all 64 bits within an anchor, and a group in an anchor gives the links of a
forest, not all its pairs. Every link of two different fingerprints within the threshold is found or spanned by others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import BROADCAST_ROWS, batches, extended, fresh, materialise, utf8

WORDS = 4  # words of a shingle
THRESHOLD = 4  # bits; the covering above is made for it
_SEED = 42
_BLOCK = 1 << 16  # shingles turned into bits at once
# Parity checks of the Hamming code: the syndrome of a word is the exclusive or of the positions (1 to 31) of its bits.
_POSITIONS = np.arange(1, 32, dtype=np.uint8)


def fingerprint(text: bytes) -> int:
    """SimHash of the word shingles of a text, repeats included; a text without words has fingerprint zero."""
    words = text.lower().split()  # bytes: A-Z and the ASCII white space alone
    if not words:
        return 0
    joined, width = b" ".join(words), min(WORDS, len(words))
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    n = len(words) - width + 1
    sums = np.zeros(64, dtype=np.int64)
    digest, seed = xxhash.xxh64_intdigest, _SEED
    for low in range(0, n, _BLOCK):
        high = min(n, low + _BLOCK)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[low:high], ends[low + width - 1 : high + width - 1], strict=True)], dtype="<u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * sums > n, bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the fingerprint as a signed long; a null text counts as one without words."""
    schema, at = extended(docs, **{name: "long"}), docs.columns.index(text)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            found = np.array([fingerprint(x) for x in utf8(batch.column(at))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def _syndromes(halves: np.ndarray) -> np.ndarray:
    """Syndrome of the low 31 bits: 0 for a code word, else the position of the bit that leads to one."""
    bits = np.unpackbits(halves.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :31]
    return np.bitwise_xor.reduce(bits * _POSITIONS, axis=1)


def anchors(halves: np.ndarray) -> np.ndarray:
    """For 32-bit halves, the anchors of all words at distance one at most; a row each, with repeats."""
    halves = halves.astype(np.uint32)
    syndrome = _syndromes(halves).astype(np.int64)
    power = np.concatenate([[0], 1 << np.arange(31, dtype=np.int64)]).astype(np.uint32)  # flip at a position; none at 0
    out = np.empty((len(halves), 33), dtype=np.uint32)
    for flip in range(32):
        out[:, flip] = halves ^ power[flip] ^ power[syndrome ^ flip]
    out[:, 32] = out[:, 0] ^ np.uint32(1 << 31)
    return out


def _dealt(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, 4096):
        signed = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = signed.view(np.uint64)
        for side in (0, 1):
            found = anchors((values >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            found.sort(axis=1)
            new = np.ones(found.shape, dtype=bool)
            new[:, 1:] = found[:, 1:] != found[:, :-1]
            row, column = np.nonzero(new)
            yield pa.RecordBatch.from_pydict({"anchor": found[row, column] | (side << 32), "fp": signed[row]})


_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.atleast_1d(a ^ b)
    return _POPCOUNT[x.view(np.uint16).reshape(*x.shape, 4)].sum(axis=-1)


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links of a forest that joins the distinct fingerprints of one anchor as all their pairs within the threshold would.

    A reached fingerprint is taken out of those left, so a dense group costs a few passes and not all its pairs.
    """
    links, left = [], values.astype(np.int64)
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = _apart(left, x) <= THRESHOLD
            if near.any():
                reached = left[near]
                links += [(int(x), int(y)) for y in reached]
                frontier += list(reached)
                left = left[~near]
    return links


def _compared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal anchors; the rows arrive sorted by anchor and fingerprint."""
    rest_a, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(a: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.diff(a)) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(a)]])
        found = []
        pairs = starts[ends - starts == 2]  # most shared anchors hold two
        if len(pairs):
            x, y = f[pairs], f[pairs + 1]
            near = _apart(x, y) <= THRESHOLD
            found += list(zip(x[near].tolist(), y[near].tolist(), strict=True))
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
            found += forest(f[s:e])
        table = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_pydict({"src": table.min(axis=1, initial=(1 << 63) - 1), "dst": table.max(axis=1, initial=-(1 << 63))})

    for batch in source:
        a = np.concatenate([rest_a, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([rest_f, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(a):
            continue
        cut = int(np.searchsorted(a, a[-1]))  # the last anchor may go on in the next batch
        if cut:
            yield links(a[:cut], f[:cut])
        rest_a, rest_f = a[cut:], f[cut:]
    if len(rest_a):
        yield links(rest_a, rest_f)


def near_links(fps: DataFrame) -> DataFrame:
    """Links (src < dst) between the distinct long fingerprints in the only column of ``fps``, enough to join what the threshold joins."""
    dealt = fps.mapInArrow(_dealt, "anchor long, fp long")
    parts = dealt.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return parts.mapInArrow(_compared, "src long, dst long").distinct()


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has a link: (node, root).

    Large-star and small-star rounds: every node's neighbours are hung on the smallest node seen, until nothing changes. A round is two
    groupings of the links with partial minima; a hub's neighbours are never gathered. Each round is written to the shared folder.
    """
    now = materialise(links.select("src", "dst").where("src <> dst"), "links")
    if now.isEmpty():
        return links.select(F.col("src").alias("node"), F.col("src").alias("root"))
    last = None
    while True:
        both = now.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(now.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every link now points to a smaller node
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        star = joined.select("u", "m").union(joined.where("v <> m").select(F.col("v").alias("u"), "m")).distinct()
        now = materialise(star.select(F.col("m").alias("src"), F.col("u").alias("dst")), "links")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == last:
            return now.select(F.col("dst").alias("node"), F.col("src").alias("root"))
        last = state


def membership(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A stored row per document: ``key``, ``fp``, ``text_hash``, ``component`` (the smallest key reachable over links) and ``stays``.

    Documents with one fingerprint are one node whatever their number, so copies are never paired. Null texts and texts without words share
    fingerprint zero. A null key is the smallest only if all keys of a component are null. Repeated rows stay; of rows with the smallest key,
    the one with the smallest hash of its text has ``stays``. An empty table gives an empty one.
    """
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    marked = materialise(with_fingerprint(own, "text", "fp").drop("text"), "fingerprints")
    rank = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("text_hash").alias("text_hash"))
    sizes = materialise(marked.groupBy("fp").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint-sizes")
    roots = components(near_links(sizes.select("fp")))
    classes = sizes.join(roots, sizes["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = classes.groupBy("root").agg(F.min("first").alias("least"))
    classes = materialise(classes.join(least, "root").select(F.col("fp").alias("f"), "n", "least"), "fingerprint-classes")
    same = F.col("key").eqNullSafe(F.col("least.key")) & (F.col("text_hash") == F.col("least.text_hash"))
    return _joined(marked, classes).select("key", "fp", "text_hash", F.col("least.key").alias("component"), same.alias("stays"))


def _joined(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """Give each row its class. Fingerprints that over a thousandth of all rows hold number a thousand at most: their rows meet a broadcast,
    and only the others are shuffled, so a fingerprint of a third of all rows does not fill one task."""
    total, count = classes.agg(F.sum("n"), F.count(F.lit(1))).first()
    if count <= BROADCAST_ROWS:
        return marked.join(F.broadcast(classes), F.col("fp") == F.col("f"))
    hot = F.col("n") > total // 1000
    few = classes.where(hot).select(F.col("f").alias("hot"), F.col("least").alias("hot_least"))
    first = marked.join(F.broadcast(few), F.col("fp") == F.col("hot"), "left")
    aside = first.where("hot IS NOT NULL").select(*marked.columns, F.col("hot_least").alias("least"))
    rest = first.where("hot IS NULL").join(classes.where(~hot), F.col("fp") == F.col("f")).select(*marked.columns, "least")
    return aside.union(rest)


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: ``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``; see :func:`membership`."""
    hexed = F.lpad(F.lower(F.hex(F.col("fp"))), 16, "0")
    return membership(docs, key, text).select(F.col("key").alias(key), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest key, all columns as they are."""
    member = materialise(membership(docs, key, text), "membership")
    stays = member.where("stays").select(F.col("key").alias("stay_key"), F.col("text_hash").alias("stay_hash"))
    (hashed,) = fresh(docs, "_text_hash")
    left = docs.withColumn(hashed, F.xxhash64(text))
    kept = left.join(stays, F.col(key).eqNullSafe(F.col("stay_key")) & (F.col(hashed) == F.col("stay_hash")), "left_semi")
    if stays.count() > stays.distinct().count():  # the same row several times
        kept = kept.dropDuplicates([key, hashed])
    return kept.drop(hashed)
