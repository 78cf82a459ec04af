"""Packing of tokenised documents into sequences by non-negative least squares.

Documents longer than a sequence are cut at whole sequences; what is left of each is one piece of 1 to 2047 ids. Short pieces of one length are
laid together in bundles, so that rounding costs them nothing. Lengths of pieces and bundles are counted in classes of a few ids. Combinations of up to three classes that fill a sequence are enumerated, and non-negative least squares finds how often
to repeat each so that together they use the counted pieces; the counts are rounded down. What they leave is packed greedily on the same
histogram. The plan is as large as the histogram and does not grow with the data. Pieces then find their place by their number within their
class.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import batches, materialise, numbered, salt_count

SEQUENCE = 2048
END = 1
UNIT = 8  # ids in a length class
SHORT = 64  # pieces up to this length are bundled
BUNDLE = 256  # ids in a bundle, at most
DEPTH = 3
VOCABULARY = "byte_bpe_50k"


class _Encoder:
    """Ids of whole texts. ``added`` has the tokens that a text is cut at before anything else."""

    def __init__(self, encode, added: dict[str, int]):
        self.encode = encode
        self.added = {token: _packed([i]) for token, i in added.items()}
        # of tokens that begin alike the longest is taken
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return np.frombuffer(array("I", ids), dtype=np.uintc).astype("<u4", copy=False).tobytes()


_loaded: dict[str, _Encoder] = {}


def encoder(vocabulary: str) -> _Encoder:
    """The vocabulary of ``<vocabulary>.json`` in its rank file, which gives the same ids several times faster; added tokens are those of the former."""
    if vocabulary not in _loaded:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        encoding = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[vocabulary] = _Encoder(encoding.encode_ordinary, added)
    return _loaded[vocabulary]


def encode(text: str, words: _Encoder) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit numbers, without the end. A string of an added token in the text is that token.

    A text is given to the vocabulary as a whole: keeping the ids of words costs more than finding them again, as most distinct words come once.
    """
    if any(token in text for token in words.added):
        return b"".join([words.added.get(part) or _packed(words.encode(part)) for part in words.cut.split(text)])
    return _packed(words.encode(text))


def pieces(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``key``, ``text_hash``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if asked for, the ids (binary).

    A null or empty text has the end id alone.
    """
    own = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = own.schema["key"].dataType.simpleString()
    out = f"key {schema}, text_hash long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        end = _packed([END])
        for batch in batches(source, 256):
            at, rows, ids = [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                doc = encode(t or "", words) + end
                n = len(doc) // 4
                for start in range(0, n, SEQUENCE):
                    part = doc[4 * start : 4 * (start + SEQUENCE)]
                    at.append(i)
                    rows.append((start, len(part) // 4, zlib.crc32(part), n))
                    if with_ids:
                        ids.append(part)
            numbers = np.array(rows, dtype=np.int64).reshape(-1, 4)
            which = pa.array(at, pa.int64())
            columns = [batch.column(0).take(which), batch.column(1).take(which), *[pa.array(numbers[:, k]) for k in range(4)]]
            names = ["key", "text_hash", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return own.mapInArrow(run, out)


def combinations(classes: int, depth: int = DEPTH) -> np.ndarray:
    """Class combinations of up to three that fill ``classes`` exactly, a row each, padded with zeros."""
    out = [(classes, 0, 0)]
    if depth >= 2:
        out += [(a, classes - a, 0) for a in range(1, classes // 2 + 1)]
    if depth >= 3:
        out += [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    return np.array(out, dtype=np.int64)


def non_negative_least_squares(columns: np.ndarray, target: np.ndarray, steps: int = 3) -> np.ndarray:
    """Active-set solution of min ||A x - target||, x >= 0, where a column of A counts the classes in a row of ``columns``.

    A column enters when it lowers the error, one that turns negative leaves; ``steps`` times the classes bound the rounds.
    """
    n = len(target) - 1
    x = np.zeros(len(columns))
    active: list[int] = []
    dense = np.zeros((len(target), 0))

    def column(j: int) -> np.ndarray:
        out = np.zeros(len(target))
        np.add.at(out, columns[j], 1.0)
        out[0] = 0.0
        return out

    goal = target.astype(float)
    goal[0] = 0.0
    residual = goal
    tolerance = 1e-7 * max(1.0, float(np.abs(target).max()))
    for _ in range(steps * n):
        gain = residual[columns].sum(axis=1)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        active.append(j)
        dense = np.column_stack([dense, column(j)])
        while True:
            z = np.linalg.solve(dense.T @ dense + 1e-9 * np.eye(len(active)), dense.T @ goal)
            if z.min() > 0:
                break
            now = x[active]
            bad = z <= 0
            ratio = np.full(len(z), np.inf)
            ratio[bad] = now[bad] / np.maximum(now[bad] - z[bad], 1e-12)
            now = now + min(1.0, float(ratio.min())) * (z - now)
            leave = bad & (now <= 1e-9 * max(1.0, float(np.abs(now).max()))) | (ratio <= ratio.min())
            x[active] = now
            x[np.array(active)[leave]] = 0.0
            active = [a for a, out in zip(active, leave, strict=True) if not out]
            dense = dense[:, ~leave]
            if not active:
                z = np.zeros(0)
                break
        x[:] = 0.0
        x[active] = z
        residual = goal - (dense @ z if active else 0.0)
    return x


def plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: pieces}, repeats) that use each counted piece once; ``histogram[c]`` pieces are of class c, from 1.

    The patterns from least squares come first, then those that take the largest class left and fill up with the largest that fit, each
    repeated as often as its pieces last. Each such pattern uses up a class, so they are as many as the classes at most.
    """
    left = histogram.astype(np.int64).copy()
    classes = len(left) - 1
    columns = combinations(classes)
    out = []
    used = columns[:, :, None] != 0
    present = (left[columns] > 0).astype(bool) | ~used[:, :, 0]
    columns = columns[present.all(axis=1)]
    if len(columns):
        x = np.floor(non_negative_least_squares(columns, left) + 1e-6).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            if x[j] <= 0:
                break
            pattern: dict[int, int] = {}
            for c in columns[j]:
                if c:
                    pattern[int(c)] = pattern.get(int(c), 0) + 1
            repeats = min(int(x[j]), *[int(left[c]) // m for c, m in pattern.items()])
            if repeats > 0:
                out.append((pattern, repeats))
                for c, m in pattern.items():
                    left[c] -= m * repeats
    while left.any():
        pattern, room = {}, classes
        for c in np.flatnonzero(left)[::-1].tolist():
            if m := min(room // c, int(left[c])):
                pattern[c] = m
                room -= c * m
        repeats = min(int(left[c]) // m for c, m in pattern.items())
        out.append((pattern, repeats))
        for c, m in pattern.items():
            left[c] -= m * repeats
    return out


def bundles(short: np.ndarray, histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Bundles of short pieces, ``short[n]`` pieces of length n, counted into ``histogram``, a bundle as a piece of its class.

    A row per length: (length, pieces, pieces in a full bundle, class of full bundles, the first's number in its class, and both for the last bundle,
    which has the rest).
    """
    rows = []
    for n in np.flatnonzero(short).tolist():
        per = BUNDLE // n
        full, rest = divmod(int(short[n]), per)
        c, c_rest = -(-per * n // UNIT), -(-rest * n // UNIT)
        first = int(histogram[c])
        histogram[c] += full
        rows.append((n, int(short[n]), per, c, first, c_rest, int(histogram[c_rest])))
        if rest:
            histogram[c_rest] += 1
    return rows


def pack(found: DataFrame) -> DataFrame:
    """Stored pieces with ``sequence_id`` and ``offset``. A sequence holds 2048 ids at most and is padded to that.

    An empty table gives an empty one; repeated rows are packed as often as they come. Null keys are a key like any other.
    """
    spark = found.sparkSession
    is_short = F.col("length") <= SHORT
    classed = found.withColumn("class", F.when(is_short, -F.col("length")).otherwise(F.ceil(F.col("length") / UNIT)).cast("int"))
    counted = classed.groupBy("class").agg(F.count(F.lit(1)).alias("n")).toPandas()
    classes, n = counted["class"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=np.int64)
    histogram, short = np.zeros(SEQUENCE // UNIT + 1, dtype=np.int64), np.zeros(SHORT + 1, dtype=np.int64)
    histogram[classes[classes > 0]], short[-classes[classes < 0]] = n[classes > 0], n[classes < 0]
    laid = bundles(short, histogram)
    rows, base, begin = [], 0, np.zeros(len(histogram), dtype=np.int64)
    for pattern, repeats in plan(histogram):
        for c, m in pattern.items():
            rows.append((c, int(begin[c]), int(begin[c]) + m * repeats, m, base))
            begin[c] += m * repeats
        base += repeats
    where = spark.createDataFrame(rows or [(0, 0, 0, 1, 0)], "plan_class int, from_n long, to_n long, each long, base long")
    together = spark.createDataFrame(laid or [(0, 0, 1, 0, 0, 0, 0)], "of_length int, pieces long, per long, full_class int, full_first long, rest_class int, rest_number long")
    placed = numbered(classed, ["class"], ["key", "text_hash", "start"], "n", salt_count(int(n.sum())))
    placed = placed.join(F.broadcast(together), -F.col("class") == F.col("of_length"), "left")  # a row per short length
    bundle = F.floor(F.col("n") / F.col("per"))
    in_full = (bundle + 1) * F.col("per") <= F.col("pieces")
    unit_class = F.when(F.col("class") > 0, F.col("class")).when(in_full, F.col("full_class")).otherwise(F.col("rest_class"))
    unit_number = F.when(F.col("class") > 0, F.col("n")).when(in_full, F.col("full_first") + bundle).otherwise(F.col("rest_number"))
    placed = placed.withColumns({"unit_class": unit_class, "unit_n": unit_number})
    inside = (F.col("unit_class") == F.col("plan_class")) & (F.col("unit_n") >= F.col("from_n")) & (F.col("unit_n") < F.col("to_n"))
    placed = placed.join(F.broadcast(where), inside).withColumn("sequence_id", F.col("base") + F.floor((F.col("unit_n") - F.col("from_n")) / F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy("unit_class", "unit_n", "n").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*found.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Cut, plan and place the documents of ``docs``; a row per piece, under the name of ``key``."""
    found = materialise(pieces(docs, key, text, vocabulary, with_ids), "pieces")
    return pack(found).withColumnRenamed("key", key)
