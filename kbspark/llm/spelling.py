"""Spelling variants by a bit-sliced position index.

For a set of words, the index holds one bitset per (position, letter): the words with that letter there. A query is read letter by letter and
four sets of words move along with it, all words at once: those that agree so far, and those that are apart by one replaced, one inserted or
one deleted letter so far. The last two look one position further on or back. What is left at the end are the words one edit away.

The vocabulary is never compared with itself as a whole. Two words that are one edit apart share the first or the last half of the shorter
one, so words meet in groups by half and length. A group too large for one index is cut into parts; a word is indexed in one part and asks all
of them. The sets of an index are ordered by count, so the lowest bit of an answer is the most frequent near word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batches, materialise, small

LETTERS = 7  # code points that a word must have
LEAST = 2  # occurrences that a word must have
RATIO = 10  # how many times as frequent a form must be
PART_WORDS = 2048  # words in one index
PART_LETTERS = 1 << 18
_ASK = 1024  # queries asked at once
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_DISTINCT = 200_000  # words that a counting task holds before it passes them on


def word_counts(docs: DataFrame, key: str, text: str, letters: int = LETTERS, drop_every: int | None = None) -> DataFrame:
    """Words of ``letters`` code points or more and their occurrences: (word, n). Only A-Z are lower-cased; a null text has no words.

    ``drop_every`` plants misspellings: where it divides the crc32 of ``<key>:<run>``, the run loses the letter at crc32 modulo its length. A
    null key is written as nothing there. Repeated rows count as often as they come; an empty table gives an empty one.
    """
    own = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches(source, 256):
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if k is None else k}:".encode())
                for word, n in Counter(_RUN.findall((t or "").encode().lower().decode())).items():
                    if len(word) < letters:
                        continue
                    if drop_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < letters:
                                continue
                    total[word] += n
                if len(total) >= _DISTINCT:
                    yield _counted(total)
                    total = Counter()
        if total:
            yield _counted(total)

    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def _packed(rows: np.ndarray) -> np.ndarray:
    """Boolean rows as rows of 64-bit words."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 64) * 64), dtype=bool)
    wide[:, : rows.shape[1]] = rows
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _letters(words: list[str], width: int) -> np.ndarray:
    """Code points, a row per word, zeros behind its end."""
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


class Index:
    """Bitsets per position and letter over words of ``shorter`` and ``shorter + 1`` letters. Positions are built when first needed and only
    three are held, since a query looks one position back and one on."""

    def __init__(self, words: list[str], shorter: int):
        self.points = _letters(words, shorter + 1)
        self.shorter = shorter
        longer = np.array([len(w) > shorter for w in words])
        self.long, self.short = _packed(longer[None, :])[0], _packed(~longer[None, :])[0]
        self.planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def with_letter(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each query letter, the words that have it at ``position``."""
        if position not in self.planes:
            if len(self.planes) > 64:
                self.planes = {p: v for p, v in self.planes.items() if p >= position - 2}
            column = self.points[:, position]
            found = np.unique(column)
            rows = _packed(found[:, None] == column[None, :])
            self.planes[position] = found, np.vstack([rows, np.zeros((1, rows.shape[1]), dtype=np.uint64)])
        found, rows = self.planes[position]
        at = np.minimum(np.searchsorted(found, letters), len(found) - 1)
        return rows[np.where(found[at] == letters, at, len(found))]

    def near(self, queries: list[str], same_start: int) -> np.ndarray:
        """Bitsets of the words one edit from each query, for queries of one length.

        Queries of the shorter length find words of their length and one letter more, longer ones find words with one letter less; two words
        of the longer length meet in another group. Words that share the first ``same_start`` letters with the query are left out (0: none).
        """
        length = len(queries[0])
        points = _letters(queries, length)
        is_short = length == self.shorter
        agree = np.repeat((self.long | self.short)[None, :], len(queries), axis=0)
        replaced, moved = np.zeros_like(agree), agree if is_short else np.zeros_like(agree)
        start = None
        for i in range(length):
            here = points[:, i]
            if is_short:
                has = self.with_letter(i, here)
                replaced = (replaced & has) | (agree & ~has)
                agree = agree & has
                moved = (moved & self.with_letter(i + 1, here)) | agree  # words with one letter inserted
            else:
                moved = (moved & self.with_letter(i - 1, here)) | agree if i else agree  # words with one letter deleted
                if i < self.shorter:
                    agree = agree & self.with_letter(i, here)
            if i + 1 == same_start:
                start = agree
            if i % 64 == 63 and not (agree.any() or replaced.any() or moved.any()):
                break
        out = (replaced & self.short) | (moved & self.long) if is_short else moved & self.short
        return out if start is None else out & ~start


def _lowest(rows: np.ndarray) -> np.ndarray:
    """Number of the lowest bit of each row; the rows are not empty."""
    first = (rows != 0).argmax(axis=1)
    word = rows[np.arange(len(rows)), first]
    return first * 64 + np.bitwise_count((word & (~word + np.uint64(1))) - np.uint64(1)).astype(np.int64)


class _Group:
    """Words of one part; ``ask`` answers with (word, near words, count of the best, the best)."""

    def __init__(self, key: tuple[int, int, int, int]):
        self.at_end, self.shorter = key[1] == 1, key[2]
        self.words: list[str] = []
        self.counts: list[int] = []
        self.waiting: list[str] = []
        self.index: Index | None = None

    def ask(self, queries: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, list[str]]]:
        if len(self.words) + (self.index is None) < 2 and queries == self.words:
            return
        self.index = self.index or Index(self.words, self.shorter)
        counts = np.array(self.counts, dtype=np.int64)
        for longer in (False, True):
            own = [q for q in queries if (len(q) > self.shorter) == longer]
            for low in range(0, len(own), _ASK):
                part = own[low : low + _ASK]
                rows = self.index.near(part, self.shorter // 2 if self.at_end else 0)
                some = np.flatnonzero(rows.any(axis=1))
                if len(some):
                    best = _lowest(rows[some])
                    n = np.bitwise_count(rows[some]).sum(axis=1, dtype=np.int64)
                    yield [part[i] for i in some], n, counts[best], [self.words[b] for b in best]


def _compared(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words within runs of equal (bucket, at_end, shorter, part). In a run the indexed words come first, by falling count, then word."""
    group: _Group | None = None
    key: tuple[int, int, int, int] | None = None

    def answers(done: _Group, queries: list[str]) -> Iterator[pa.RecordBatch]:
        for words, n, best_n, best in done.ask(queries):
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n_near": n, "best_n": best_n, "best": pa.array(best, pa.string())})

    def closing(done: _Group | None) -> Iterator[pa.RecordBatch]:
        if done is not None and done.words and len(done.words) + len(done.waiting) > 1:
            yield from answers(done, done.words)
            if done.waiting:
                yield from answers(done, done.waiting)

    for batch in source:
        numbers = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
        if not len(numbers):
            continue
        edges = np.flatnonzero((numbers[1:] != numbers[:-1]).any(axis=1)) + 1
        indexed = batch.column(4).to_numpy(zero_copy_only=False)
        words, counts = batch.column(5).to_pylist(), batch.column(6).to_pylist()
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)], strict=True):
            if tuple(numbers[a].tolist()) != key:
                yield from closing(group)
                key = tuple(numbers[a].tolist())
                group = _Group(key)
            many = a + int(indexed[a:b].sum())
            group.words += words[a:many]
            group.counts += counts[a:many]
            group.waiting += words[many:b]
            if len(group.waiting) >= _ASK:  # all indexed words have come
                if group.words:
                    yield from answers(group, group.waiting)
                group.waiting = []
    yield from closing(group)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """For words of a stored table (word, n), the number of near words and the best of them: (word, n_near, best_n, best).

    ``best`` has the largest n, of equals the smallest in code-point order. Several rows may come for a word; near words are counted in one
    only. Words without near words do not appear.
    """
    length = F.char_length("word")
    keys = []
    for shorter in (length, length - 1):
        half = F.floor(shorter / 2).cast("int")
        for at_end, share in ((0, F.substring("word", F.lit(1), half)), (1, F.substring("word", F.lit(1) + length - half, half))):
            key = F.struct(F.lit(at_end).alias("at_end"), shorter.alias("shorter"), F.xxhash64(F.lit(at_end), shorter, share).alias("bucket"))
            keys.append(F.when((shorter > 0) & (half >= at_end), key))  # a single letter has no last half
    met = vocabulary.select("word", "n", F.explode(F.array_compact(F.array(*keys))).alias("k")).select("word", "n", "k.*")
    room = F.greatest(F.ceil(F.count(F.lit(1)) / PART_WORDS), F.ceil(F.sum(length) / PART_LETTERS)).cast("int")
    large = materialise(met.groupBy("bucket").agg(room.alias("parts")).where("parts > 1").withColumnRenamed("bucket", "large"), "large-groups")
    dealt = met.join(small(large), F.col("bucket") == F.col("large"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    asked = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    indexed = F.pmod(F.xxhash64("word"), F.col("parts")) == F.col("part")
    rows = asked.select("bucket", "at_end", "shorter", "part", indexed.alias("indexed"), "word", "n")
    order = ["bucket", "at_end", "shorter", "part", F.desc("indexed"), F.desc("n"), "word"]
    return rows.repartition("bucket", "part").sortWithinPartitions(*order).mapInArrow(_compared, "word string, n_near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """The last form that each word of (word, form) leads to: (word, root).

    Paths are doubled until none grows. A form is more frequent than its word by a factor, so a path ends, after five doublings at most.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("from_word"), F.col("root").alias("further"))
        step = now.join(further, F.col("root") == F.col("from_word"), "left")
        now = materialise(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(vocabulary: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Every word of (word, n) with its form and root: (word, n, n_near, form, form_n, root).

    A word's form is its best near word if that is at least ``ratio`` times as frequent, else null; the root is the last form from the word
    on, the word itself if it has none. Null words and counts are left out, a word that comes several times counts with the sum. An empty
    table gives an empty one.
    """
    known = vocabulary.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    known = materialise(known, "vocabulary")
    found = near_words(known).select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("m"), "best").alias("top"))
    none = F.lit(None).cast(found.schema["top"].dataType)
    both = known.select("word", "n", F.lit(0).cast("long").alias("n_near"), none.alias("top")).union(found)
    best = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("top").alias("top"))
    enough = -F.col("top.m") >= ratio * F.col("n")
    told = best.select("word", "n", "n_near", F.when(enough, F.col("top.best")).alias("form"), F.when(enough, -F.col("top.m")).alias("form_n"))
    told = materialise(told, "forms")
    ends = roots(told.where("form IS NOT NULL")).withColumnRenamed("word", "rooted")
    out = told.join(ends, F.col("word") == F.col("rooted"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
