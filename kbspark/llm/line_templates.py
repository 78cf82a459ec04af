"""Line dedup by a log-template tree of fixed depth.

A line is parsed into tokens. The first level of the tree is the number of tokens, the next levels are the leading tokens; tokens that hold a
digit are variable fields everywhere. A template needs literal tokens: one of the leading tokens and half of all. Lines of numbers, which have
too few of them, are compared by their exact tokens. Below a leaf a line stands for its own tokens and for the templates in which one of a few contiguous
fields of the rest is variable. A line too short for such fields may vary in any one token, a leading one too; each of these templates is a leaf
of its own, as the others of its leaf would not share its leading tokens. Templates are hashes, so a leaf is never gathered: its lines meet by
grouping alone.

A template recurs when it is found in enough unlike documents. Documents are alike if links between SimHash fingerprints join them, the same
ones that near-duplicate removal goes by, so no line decides alone and lines that occur together do not hide each other. Copies of whole
documents keep their lines and are left to near-duplicate removal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import simhash
from .common import BROADCAST_ROWS, batches, extended, fresh, materialise, small, utf8

MIN_TOKENS = 3  # shorter lines are left alone
LEADING = 3  # leading tokens in the tree
FIELDS = 4  # fields of the rest that may vary, one at a time
MIN_DOCS = 8  # unlike documents in which a recurring template is found
LONG_TOKENS = 50  # lines from here on are passages
LONG_DOCS = 3  # unlike documents in which a recurring passage is found
VARIABLE = b"<*>"
_DIGIT = re.compile(rb"[0-9]")
_NO_LETTERS = bytes(b for b in range(128) if b != 32 and not chr(b).isalpha())


def _hash(parts: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(parts)) - (1 << 63)


def _literal(parts: list[bytes]) -> int:
    """How many tokens hold a letter and are not variable."""
    return len(b" ".join(parts).translate(None, _NO_LETTERS).split())


def _enough(parts: list[bytes]) -> bool:
    """Whether the literal tokens make a template."""
    return _literal(parts[:LEADING]) > 0 and 2 * _literal(parts) >= len(parts)


def tokens(line: bytes) -> list[bytes]:
    """Tokens of a line, those with a digit as variable fields; all as they are if too few literal ones would be left."""
    found = line.split()
    if not _DIGIT.search(line):
        return found
    parts = [VARIABLE if _DIGIT.search(t) else t for t in found]
    return parts if _enough(parts) else found


def leaf(parts: list[bytes]) -> int:
    return _hash([b"%d" % len(parts), *parts[:LEADING]])


def branches(parts: list[bytes]) -> list[tuple[int, int]]:
    """The templates that a line stands for, each with its leaf: its own tokens, then one variable field each where enough literal tokens are left."""
    at = leaf(parts)
    own = [(at, _hash([b"0", *parts]))]
    rest, left = len(parts) - LEADING, _literal(parts)
    if _DIGIT.search(b" ".join(parts)) or left < len(parts) and not _enough(parts):
        return own  # digits are left in exact lines only
    if rest < FIELDS:
        for j, token in enumerate(parts):
            still = left - _literal([token])
            if still >= 2 and 2 * still >= len(parts) and token != VARIABLE:
                template = _hash([b"%d" % (j + 1), *parts[:j], VARIABLE, *parts[j + 1 :]])
                own.append((template, template))
        return own
    for j in range(FIELDS):
        a, b = LEADING + rest * j // FIELDS, LEADING + rest * (j + 1) // FIELDS
        if left < len(parts) and 2 * (left - _literal(parts[a:b])) < len(parts):
            continue
        own.append((at, _hash([b"%d" % (j + 1), *parts[:a], *[VARIABLE] * (b - a), *parts[b:]])))
    return own


def templates(parts: list[bytes]) -> list[int]:
    return [t for _, t in branches(parts)]


def parsed(text: bytes) -> dict[int, list[bytes]]:
    """Distinct lines of a text by the hash of their tokens; short lines are left out."""
    out = {}
    for line in text.split(b"\n"):
        parts = tokens(line)
        if len(parts) >= MIN_TOKENS:
            out.setdefault(_hash([b"0", *parts]), parts)
    return out


def _leaves(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source):
        found = []
        for text in utf8(batch.column(0)):
            for p in parsed(text).values():
                if len(p) >= LEADING + FIELDS:
                    found.append((leaf(p), len(p) >= LONG_TOKENS))
                else:
                    found += [(x, False) for x in {x for x, _ in branches(p)}]
        yield pa.RecordBatch.from_pydict({"leaf": pa.array([x for x, _ in found], pa.int64()), "long": pa.array([x for _, x in found], pa.bool_())})


def _members(lookup):
    """Of each line in one of the sorted leaves: its templates, with the fingerprint of its document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = frozenset(lookup.value.tolist()) if lookup is not None else None
        for batch in batches(source, 256):
            rows: list[tuple[int, int, int, int]] = []
            for text in utf8(batch.column(0)):
                own = []
                for parts in parsed(text).values():
                    if len(parts) < LEADING + FIELDS:
                        own += [(x, t, False) for x, t in branches(parts) if leaves is None or x in leaves]
                    elif leaves is None or leaf(parts) in leaves:
                        own += [(x, t, len(parts) >= LONG_TOKENS) for x, t in branches(parts)]
                if own:
                    fp = simhash.fingerprint(text)
                    fp -= (fp >> 63) << 64
                    rows += [(*x, fp) for x in own]
            table = np.array(rows, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_pydict({"leaf": table[:, 0], "template": table[:, 1], "long": table[:, 2] > 0, "fp": table[:, 3]})

    return run


def recurring(docs: DataFrame, text: str, min_docs: int = MIN_DOCS) -> DataFrame:
    """Hashes of the recurring templates, stored: found in at least ``min_docs`` unlike documents, however many copies of some of them there are.
    For lines of ``LONG_TOKENS`` tokens on, ``LONG_DOCS`` documents are enough. A document without other lines counts like any other.

    The leaves with fewer lines than that cannot hold one and go first, so that only their counts and not their templates are shuffled. Links
    are looked for between the documents that have a line in one of the other leaves.
    """
    texts = docs.select(F.col(text).alias("text"))
    needed = F.when(F.col("long"), F.lit(min(min_docs, LONG_DOCS))).otherwise(F.lit(min_docs))
    leaves = texts.mapInArrow(_leaves, "leaf long, long boolean").groupBy("leaf", "long").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= needed)
    leaves = materialise(leaves.select("leaf"), "line-leaves")
    lookup = sorted_values(leaves, "leaf")
    members = texts.mapInArrow(_members(lookup), "leaf long, template long, long boolean, fp long")
    if lookup is None:
        members = members.join(leaves, "leaf", "left_semi")
    # copies with one fingerprint are one row here, so neither a hot document nor a hot line fills a task
    held = materialise(members.select("template", "long", "fp").distinct(), "line-members")
    roots = materialise(simhash.components(simhash.near_links(held.select("fp").distinct())), "line-roots")
    found = (
        held.join(small(roots), F.col("fp") == F.col("node"), "left")
        .select("template", "long", F.coalesce("root", "fp").alias("group")).distinct()
        .groupBy("template", "long").agg(F.count(F.lit(1)).alias("unlike")).where(F.col("unlike") >= needed).select("template")
    )
    return materialise(found, "line-templates")


def sorted_values(df: DataFrame, column: str, limit: int = 10 * BROADCAST_ROWS):
    """The values of a long column as a broadcast sorted array if Spark counts at most ``limit`` rows, else None."""
    if df.count() > limit:
        return None
    values = np.sort(df.select(column).toPandas()[column].to_numpy(dtype=np.int64))
    return df.sparkSession.sparkContext.broadcast(values)


def drop_lines(docs: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """``docs`` without the lines that stand for a template in ``found``; ``n_lines``, ``n_dropped`` are added.

    Other lines stay as they are, in order, empty ones too. A null text stays null (no lines), an empty text has one line. Equal rows get
    equal answers; an empty table stays empty. New columns get a leading underscore where their names would clash.
    """
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    schema = extended(docs, **{n_lines: "long", n_dropped: "long"})
    at = docs.columns.index(text)
    lookup = sorted_values(found, "template")
    if lookup is not None:
        return docs.mapInArrow(_dropping(at, None, lookup, [n_lines, n_dropped]), schema)
    # Too many templates for one array: each text learns from a join which of its own templates recur, one row per text and recurring template.
    (key, hits) = fresh(docs, "_text_key", "_hits")
    keyed = docs.withColumn(key, F.struct(F.xxhash64(text), F.md5(F.col(text))))
    own = keyed.select(key, F.col(text).alias("text")).dropDuplicates([key]).mapInArrow(_own_templates, _key_schema(keyed, key))
    held = own.join(found, "template", "left_semi").groupBy("key").agg(F.collect_set("template").alias(hits))
    joined = keyed.join(held, F.col(key) == F.col("key"), "left").select(*docs.columns, hits)
    return joined.mapInArrow(_dropping(at, len(docs.columns), None, [n_lines, n_dropped]), schema)


def _key_schema(df: DataFrame, key: str):
    from pyspark.sql.types import LongType, StructType

    return StructType().add("key", df.schema[key].dataType).add("template", LongType())


def _own_templates(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, 64):
        at, found = [], []
        for i, text in enumerate(utf8(batch.column(1))):
            for parts in parsed(text).values():
                for t in templates(parts):
                    at.append(i)
                    found.append(t)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], names=["key", "template"])


def _dropping(at: int, hits_at: int | None, lookup, names: list[str]):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = frozenset(lookup.value.tolist()) if lookup is not None else frozenset()
        for batch in batches(source):
            hits = batch.column(hits_at).to_pylist() if hits_at is not None else None
            texts, lines, dropped = [], [], []
            for i, text in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                if text is None:
                    texts.append(None), lines.append(0), dropped.append(0)
                    continue
                own = set(hits[i] or ()) if hits is not None else everywhere
                kept, n = [], 0
                for line in text.split(b"\n"):
                    n += 1
                    parts = tokens(line)
                    if len(parts) < MIN_TOKENS or own.isdisjoint(templates(parts)):
                        kept.append(line)
                texts.append(b"\n".join(kept)), lines.append(n), dropped.append(n - len(kept))
            columns = list(batch.columns[:hits_at] if hits_at is not None else batch.columns)
            columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
                names=[*(batch.schema.names[:hits_at] if hits_at is not None else batch.schema.names), *names],
            )

    return run


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    return drop_lines(docs, text, recurring(docs, text, min_docs))
