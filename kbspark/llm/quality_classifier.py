"""Hierarchical empirical Bayes quality classifier.

A document's own evidence comes from logistic regressions, one for each thing that a good document must pass, over the features (hashed words and
thresholds of statistics) that grouped counts of the labelled sample find significant; a document is good if it passes all. The share of good documents of its host, and of its path below the host, is
estimated from all documents by grouped sums of their probabilities; the share of a sparse path is shrunk toward its host, that of a sparse
host toward the whole table. How strongly is itself estimated, by moments, from the spread between hosts and between paths. A document's own
probability is taken out of its groups before they are used as its prior, so nothing is counted twice.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches, extended, fresh, materialise, small, utf8

WORD_BUCKETS = 1 << 16
STAT_BINS = 16
STATS = ("letters", "upper", "digits", "symbols", "bars", "exclaims", "line_repeats", "next_repeats", "word_repeats", "mean_word", "length")
FEATURES = WORD_BUCKETS + STAT_BINS * len(STATS)
# Labelled documents used for fitting, about, however many there are; they are those with the smallest hash of their id.
FIT_ROWS = 20_000
# A regression is given at most this many features: the most significant ones by the root of their likelihood ratio statistic.
SELECTED, SIGNIFICANT = 2_000, 3.0
PENALTY = 0.3
_SYMBOLS = bytes(set(range(33, 127)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


def _share(part: float, whole: float) -> int:
    """Bin of a share between 0 and 1; the lowest bins are narrow."""
    if whole <= 0 or part <= 0:
        return 0
    return min(STAT_BINS - 1, 1 + int(14 * math.sqrt(min(1.0, part / whole))))


def _bins(text: bytes, words: list[bytes], distinct: int) -> list[int]:
    n, lines = len(text), [x for x in text.split(b"\n") if x.strip()]
    upper = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = n - len(text.translate(None, b"0123456789"))
    symbols = n - len(text.translate(None, _SYMBOLS))
    letters = n - digits - symbols - (n - len(text.translate(None, b" \t\n\r\x0b\x0c")))
    return [
        _share(letters, n), _share(upper, n), _share(digits, n), _share(symbols, n), _share(text.count(b"|"), n), _share(text.count(b"!"), n),
        _share(len(lines) - len(set(lines)), len(lines)), _share(sum(map(bytes.__eq__, words, words[1:])), len(words)),
        _share(len(words) - distinct, len(words)),
        min(STAT_BINS - 1, n // (len(words) or 1)), min(STAT_BINS - 1, int(math.log2(len(words) + 1))),
    ]


_buckets: dict[bytes, int] = {}


def _bucket(word: bytes) -> int:
    found = _buckets.get(word)
    if found is None:
        if len(_buckets) >= 200_000:
            _buckets.clear()
        found = _buckets[word] = zlib.crc32(word.strip(b".,;:!?\"'()[]").lower()) % WORD_BUCKETS
    return found


def features(text: bytes) -> np.ndarray:
    """Numbers of the distinct features of a text, increasing. A statistic has a feature for each bin up to its own."""
    words = text.split()
    distinct = set(words)
    own = set(map(_bucket, distinct))
    for i, b in enumerate(_bins(text, words, len(distinct))):
        at = WORD_BUCKETS + STAT_BINS * i
        own.update(range(at, at + b + 1))
    return np.array(sorted(own), dtype=np.int64)


@dataclass
class Evidence:
    """Of each regression, the weight of each feature and the intercept, in log-odds. The size does not depend on the data."""

    weights: np.ndarray
    intercepts: np.ndarray
    prior: float


def _counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: how many good and bad documents have each feature; feature -1 counts the documents."""
    counts, totals = np.zeros((2, FEATURES), dtype=np.int64), np.zeros(2, dtype=np.int64)
    for batch in batches(source):
        for text, good in zip(utf8(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            counts[good, features(text)] += 1
            totals[good] += 1
    if totals.any():
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_pydict({
            "feature": np.append(at, -1), "bad": np.append(counts[0, at], totals[0]), "good": np.append(counts[1, at], totals[1]),
        })


def _significance(n: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Root of the likelihood ratio statistic of having a feature against the class."""
    held, share = n.sum(axis=0), totals / totals.sum()
    part = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    terms = [part(n[c], held * share[c]) + part(totals[c] - n[c], (totals.sum() - held) * share[c]) for c in (0, 1)]
    return np.sqrt(np.maximum(0.0, 2 * (terms[0] + terms[1])))


def fit(labelled: DataFrame, text: str, passes: list[Column], key: Column) -> Evidence:
    """Fit the evidence on labelled documents, of which the caller gives a bounded sample; rows with a null in ``passes`` are left out.

    The features are counted by class in a grouping; only the numbers of the selected ones of each sampled document come to the driver.
    Where one class is missing, the evidence is constant: the share of rows that pass (a half if there are none).
    """
    names = [f"pass_{i}" for i in range(len(passes))]
    columns = [c.cast("int").alias(n) for c, n in zip(passes, names, strict=True)]
    chosen = labelled.select(F.col(text).alias("text"), F.xxhash64(key).alias("at"), *columns).dropna(subset=names)
    chosen = materialise(chosen, "classifier-fit").repartition(24, "at")
    heads = [_head(chosen.select("text", F.col(n).alias("good"))) for n in names]
    prior = chosen.agg(F.avg(F.least(*names, F.lit(1)).cast("double"))).first()[0]
    return Evidence(np.stack([w for w, _ in heads]), np.array([b for _, b in heads]), min(0.99, max(0.01, 0.5 if prior is None else prior)))


def _head(chosen: DataFrame) -> tuple[np.ndarray, float]:
    counted = (
        chosen.mapInArrow(_counted, "feature long, bad long, good long")
        .groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    )
    n, totals = np.zeros((2, FEATURES)), np.zeros(2)
    for feature, bad, ok in counted.itertuples(index=False):
        if feature < 0:
            totals[:] = bad, ok
        else:
            n[:, int(feature)] = bad, ok
    if not totals.all():
        share = min(0.99, max(0.01, float(totals[1] / totals.sum()))) if totals.any() else 0.5
        return np.zeros(FEATURES), float(np.log(share / (1 - share)))
    found = _significance(n, totals)
    selected = np.sort(np.argsort(-found, kind="stable")[:SELECTED])
    selected = selected[found[selected] >= SIGNIFICANT]

    def listed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            own = [np.flatnonzero(np.isin(selected, features(x))).astype(np.int32) for x in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], names=["features", "good"])

    rows = chosen.mapInArrow(listed, "features array<int>, good int").toPandas()
    own, intercept = _regression([np.asarray(x, dtype=np.int64) for x in rows["features"]], rows["good"].to_numpy(float), len(selected))
    weights = np.zeros(FEATURES)
    weights[selected] = own
    return weights, intercept


def _regression(rows: list[np.ndarray], y: np.ndarray, width: int, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty on 0/1 features, by gradient steps scaled to each feature."""
    column = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    w, b = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    often = np.bincount(column, minlength=width) * 0.25 + PENALTY
    mean, square, rate = np.zeros(width + 1), np.zeros(width + 1), 0.05
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], minlength=len(rows)) + b, -30, 30)))
        gradient = np.append((np.bincount(column, (p - y)[row], minlength=width) + PENALTY * w) / often, (p - y).mean())
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient * gradient
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if step % 100 == 0:
            rate /= 3
    return w, float(b)


def score(df: DataFrame, text: str, model: Evidence, name: str) -> DataFrame:
    """``df`` with the log-odds that a document's own features give it, in column ``name``. A null text counts as empty."""
    schema = extended(df, **{name: "double"})
    weights = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.weights.T))
    intercepts, at = model.intercepts, df.columns.index(text)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weights.value
        for batch in batches(source):
            heads = np.array([own[features(x)].sum(axis=0) + intercepts for x in utf8(batch.column(at))]).reshape(-1, len(intercepts))
            passing = -np.logaddexp(0, -heads).sum(axis=1)  # log of the chance to pass all
            failing = np.log(np.maximum(-np.expm1(passing), 1e-12))
            out = pa.array(np.clip(passing - failing, -27, 27), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return df.mapInArrow(run, schema)


def _strength(groups: DataFrame, total: str, good: str, prior: Column) -> float:
    """How many documents the prior of a group weighs, from the spread of the groups' shares around it (method of moments)."""
    share = F.col(good) / F.col(total)
    many = groups.where(F.col(total) >= 2)
    row = many.agg(
        F.count(F.lit(1)).alias("groups"), F.avg(prior * (1 - prior)).alias("binomial"),
        F.avg((share - prior) * (share - prior)).alias("spread"), F.avg(1 / F.col(total)).alias("inverse"),
    ).first()
    if not row["groups"] or not row["binomial"]:
        return 100.0
    noise = row["binomial"] * row["inverse"]
    between = max(row["spread"] - noise, row["binomial"] * 1e-4)
    return float(min(10_000.0, max(2.0, row["binomial"] / between - 1)))


def classify(docs: DataFrame, text: str, host: Column, path: Column, model: Evidence, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``evidence``, ``site_prior``, ``quality`` (posterior probability) and ``kept``.

    A null text counts as empty, a null host or path is a group of its own. Equal rows are kept apart and get equal answers. An empty table
    gives an empty table. New columns get a leading underscore where their names would clash.
    """
    h, p, own, evidence = fresh(docs, "_host", "_path", "_own", "evidence")
    prior, quality, kept = fresh(docs, "site_prior", "quality", "kept")
    with_keys = docs.withColumns({h: F.coalesce(host.cast("string"), F.lit("\0")), p: F.coalesce(path.cast("string"), F.lit("\0"))})
    chance = lambda x: 1 / (1 + F.exp(-x))
    scored = score(with_keys, text, model, evidence)
    scored = scored.withColumn(own, chance(F.col(evidence)))
    # The texts are read twice instead of being stored: the first reading leaves one row per path.
    paths = materialise(
        scored.groupBy(h, p).agg(F.count(F.lit(1)).alias("path_n"), F.sum(own).alias("path_good")), "classifier-paths"
    )
    hosts = paths.groupBy(h).agg(F.sum("path_n").alias("host_n"), F.sum("path_good").alias("host_good"))
    hosts = materialise(hosts, "classifier-hosts")
    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_good").alias("good")).first()
    mean = min(0.999, max(0.001, whole["good"] / whole["n"])) if whole["n"] else model.prior
    k_host = _strength(hosts, "host_n", "host_good", F.lit(mean))
    host_share = (F.col("host_good") + k_host * mean) / (F.col("host_n") + k_host)
    groups = paths.join(small(hosts), h)
    k_path = _strength(groups, "path_n", "path_good", host_share)
    groups = groups.select(
        F.col(h).alias("g_host"), F.col(p).alias("g_path"), "path_n", "path_good", "host_n", "host_good"
    )
    on = (F.col(h) == F.col("g_host")) & (F.col(p) == F.col("g_path"))
    joined = scored.join(small(materialise(groups, "classifier-groups")), on)
    rest = F.greatest(F.col("host_n") - 1, F.lit(0))
    host_other = (F.greatest(F.col("host_good") - F.col(own), F.lit(0.0)) + k_host * mean) / (rest + k_host)
    path_other = (F.greatest(F.col("path_good") - F.col(own), F.lit(0.0)) + k_path * host_other) / (F.col("path_n") - 1 + k_path)
    logit = lambda x: F.log(x / (1 - x))
    safe = F.least(F.greatest(path_other, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = chance(F.col(evidence) + logit(safe) - logit(F.lit(mean)))
    return joined.withColumn(prior, safe).withColumn(quality, posterior).withColumn(kept, F.col(quality) >= threshold).select(
        *docs.columns, evidence, prior, quality, kept
    )
