"""Learned decision lists over text statistics.

Rules are conjunctions of thresholds, grown on one part of the labelled statistics by information gain and pruned on the other; each accepted
rule covers the rejected documents it explains, and the next one is grown on what is left. The list becomes one ordered Spark conditional
expression, so that it can be read, stored and applied without Python.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import batches, extended, utf8

# The characters counted as symbols and the base thresholds.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_punct", "n_same_next")
# What rules may test: shares made from the counts, so that a rule means the same for a long text.
TESTED = {
    "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"), "punct_share": ("n_punct", "word_chars"),
    "same_next_share": ("n_same_next", "n_words"), "mean_word": ("word_chars", "n_words"), "words": ("n_words", None),
}
# Labelled rows used for learning, about, however many there are; they are those with the smallest hash of their id.
FIT_ROWS = 20_000
_PUNCTUATION = bytes(set(range(33, 127)) - set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
_CONTINUATION = bytes(range(0x80, 0xC0))


def counts(text: bytes) -> tuple[int, ...]:
    """The base counts and the further counts of one whole text, in the order of BASE and MORE."""
    words = text.split()
    n = len(words)
    body = b"".join(words)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (
        n, len(body.translate(None, _CONTINUATION)), len(body) - len(body.translate(None, SYMBOLS)), dup, repeated,
        lines, len(body) - len(body.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(body) - len(body.translate(None, b"0123456789")),
        len(body) - len(body.translate(None, _PUNCTUATION)), sum(map(bytes.__eq__, words, words[1:])),
    )


def free_prefix(df: DataFrame, prefix: str = "") -> str:
    """``prefix``, behind as many underscores as it takes that no new column has the name of one of ``df``."""
    taken = {c.lower() for c in df.columns}
    while taken.intersection(prefix + x for x in (*BASE, *MORE, "base_failed", "rule", "kept")):
        prefix = f"_{prefix}"
    return prefix


def with_counts(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """``df`` with the counts of its texts as long columns under :func:`free_prefix`; a null text counts as empty. Repeated rows get the same
    counts, an empty table stays empty."""
    prefix = free_prefix(df, prefix)
    names = [prefix + x for x in (*BASE, *MORE)]
    schema = extended(df, **dict.fromkeys(names, "long"))
    at = df.columns.index(text)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            rows = np.array([counts(x) for x in utf8(batch.column(at))], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(rows[:, i]) for i in range(len(names))]], names=[*batch.schema.names, *names]
            )

    return df.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def tested(name: str, prefix: str = "") -> Column:
    part, whole = TESTED[name]
    top = F.col(prefix + part).cast("double")
    return top if whole is None else F.when(F.col(prefix + whole) > 0, top / F.col(prefix + whole)).otherwise(0.0)


@dataclass
class Rule:
    """All tests hold: (statistic, '<=' or '>', threshold). ``covered`` and ``right`` are counts on the learning rows."""

    tests: list[tuple[str, str, float]]
    covered: int = 0
    right: int = 0

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, sign, value in self.tests:
            x = tested(name, prefix)
            out = out & (x <= value if sign == "<=" else x > value)
        return out

    def text(self) -> str:
        return " AND ".join(f"{n} {s} {v:.6g}" for n, s, v in self.tests)


@dataclass
class DecisionList:
    """Ordered rules that reject; a document that none covers is kept."""

    rules: list[Rule] = field(default_factory=list)

    def rule_number(self, prefix: str = "") -> Column:
        """Number of the first rule that covers a row, from 1; 0 if none does."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            out = F.when(rule.column(prefix), i) if out is None else out.when(rule.column(prefix), i)
        return F.lit(0) if out is None else out.otherwise(0)


def _mask(x: np.ndarray, names: list[str], tests: list[tuple[str, str, float]]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for name, sign, value in tests:
        column = x[:, names.index(name)]
        out &= column <= value if sign == "<=" else column > value
    return out


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], cuts: int, depth: int) -> list[tuple[str, str, float]]:
    """Add the test with the highest information gain until no good row is covered, or no test gains."""
    tests: list[tuple[str, str, float]] = []
    live = np.ones(len(x), dtype=bool)
    while len(tests) < depth:
        p, n = int(bad[live].sum()), int((~bad[live]).sum())
        if p == 0 or n == 0:
            break
        now, best = np.log2(p / (p + n)), (1e-9, None)
        for j, name in enumerate(names):
            values = np.unique(x[live, j])
            if len(values) < 2:
                continue
            at = values if len(values) <= cuts else np.unique(np.quantile(values, np.linspace(0, 1, cuts)))
            for cut in (at[:-1] + at[1:]) / 2:
                low = x[live, j] <= cut
                for sign, side in (("<=", low), (">", ~low)):
                    p1, n1 = int((bad[live] & side).sum()), int((~bad[live] & side).sum())
                    if p1 and (gain := p1 * (np.log2(p1 / (p1 + n1)) - now)) > best[0] + 1e-12:
                        best = (gain, (name, sign, float(cut)))
        if best[1] is None:
            break
        tests.append(best[1])
        live = _mask(x, names, tests)
    return tests


def _worth(x: np.ndarray, bad: np.ndarray, names: list[str], tests: list[tuple[str, str, float]]) -> float:
    m = _mask(x, names, tests)
    p, n = int((m & bad).sum()), int((m & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(
    x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 12, cuts: int = 32, depth: int = 4, precision: float = 0.9,
    support: int = 3,
) -> DecisionList:
    """Sequential covering. A rule is accepted if at least ``support`` rows that it covers are bad and at least ``precision`` of all."""
    out = DecisionList()
    left = np.ones(len(x), dtype=bool)
    part = np.arange(len(x)) % 3 == 0  # a third prunes
    while len(out.rules) < max_rules and bad[left].any():
        grow, prune = left & ~part, left & part
        if not bad[grow].any():
            grow = prune = left
        tests = _grow(x[grow], bad[grow], names, cuts, depth)
        best = tests
        for keep in range(len(tests) - 1, 0, -1):  # drop final tests while that is no worse on the pruning part
            if _worth(x[prune], bad[prune], names, tests[:keep]) >= _worth(x[prune], bad[prune], names, best):
                best = tests[:keep]
        m = left & _mask(x, names, best)
        covered, right = int(m.sum()), int((m & bad).sum())
        if not best or right < support or right < precision * covered:
            break
        out.rules.append(Rule(best, covered, right))
        left &= ~m
    return out


def fit(labelled: DataFrame, text: str, bad: Column, key: Column, after_base: bool = False, **options) -> DecisionList:
    """Learn from labelled documents, of which the caller gives a bounded sample; rows with a null label are left out.

    Only their statistics come to the driver. Without bad rows the list is empty. With ``after_base`` no rule is spent on rows that the base
    test rejects.
    """
    chosen = labelled.select(F.col(text).alias("text"), bad.cast("boolean").alias("bad"), F.xxhash64(key).alias("at")).where("bad IS NOT NULL")
    chosen = with_counts(chosen, "text")
    if after_base:
        chosen = chosen.where(~base_failed())
    names = list(TESTED)
    got = chosen.select("at", "bad", *[tested(n).alias(n) for n in names]).toPandas().sort_values(["at", *names])
    return learn(got[names].to_numpy(dtype=float).reshape(-1, len(names)), got["bad"].to_numpy(dtype=bool), names, **options)


def apply_rules(df: DataFrame, text: str, rules: DecisionList, prefix: str = "") -> DataFrame:
    """``df`` with the counts, ``base_failed``, ``rule`` (0: none) and ``kept``.

    A null or empty text has no words and fails the base test. Repeated rows get the same answer; an empty table stays empty. The new columns
    take ``prefix``, or what :func:`free_prefix` makes of it where names would clash.
    """
    prefix = free_prefix(df, prefix)
    out = with_counts(df, text, prefix)
    failed = base_failed(prefix)
    return out.withColumns({prefix + "base_failed": failed, prefix + "rule": rules.rule_number(prefix)}).withColumn(
        prefix + "kept", ~F.col(prefix + "base_failed") & (F.col(prefix + "rule") == 0)
    )


def passing(df: DataFrame, text: str, rules: DecisionList) -> DataFrame:
    """The rows of ``df`` that pass the base test and that no rule rejects, with the columns of ``df``, whatever their names."""
    prefix = free_prefix(df, "rule_")
    return apply_rules(df, text, rules, prefix).where(F.col(prefix + "kept")).select(*df.columns)
