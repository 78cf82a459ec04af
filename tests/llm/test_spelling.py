"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from kbspark.llm import spelling
from kbspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def apart_by_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=10):
    """Near words by taking every word's deletions as keys; two words with a key in common are compared letter by letter."""
    by_key = {}
    for w in counts:
        for k in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            by_key.setdefault(k, set()).add(w)
    out = {}
    for w, n in counts.items():
        keys = {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}
        near = {v for k in keys for v in by_key[k] if apart_by_one(w, v)}
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (n, len(near), form, counts[form] if form else None)
    return out


def root(found, w):
    while found[w][2]:
        w = found[w][2]
    return w


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()


def test_query_equals_brute_force(spark):
    counts = Counter()
    for doc_id, text in documents(spark, SF):
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    want = brute(counts)
    got = {r.word: r for r in QUERIES["op11_spelling_variants"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert any(r.form for r in got.values())
    for w, (n, near, form, form_n) in want.items():
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n, got[w].root) == (n, near, form, form_n, root(want, w)), w


def dense(rng, n):
    out = {}
    while len(out) < n:
        out["".join(rng.choice("abé") for _ in range(rng.choice((1, 2, 5, 7, 7, 8))))] = rng.choice((2, 2, 3, 25, 40, 400, 5000))
    return out


@pytest.mark.parametrize("room", [2048, 16])
def test_dense_vocabulary_in_one_and_in_many_parts(spark, monkeypatch, room):
    monkeypatch.setattr(spelling, "PART_WORDS", room)
    counts = dense(random.Random(5), 900)
    rows = [*counts.items(), (None, 3), ("nullcount", None)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long").repartition(7)).collect()}
    want = brute(counts)
    assert got.keys() == want.keys()
    for w, (n, near, form, form_n) in want.items():
        assert (got[w].n, got[w].n_near, got[w].form, got[w].form_n, got[w].root) == (n, near, form, form_n, root(want, w)), w


def test_queries_in_slices(monkeypatch):
    monkeypatch.setattr(spelling, "_ASK", 3)
    group = spelling._Group((0, 0, 7, 0))
    group.words, group.counts = ["abcdefg", "abcdefh", "abcdefgh"], [9, 5, 2]
    found = {w: (int(n), b) for words, near, _, best in group.ask([*group.words, "abcdexg", "abcdefx", "abcdefgx"]) for w, n, b in zip(words, near, best, strict=True)}
    assert found["abcdefg"] == (2, "abcdefh")
    assert found["abcdexg"] == (1, "abcdefg")
    assert found["abcdefgx"] == (1, "abcdefg")  # two long words meet in the group of their own length


def test_long_words_ties_repeats_and_empty_tables(spark):
    word = "ab" * 2_000
    rows = [(word, 50), (word[:999] + "z" + word[1000:], 2), (word[:-1], 3), ("letters", 20), ("lettera", 20), ("letterz", 2), ("letterz", 0)]
    got = {r.word: r for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got[word[:-1]].form == word and got[word].n_near == 2
    assert got["letterz"].form == "lettera" and got["letterz"].n == 2
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_words_of_odd_documents(spark):
    rows = [(1, "Straße STRASSEN straßen", "x"), (None, "straßen\0straßen", "y"), (2, None, "z"), (3, "", "z"), (3, "", "z")]
    docs = spark.createDataFrame(rows, "id long, text string, word string")
    got = {r.word: r.n for r in spelling.word_counts(docs, "id", "text").collect()}
    assert got == {"straßen": 3, "strassen": 1}
    assert spelling.word_counts(docs.limit(0), "id", "text").count() == 0
