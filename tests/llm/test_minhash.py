"""SuperMinHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from kbspark.llm import minhash
from kbspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def brute(docs):
    """(key, set size, smallest key, kept) by comparing all pairs of different sets that share a shingle."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and min(len(a), len(sets[j])) * 100 >= 80 * max(len(a), len(sets[j])):
                common = len(a & sets[j])
                if 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                    parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        r = find(i)
        least[r] = min(least.get(r, (True, 0)), (k is None, k if k is not None else 0))
    out = []
    for i, (k, _) in enumerate(docs):
        none, c = least[find(i)]
        c = None if none else c
        out.append((k, len(sets[i]), c, k == c))
    return sorted(out, key=repr)


def got(df, key="doc_id"):
    return sorted((tuple(r) for r in df.select(key, "n_shingles", "component_id", "kept").collect()), key=repr)


def test_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_minhash"](spark, SF)) == brute(docs)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice(([], [f"new{rng.randrange(10**6)}"], [words[at], f"more{rng.randrange(10**6)}"]))
    return words


def near_copies(rng, n, length):
    """Copies of one text with few or many changes: many pairs lie close to the limit on both sides."""
    base = [f"w{rng.randrange(4000)}" for _ in range(length)]
    return [" ".join(edited(rng, base, rng.choice((0, 1, 1, 2, 3, 4, 6)))) for _ in range(n)]


@pytest.mark.parametrize(("part", "block", "shingles", "copies"), [(128, 256, 1 << 21, 256), (16, 7, 1 << 21, 3), (128, 256, 900, 256)])
def test_large_groups_of_near_copies(spark, monkeypatch, part, block, shingles, copies):
    monkeypatch.setattr(minhash, "PART", part)
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PART_SHINGLES", shingles)
    monkeypatch.setattr(minhash, "_LINKS_PER_COPY", copies)
    rng = random.Random(part)
    texts = [*near_copies(rng, 260, 100), *near_copies(rng, 80, 60), *near_copies(rng, 60, 25)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} {' '.join(f'o{rng.randrange(10**6)}' for _ in range(rng.choice((10, 14, 18, 60))))}" for _ in range(120)]
    chain = [f"c{i}" for i in range(140)]
    texts += [" ".join(chain[i : i + 90]) for i in range(0, 50, 5)]  # each links with the next only
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    assert got(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), "doc_id", "text")) == brute(docs)


def test_odd_documents_repeats_and_clashing_names(spark):
    rows = [(5, None), (4, ""), (3, " \n\t"), (9, "One two"), (8, "one  TWO"), (7, "one two three"), (None, "a b c d e"), (2, "a b\x0bc d e"), (2, "a b c d e"),
            (None, "É x y z"), (1, "é x y z"), (6, "\x85 b c d"), (6, "\x85 b c d"), (None, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "n long, signature string, row int, node int, high int")
    assert got(minhash.near_duplicates(docs, "n", "signature"), "n") == brute(rows)
    assert minhash.near_duplicates(docs.limit(0), "n", "signature").count() == 0


def test_long_texts_are_split_and_signed_in_slices(monkeypatch):
    rng = random.Random(8)
    text = (" ".join(f"w{rng.randrange(3000)}" for _ in range(5000)) + " " + "x" * 5000 + " end").encode()
    whole = minhash.shingles(text, minhash._Words())
    code = minhash.signatures([whole[:0], whole, whole[:50]])
    monkeypatch.setattr(minhash, "_TEXT", 100)
    monkeypatch.setattr(minhash, "_SLICE", 64)
    assert np.array_equal(minhash.shingles(text, minhash._Words()), whole)
    assert np.array_equal(minhash.signatures([whole[:0], whole, whole[:50]]), code)


def test_agreement_estimates_similarity_with_less_variance():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = minhash.signatures([x[:50], x[10:]])  # 40 of 60
        errors.append((a == b).mean() - 40 / 60)
    independent = (2 / 3 * 1 / 3 / minhash.PLACES) ** 0.5
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.9 * independent
