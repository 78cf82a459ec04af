"""Search against brute force on small fixtures, with a key that holds most rows and with many equal copies."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kbspark.operators import bm25, fusion, knn, topk


def _vectors(n, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    v[n // 2:] = v[0]  # half of the rows are copies
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _keys(n):
    return ["hot" if i % 3 else f"k{i % 2}" for i in range(n)]


def _brute_knn(q, c, qk, ck, k):
    out = set()
    for i, v in enumerate(q):
        scored = sorted((-round(float(v @ w), 6), j) for j, w in enumerate(c) if ck[j] == qk[i])
        out |= {(f"q{i:03d}", j, r + 1) for r, (_, j) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("max_queries", [1000, 0])
def test_knn_equals_brute_force(spark, monkeypatch, max_queries):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 13)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    c, q = _vectors(120), _vectors(15, seed=5)
    ck, qk = _keys(120), _keys(15)
    chunks = spark.createDataFrame([(i, [float(x) for x in v], ck[i]) for i, v in enumerate(c)], "doc_id long, vector array<double>, key string").repartition(5)
    queries = spark.createDataFrame([(f"q{i:03d}", [float(x) for x in v], qk[i]) for i, v in enumerate(q)], "query_id string, vector array<double>, key string")
    hits = knn.search(queries, chunks, by=("key",), k=4, max_queries=max_queries).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in hits} == _brute_knn(q, c, qk, ck, 4)


def test_knn_k_per_query_and_no_match(spark):
    chunks = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], "x")], "doc_id string, vector array<double>, key string")
    queries = spark.createDataFrame([("1", [1.0, 0.0], "x", 1), ("2", [1.0, 0.0], "x", 2), ("3", [1.0, 0.0], "y", 2)], "query_id string, vector array<double>, key string, k int")
    hits = knn.search(queries, chunks, by=("key",))
    assert sorted((r.query_id, r.doc_id) for r in hits.collect()) == [("1", "a"), ("2", "a"), ("2", "b")]
    assert [r.query_id for r in fusion.no_match(queries, hits).collect()] == ["3"]


def test_cells_probe_everything_is_exact(spark):
    c = _vectors(60)
    chunks = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "doc_id long, vector array<double>")
    queries = spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(_vectors(5, seed=9))], "query_id string, vector array<double>")
    centres = knn.centroids(chunks, 6, iterations=2)
    approx = knn.search_cells(queries, chunks, centres, 6, k=5)
    exact = knn.search(queries, chunks, k=5)
    assert {tuple(r) for r in approx.collect()} == {tuple(r) for r in exact.collect()}


WORDS = "der die das kauf haus élan 東京 a_b x1 rot".split()


def _texts(n, seed):
    rng = random.Random(seed)
    return ["" if i % 11 == 0 else " , ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 30))) for i in range(n)]


def _tokens(text):
    return re.findall(r"\w+", text.lower())


def _brute_bm25(queries, docs, qk, dk, k, phrase):
    toks = [_tokens(d) for d in docs]
    full = [t for t in toks if t]
    n, avg = len(full), sum(map(len, full)) / len(full)
    df = Counter(t for ts in full for t in set(ts))
    idf = lambda t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
    out = set()
    for i, q in enumerate(queries):
        qt, scored = _tokens(q), []
        for j, ts in enumerate(toks):
            if dk[j] != qk[i]:
                continue
            norm = 1.2 * (0.25 + 0.75 * len(ts) / avg)
            if phrase:
                f = sum(ts[p:p + len(qt)] == qt for p in range(len(ts) - len(qt) + 1)) if qt else 0
                s = sum(map(idf, qt)) * f / (f + norm)
            else:
                c = Counter(ts)
                s = sum(idf(t) * c[t] / (c[t] + norm) for t in qt if c[t])
            if s > 0:
                scored.append((-round(s, 6), j))
        out |= {(f"q{i:03d}", j, r + 1) for r, (_, j) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("phrase", [False, True])
@pytest.mark.parametrize("max_queries", [1000, 0])
def test_bm25_equals_brute_force(spark, monkeypatch, phrase, max_queries):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 11)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "MAX_CELLS", 40)
    docs, queries = _texts(80, 1), [" ".join(_tokens(t)[:2]) for t in _texts(12, 2)]
    docs += [docs[1]] * 40
    dk, qk = _keys(len(docs)), _keys(12)
    d = spark.createDataFrame(list(zip(range(len(docs)), docs, dk)), "doc_id long, text string, key string").repartition(5)
    q = spark.createDataFrame([(f"q{i:03d}", t, qk[i]) for i, t in enumerate(queries)], "query_id string, text string, key string")
    hits = bm25.search(q, d, by=("key",), k=6, phrase=phrase, max_queries=max_queries).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in hits} == _brute_bm25(queries, docs, qk, dk, 6, phrase)


def test_rrf_ties_keep_list_order(spark):
    schema = "query_id string, doc_id string, rank long"
    cosine = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], schema)
    text = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("r", "c", 1)], schema)
    rows = fusion.reciprocal_rank_fusion({"cosine": cosine, "bm25": text}).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in rows] == [("q", "a", 1), ("q", "b", 2), ("r", "c", 1)]
    assert rows[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-8)
    # a document in only one list at the same rank: the first list wins
    one = spark.createDataFrame([("q", "z", 1)], schema)
    two = spark.createDataFrame([("q", "a", 1)], schema)
    assert [r.doc_id for r in fusion.reciprocal_rank_fusion({"cosine": one, "bm25": two}).orderBy("rank").collect()] == ["z", "a"]
