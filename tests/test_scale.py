"""Work that must not grow faster than its input."""

import datetime as dt

import numpy as np

from kbspark.operators import knn, topk
from kbspark.streaming import answers, jobs


def test_answers_share_the_keys_of_the_state(spark, tmp_path, monkeypatch):
    """Three answers in one bucket: one ends in the first batch, one in the second, one is abandoned; a later one finds the state gone."""
    begin = dt.datetime(2024, 1, 1)
    schema = "response_id string, session_id string, chunk_index long, is_last_chunk boolean, text string, matched array<struct<kb_id: string, page: bigint>>, sent_at timestamp"
    first, last = [("kb", 2), (None, None)], begin + dt.timedelta(days=9)
    batches = [
        [("a", "s", 1, True, 'é"\n', first, begin), ("a", None, 0, None, None, None, begin), ("b", "s", 0, False, "x", None, begin), (None, "t", 0, False, "n", None, begin)],
        [("b", "s", 1, True, "y", None, begin + dt.timedelta(minutes=1)), ("a", "s", 0, False, "", None, begin), (None, "t", 1, True, "m", [], begin), ("c", "s", 1, True, "c", [], begin)],
        [("z", None, 0, True, "", [], last)],
        [("z", None, 0, True, "", [], last)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch={i}")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_trigger=1).drop("batch")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        progress = jobs.drain(answers.assemble_stream(stream, timeout_minutes=30, late_minutes=5, buckets=1), f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = [(r.response_id, r.session_id, r.text_full, [tuple(m) for m in r.matched]) for r in spark.read.parquet(f"{tmp_path}/out/data").collect()]
    want = [("a", "s", 'é"\n', first), ("b", "s", "xy", []), (None, "t", "nm", []), ("z", None, "", [])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) == 1


def test_only_values_that_may_win_are_rounded(monkeypatch):
    """Running best values against a sort of all rounded values, with ties, few rows, other k and ids of text."""
    rng, rounded = np.random.default_rng(5), []
    plain = np.round
    monkeypatch.setattr(topk.np, "round", lambda x, d: rounded.append(x.size) or plain(x, d))
    for width, text in ((1, False), (3, True), (900, False), (4000, True)):
        k, values = np.array([1, 3, 5]), rng.random((3, width))
        values[1, ::2] = -np.inf
        ids = rng.permutation(width).astype(str) if text else rng.permutation(width)
        best = topk.LocalTopK(k, 2)
        for low in range(0, width, 700):
            best.add(values[:, low:low + 700], ids[low:low + 700])
        shown = best.frame(np.array(["p", "q", "r"], dtype=object))
        for q, name in enumerate("pqr"):
            own = sorted((-plain(v, 2), i) for v, i in zip(values[q], ids.tolist()) if v > -np.inf)[: k[q]]
            mine = shown[shown["query_id"] == name]
            assert list(zip(-mine["value"], mine["doc_id"])) == own
    assert sum(rounded) < 3 * 4904 / 4


def test_vectors_are_copied_to_few_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 10)
    made, real = [], topk.with_blocks

    def blocks(*args):
        made.append(real(*args))
        return made[-1]

    monkeypatch.setattr(topk, "with_blocks", blocks)
    rows = [(i, [float(i % 7), 1.0 + i % 3]) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    asked = table.select(table.doc_id.cast("string").alias("query_id"), "vector")
    assert knn.search(asked, table, k=2, max_queries=0).count() == 80
    assert made[0][0].count() == 40 * 2
