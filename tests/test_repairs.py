"""Cases that the given tables do not hold: unusable vectors, loose pages, agent groups, overlapping phrases, partial upserts, late rows."""

import os

import pytest
from pyspark.sql import functions as F

from kbspark.functions import html
from kbspark.operators import bm25, crawl, knn, store
from kbspark.session import scratch_path
from kbspark.sources import files
from kbspark.streaming import jobs


@pytest.mark.parametrize("max_queries", [1000, 0])
def test_unusable_vectors_lose_no_hit(spark, max_queries):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, None), (6, []), (7, [inf, 0.0]), (8, [None, 1.0])]
    chunks = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [nan, 0.0]), ("c", [1.0])], "query_id string, vector array<double>")
    hits = knn.search(queries, chunks, k=2, max_queries=max_queries).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r["rank"]) for r in hits] == [("a", 1, 1), ("a", 3, 2)]
    reasons = {r.doc_id: r.reason for r in knn.rejects(chunks, 2).collect()}
    assert reasons == {2: "not finite", 4: "size", 5: "missing", 6: "not finite", 7: "not finite", 8: "not finite"}


def test_null_keys_match(spark):
    chunks = spark.createDataFrame([(1, [1.0], None), (2, [1.0], "x"), (3, [1.0], "y")], "doc_id long, vector array<double>, p string")
    queries = spark.createDataFrame([("a", [1.0], None), ("b", [1.0], "x")], "query_id string, vector array<double>, p string")
    assert {(r.query_id, r.doc_id) for r in knn.search(queries, chunks, by=("p",)).collect()} == {("a", 1), ("b", 2)}


def test_phrases_may_overlap(spark):
    docs = spark.createDataFrame([(1, "a a a"), (2, "a b a a"), (3, "b")], "doc_id long, text string")
    pairs = docs.select("doc_id", bm25.phrase_frequency(bm25.tokens(F.col("text")), F.array(F.lit("a"), F.lit("a"))).alias("n"))
    assert {r.doc_id: r.n for r in pairs.collect()} == {1: 2.0, 2: 1.0, 3: 0.0}
    queries = spark.createDataFrame([("q", "a a")], "query_id string, text string")
    assert [r.doc_id for r in bm25.search(queries, docs, phrase=True).orderBy("rank").collect()] == [1, 2]


def test_robots_groups_and_queries(spark):
    rules = spark.createDataFrame(
        [("h.org", "*", False, "/"), ("h.org", "kb", False, "/x?a=1"), ("g.org", "*", False, "/p"), ("g.org", "*", True, "/p?ok")],
        "host string, agent string, allow boolean, path_prefix string",
    )
    urls = ["http://h.org/y", "http://h.org/x?a=1&b=2", "http://h.org/x?b=2", "http://g.org/p?no", "http://g.org/p?ok=1", "http://n.org/"]
    rows = crawl.robots_allowed(spark.createDataFrame([(u,) for u in urls], "url string"), rules, "kb").collect()
    assert {r.url: r.allowed for r in rows} == dict(zip(urls, [True, False, True, False, True, True]))


def test_excluded_parameters_are_decoded(spark):
    rows = spark.createDataFrame([("http://a.org/?utm%5Fsource=1",), ("http://a.org/?UTM_source",), ("http://a.org/?x=utm_source&%zz=1",)], "url string")
    out = rows.select(crawl.excluded_parameter(F.col("url"), ["utm_source"]).alias("x")).collect()
    assert [r.x for r in out] == [True, True, False]


def test_loose_pages(spark):
    cases = {
        "<head><title>a</title><body>b": ("b", "a", []),
        "<title>t</title><h1>x</h1>": ("x", "t", []),
        "<h1> </h1><h1>two<b>!</b></h1>": ("two\n!", "two!", []),
        "<p><noscript>n</p>after<A HREF = x>l</A>": ("after\nl", "", ["x"]),
        "<!-- <a href=c>c</a> --><a name=n>n</a><a href='a&amp;b'>q": ("n\nq", "", ["a&b"]),
        "": ("", "", []),
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "html string").select("html", html.parsed("html").alias("p")).collect()
    got = {r.html: (r.p["text"], r.p["title"], r.p["links"]) for r in rows if r.html is not None}
    assert got == cases and [r.p["text"] for r in rows if r.html is None] == [None]


def test_upsert_leaves_other_partitions_alone(spark):
    path = scratch_path(spark, "store")
    rows = lambda *x: spark.createDataFrame(x, "kb_id string, v int, part string")
    store.upsert(rows(("a", 1, "x"), ("b", 1, "x"), ("c", 1, "y")), path, ["kb_id"], ["part"])
    before = {r.path: r.length for r in files.list_stored(spark, path).collect() if "part=y" in r.path}
    store.upsert(rows(("a", 2, "x"), ("a", 3, "x"), ("d", 2, "z")), path, ["kb_id"], ["part"])
    assert {tuple(r) for r in spark.read.parquet(path).select("kb_id", "v", "part").collect()} == {("a", 2, "x"), ("a", 3, "x"), ("b", 1, "x"), ("c", 1, "y"), ("d", 2, "z")}
    assert before and before == {r.path: r.length for r in files.list_stored(spark, path).collect() if "part=y" in r.path}


def test_late_rows_count(spark):
    path, out = scratch_path(spark, "late"), scratch_path(spark, "late-out")
    os.makedirs(path)
    for n, hour in enumerate(["2024-01-05 10", "2024-01-01 10", "2024-01-05 10"]):
        frame = spark.createDataFrame([("p", "s", "u", hour)], "project_id string, session_id string, user_id string, h string")
        frame.select("*", F.to_timestamp("h", "yyyy-MM-dd HH").alias("ts"), F.lit("query").alias("message"), F.lit(None).cast("int").alias("feedback")).coalesce(1).write.mode("append").parquet(path)
    stream = jobs.read_stream(spark, path, spark.read.parquet(path).schema, files_per_trigger=1)
    jobs.drain_batches(stream, out, lambda batch: jobs.partial_metrics(batch, "1 day", ("project_id",)))
    got = {str(r.window_start)[:10]: (r.queries, r.users) for r in jobs.merged_metrics(spark, out, ("project_id",)).collect()}
    assert got == {"2024-01-05": (2, 1), "2024-01-01": (1, 1)}
