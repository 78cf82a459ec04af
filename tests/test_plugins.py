"""Plug-ins of a caller's own: embedding model, re-ranker, parser and splitter."""

from pyspark.sql import functions as F

from kbspark.operators import chunking, compose, fusion, knn
from kbspark.session import scratch_path
from kbspark.sources import files


def test_embedder_and_reranker(spark, monkeypatch):
    monkeypatch.setattr(knn, "EMBEDDERS", dict(knn.EMBEDDERS))
    monkeypatch.setattr(fusion, "RERANKERS", dict(fusion.RERANKERS))
    knn.register_embedder("length", lambda text: F.array(F.length(text).cast("double"), F.lit(4.0).cast("double")))
    docs = spark.createDataFrame([(1, "abc"), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r.vector for r in knn.embed(docs, "length").collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 1.0]}
    assert {len(r.vector) for r in knn.embed(docs, "length", unit=False, max_dims=1).collect()} == {1}
    fusion.register_reranker("shortest", lambda query, text: -F.length(text))
    hits = spark.createDataFrame([("q", 1, "x", "long text", 1), ("q", 2, "x", "text", 2), ("q", 3, "x", "more", 3)], "query_id string, doc_id long, query string, text string, rank long")
    assert [r.doc_id for r in fusion.rerank(hits, 2, "shortest").orderBy("new_rank").collect()] == [2, 3]


def test_parser_splitter_and_store(spark, monkeypatch):
    monkeypatch.setattr(files, "PARSERS", dict(files.PARSERS))
    monkeypatch.setattr(chunking, "SPLITTERS", dict(chunking.SPLITTERS))

    def by_page(found):
        pages = found.select("path", F.posexplode(F.split("text", "\f")).alias("page", "text"), F.size(F.split("text", "\f")).cast("long").alias("total_pages"))
        return pages.select("path", (F.col("page") + 1).cast("long").alias("page"), "total_pages", F.lit("sheet").alias("title"), "text")

    files.register_parser("xlsx", by_page)
    found = spark.createDataFrame([("a/b.xlsx", "one\ftwo"), ("a/c.docx", "x"), ("a/d.zip", "x"), ("a/e.txt", " ")], "path string, text string")
    entries = found.select("path", F.col("path").alias("kb_id"), F.lit("p").alias("project_id"))
    path = scratch_path(spark, "plug-store")
    rejected = {r.path: r.reason for r in compose.ingest(found, entries, path).collect()}
    assert rejected == {"a/c.docx": "no parser", "a/d.zip": "unsupported type", "a/e.txt": "no document"}
    rows = sorted((r.metadata.page, r.metadata.total_pages, r.metadata.title, r.text) for r in spark.read.parquet(path).collect())
    assert rows == [(1, 2, "sheet", "SOURCE FILE: a/b.xlsx\n\none"), (2, 2, "sheet", "SOURCE FILE: a/b.xlsx\n\ntwo")]

    chunking.register_splitter("halves", lambda text, size, overlap, separators: [(0, text[: len(text) // 2], 0, len(text) // 2)])
    made = found.select(chunking.pieces(F.col("text"), "halves", 1, 0, []).alias("p")).collect()
    assert made[0].p[0].text == "one" and made[0].p[0].char_end == 3
