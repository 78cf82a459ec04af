"""What bounds the memory, the reads and the work of a task."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from kbspark.operators import chunking as ck


def test_python_workers_get_bounded_batches(spark):
    """Eight thousand texts of 2 kB in one task come in several batches."""
    rows = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))

    def sizes(source):
        for batch in source:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    most = rows.mapInArrow(sizes, "bytes long").agg(F.max("bytes")).first()[0]
    assert most <= 4 << 20


def test_functions_get_bounded_batches(spark):
    """The same for functions of a column, as those that cut, parse and pack texts."""
    rows = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))

    def arrow(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    def pandas(texts: pd.Series) -> pd.Series:
        return pd.Series([int(texts.str.len().sum())] * len(texts))

    for function in (F.arrow_udf(arrow, "long"), F.pandas_udf(pandas, "long")):
        assert rows.agg(F.max(function("text"))).first()[0] <= 4 << 20


def test_pieces_of_many_texts(spark):
    """More texts than are cut at a time, with nulls and texts that give no piece."""
    text = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 1, F.lit(" \n")).otherwise(F.concat(F.lit("a\nb"), F.col("doc_id").cast("string")))
    out = ck.split_simple(spark.range(0, 700, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")), size=3)
    got = {(r.doc_id, r.chunk_index): (r.text, r.char_start, r.char_end) for r in out.collect()}
    assert {k[0] for k in got} == {n for n in range(700) if n % 5 > 1}
    assert got[7, 0] == ("a", 0, 1) and got[7, 1] == ("b7", 2, 4) and got[699, 1] == ("b69", 2, 5)


def test_model_hashes_each_token_once(spark):
    """The MD5 of a token is asked for in one place of the plan, whatever the number of elements, and its sums are right."""
    from hashlib import md5

    from kbspark.plans.changes import DIMS, md5_bag

    def vector(words):
        out = [0.0] * DIMS
        for w in words:
            h = md5(w.encode()).hexdigest()
            out[int(h[:7], 16) % DIMS] += 1.0 if h[7] < "8" else -1.0
        return out

    texts = ["One two two\nthree", "", "x y z x", " \n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", md5_bag(F.col("text")).alias("v"))
    assert {r.n: list(r.v) for r in rows.collect()} == {n: vector(t.lower().split()) for n, t in enumerate(texts)}
    assert "sequence" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_upsert_deals_no_rows_by_partition(spark, monkeypatch):
    """The rows of a partition are not brought to one task to see whether the partition is touched."""
    from kbspark.operators import store
    from kbspark.session import scratch_path

    rows = spark.range(200).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("kb_id"), (F.col("id") % 2).cast("string").alias("project_id"), F.lit("old").alias("v"))
    path, plans, real = scratch_path(spark, "t-upsert"), [], store.stored

    def kept(df, to):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, to)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.upsert(rows, path, ["kb_id", "project_id"], ["project_id"])
        monkeypatch.setattr(store, "stored", kept)
        store.upsert(rows.where("kb_id IN ('k1', 'k3') OR project_id = '0'").withColumn("v", F.lit("new")), path, ["kb_id", "project_id"], ["project_id"])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[-1].count("SortMergeJoin") == 1 and plans[-1].count("BroadcastHashJoin") == 1
    assert {r.v: r["count"] for r in spark.read.parquet(path).groupBy("v").count().collect()} == {"new": 102, "old": 98}


def test_index_sorts_texts_and_tokenises_once(spark, tmp_path, monkeypatch):
    """The plan of the segments sorts texts, not tokens, and finds the tokens once; segments go on over batches; the result is that of the scan."""
    from kbspark.operators import bm25, postings

    seen, real = [], type(spark.range(1)).mapInArrow

    def kept(df, *args, **kwargs):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *args, **kwargs)

    text = F.when(F.col("id") % 9 == 0, F.lit(None)).when(F.col("id") % 9 == 1, F.lit("...")).otherwise(F.concat_ws(" ", F.lit("common words"), F.col("id").cast("string"), F.repeat(F.lit("pad "), 300)))
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("p"), text.alias("text"))
    with monkeypatch.context() as m:
        m.setattr(type(docs), "mapInArrow", kept)
        postings.write(docs, str(tmp_path / "index"), ("p",))
    plan = seen[0]
    assert plan.count("regexp_extract_all") == 1
    assert plan.index("regexp_extract_all") < plan.index("Sort [")  # the projection stands above the sort
    assert spark.read.parquet(str(tmp_path / "index" / "documents")).count() == 1  # 3,111 documents, 940,000 tokens
    asked = spark.createDataFrame([("a", "common 17", "2"), ("b", "words 40 pad", "1")], "query_id string, text string, p string")
    shown = lambda df: sorted(tuple(r) for r in df.select("query_id", "doc_id", "score", "rank").collect())
    assert shown(postings.search(asked, str(tmp_path / "index"), ("p",))) == shown(bm25.search(asked, docs, ("p",)))


def test_highlight_chooses_chunks_before_their_vectors(spark, monkeypatch):
    """Chunks of pages without a hit are left out below the join that adds the vectors."""
    from kbspark.operators import spans

    plans, real = [], spans.stored

    def kept(df, to):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, to)

    monkeypatch.setattr(spans, "stored", kept)
    page = [F.lit("p").alias("project_id"), F.lit("kb").alias("kb_id"), F.concat(F.lit("f"), F.col("d").cast("string")).alias("source_file"), F.lit(1).cast("long").alias("page")]
    base = spark.range(0, 60, 1, 2).select(F.floor(F.col("id") / 3).alias("d"), (F.col("id") % 3).alias("j"), F.col("id").alias("vec_id"))
    name = F.concat(F.lit("c"), F.col("d").cast("string"))
    own = F.col("j") == 0
    chunks = base.select(
        *page, "vec_id", F.when(own, "L0").otherwise("L1").alias("chunk_level"), F.when(own, name).otherwise(F.concat_ws("_", name, "j")).alias("chunk_id"),
        F.when(~own, name).alias("parent_chunk_id"), F.concat(F.lit("text "), "d").alias("text"), F.lit(0).cast("long").alias("char_start"), F.lit(6).cast("long").alias("char_end"),
    )
    vectors = spark.range(60).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    hits = spark.createDataFrame([("q", "p", "kb", "f4", 1)], "query_id string, project_id string, kb_id string, source_file string, page long")
    asked = spark.createDataFrame([("q", "text 4", [1.0, 0.0])], "query_id string, text string, vector array<double>")
    out = spans.highlight_spans(hits, asked, chunks.join(vectors, "vec_id").drop("vec_id")).collect()
    assert sorted((r.level, r.chunk_id) for r in out) == [("L0", "c4"), ("L1", "c4_1")]
    parents = next(p for p in plans if "LeftSemi" in p and "l0_score" in p)
    lines = parents.splitlines()
    depth = lambda word: min(len(x) - len(x.lstrip(" :+-")) for x in lines if word in x)
    assert depth("LeftSemi") > min(len(x) - len(x.lstrip(" :+-")) for x in lines if "Join Inner" in x and "vec_id" in x)


def test_blocks_stay_arrow(spark):
    """The loader of a block gets an Arrow batch, whose tokens are no Python objects; the result is that of the shipped form."""
    from kbspark.operators import bm25, topk

    rows = spark.range(50).select(F.lit("").alias("_key"), F.col("id").alias("doc_id"), F.array(F.lit("a"), F.col("id").cast("string")).alias("tokens"), F.lit(2).alias("_size"))
    asked = spark.createDataFrame([("q", "", 3, 1)], "query_id string, _key string, k int, _size int")
    kernel = lambda n, batch: batch
    load = lambda batch: batch.column("tokens").flatten().to_numpy(zero_copy_only=False)[1::2].astype(float).reshape(1, -1)
    out = topk.block_topk(rows, asked, len, load, lambda m, i: m[:, i], kernel, "bigint").collect()
    assert sorted((r.doc_id, r.value) for r in out) == [(47, 47.0), (48, 48.0), (49, 49.0)]
    docs = spark.createDataFrame([(i, f"x y{i % 3} z" if i % 4 else None, str(i % 2)) for i in range(40)], "doc_id long, text string, p string")
    q = spark.createDataFrame([("a", "y1 x", "0"), ("b", "z y2", "1"), ("c", "none", "1")], "query_id string, text string, p string")
    shown = lambda n: sorted(tuple(r) for r in bm25.search(q, docs, ("p",), max_queries=n).collect())
    assert shown(0) == shown(10) and len(shown(0)) == 10
