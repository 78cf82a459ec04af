"""Embedding job, statistics under change and the order of many sections."""

import pytest
from pyspark.sql import functions as F

from kbspark.operators import bm25, embeddings, knn, markdown as md, statistics, versions


@pytest.fixture
def model(spark):
    """A model that fails on some texts: null, another size, not finite."""
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    knn.register_embedder(
        "fragile",
        lambda t: F.when(t == "null", F.lit(None)).when(t == "short", v(1)).when(t == "nan", v("nan", 1)).when(t == "zero", v(0, 0)).otherwise(F.array(F.length(t).cast("double"), F.lit(1.0))),
    )
    return "fragile"


def test_texts_are_embedded_once_and_failures_are_counted(spark, tmp_path, model):
    path = str(tmp_path / "vectors")
    texts = ["abc", "abc", "null", "short", "nan", "zero", "", None, "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert embeddings.refresh(docs.limit(0), path, model) == {"texts": 0, "embedded": 0, "failed": 0}
    assert embeddings.with_vectors(docs, path, model).where("vector IS NOT NULL").count() == 0
    assert embeddings.refresh(docs, path, model) == {"texts": 7, "embedded": 4, "failed": 3}
    before = versions.versions(spark, f"{path}/vectors")
    assert embeddings.refresh(docs.where("text NOT IN ('null', 'short', 'nan')"), path, model) == {"texts": 4, "embedded": 0, "failed": 0}
    assert versions.versions(spark, f"{path}/vectors") == before
    got = {r.doc_id: r.vector for r in embeddings.with_vectors(docs, path, model).collect()}
    assert len(got) == len(texts) and got[0] == got[1] == pytest.approx([3 / 10**0.5, 1 / 10**0.5]) and got[5] == [0.0, 0.0]
    assert sorted(k for k, v in got.items() if v is None) == [2, 3, 4, 7]


def test_models_do_not_share_vectors(spark, tmp_path, model):
    path = str(tmp_path / "vectors")
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    embeddings.refresh(docs, path, model)
    assert embeddings.refresh(docs, path, "hashed_bag")["embedded"] == 1
    assert len(embeddings.with_vectors(docs, path, "hashed_bag").first().vector) == 256
    assert len(embeddings.with_vectors(docs, path, model).first().vector) == 2


def counts(df):
    return sorted(map(tuple, df.select("term", "df", "dl").collect()))


def test_statistics_follow_changes(spark, tmp_path):
    path = str(tmp_path / "statistics")
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "..."), (5, "d")], "doc_id long, text string")
    statistics.change(path, added=docs, mark=("s", 1))
    statistics.change(path, added=docs, mark=("s", 1))
    assert counts(statistics.current(spark, path)) == counts(bm25.term_statistics(docs))
    new = spark.createDataFrame([(1, "a z")], "doc_id long, text string")
    statistics.change(path, added=new, removed=docs.where("doc_id = 1"))
    statistics.change(path, removed=docs.where("doc_id = 5"))
    want = counts(bm25.term_statistics(docs.where("doc_id NOT IN (1, 5)").unionByName(new)))
    assert counts(statistics.current(spark, path)) == want
    statistics.fold(spark, path)
    assert counts(statistics.current(spark, path)) == want and versions.expire(spark, path) >= 3
    assert counts(statistics.current(spark, path)) == want
    statistics.change(path, removed=docs.where("doc_id IN (2, 3, 4)").unionByName(new))
    assert counts(statistics.current(spark, path)) == []
    with pytest.raises(ValueError):
        statistics.change(path)


def test_children_of_more_than_ten_thousand_sections(spark):
    text = "# top\n" + "\n".join(f"## part {i}" for i in range(10_050))
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")
    children = md.with_children(md.sections(md.line_facts(docs))).where("section_id = 'sec-0001'").first().children_ids
    assert children == [f"sec-{i:04d}" for i in range(2, 10_052)]


def test_the_heading_tree_needs_no_shuffle(spark):
    docs = spark.createDataFrame([("d", "# a\n\ntext\n")], "doc_id string, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(md.sections(md.line_facts(docs)))
    assert plan(md.pack_sections(md.paragraphs(md.line_facts(docs)))).count("Exchange") == 1


def test_answers_lose_their_state_after_their_time(spark, tmp_path):
    """Six batches an hour apart: pieces out of order and twice, answers left open, and a last piece that is days younger."""
    from datetime import datetime, timedelta

    from kbspark.streaming import answers, jobs

    begin = datetime(2024, 1, 1)
    schema = "response_id string, session_id string, chunk_index long, is_last_chunk boolean, text string, matched array<struct<kb_id: string, page: bigint>>, sent_at timestamp"
    batches = []
    for hour in range(6):
        rows = []
        for k in range(8):
            whole = [(f"r{hour}-{k}", "s", i, i == 3, f"{i};", [("kb", 1)] if i == 3 else None, begin + timedelta(hours=hour, minutes=k)) for i in range(4)]
            rows += [whole[3], whole[0], whole[0]] + ([whole[1]] if k % 4 == 3 else [whole[2], whole[1]])  # every fourth lacks a piece
        batches.append(rows)
    batches[1] += [(f"r0-{k}", "s", 2, False, "2;", None, begin + timedelta(hours=1)) for k in (3,)]  # the rest comes a batch later
    batches.append([("last", "s", 0, True, "x", [], begin + timedelta(days=9))])
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch={i}")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema, files_per_trigger=1).drop("batch")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        progress = jobs.drain(answers.assemble_stream(stream, timeout_minutes=90, late_minutes=5), f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = spark.read.parquet(f"{tmp_path}/out/data").collect()
    want = {f"r{h}-{k}" for h in range(6) for k in range(8) if k % 4 != 3} | {"r0-3", "last"}
    assert sorted(r.response_id for r in got) == sorted(want)
    assert all(r.text_full == "0;1;2;3;" for r in got if r.response_id != "last")
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert len(held) >= 7 and max(held) > 8 and held[-1] <= 1


def test_pair_scores_equal_their_definition(spark):
    rows = [(["a", "b", "a"], ["a", "b", "z"], [1.0, 2.0, 3.0], 2.5), ([], ["a"], [1.0], 2.5), (["a"], None, None, None), (["q"], ["a"], [1.0], 0.0), (["a", "a"], ["a"], [0.5], None)]
    df = spark.createDataFrame(rows, "t array<string>, terms array<string>, w array<double>, avg double").coalesce(1)
    got = [r[0] for r in df.select(bm25.pair_score("t", "terms", "w", "avg")).collect()]

    def score(tokens, terms, weights, average):
        norm = 1.2 * (0.25 + 0.75 * len(tokens) / (average or 1.0))
        return sum(w * tokens.count(t) / (tokens.count(t) + norm) for t, w in zip(terms or [], weights or []) if t in tokens)

    assert got == pytest.approx([score(*r) for r in rows])


def test_copies_report_what_fails(spark, tmp_path):
    from kbspark.operators import store

    rows = [("a", "1", "x"), ("b", "no", "x"), (None, "2", "x"), (None, "no", "y"), ("c", None, None), ("d", "4", "x"), ("d", "4", "x"), ("d", "5", "x")]
    source = spark.createDataFrame(rows, "_id string, n string, extra string").repartition(3)
    report, failures = store.copy_rows(source, str(tmp_path / "copy"), "_id string, n int")
    assert tuple(report.first()) == (8, 3, 5)
    assert sorted((r.id or "", ",".join(r.reasons)) for r in failures.collect()) == [("", "no id"), ("", "no id,type of n"), ("b", "type of n"), ("d", "repeated id"), ("d", "repeated id")]
    report, failures = store.copy_rows(source.limit(0), str(tmp_path / "empty"), "_id string, n int")
    assert tuple(report.first()) == (0, 0, 0) and failures.count() == 0
    with pytest.raises(ValueError):
        store.copy_rows(source, str(tmp_path / "none"), "_id string, other int")
