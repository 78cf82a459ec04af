"""Events, filters, merges, crawl and streams on literal rows."""

from collections import deque
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kbspark.functions.urls import _normalised
from kbspark.operators import catalog as cat, crawl, events as ev, filters as flt, store
from kbspark.session import scratch_path
from kbspark.streaming import answers as an, jobs


def test_percentages(spark):
    rows = spark.createDataFrame([(0, 0), (1, 2), (2, 1)], "positive long, negative long")
    out = rows.select(ev.feedback_percentage("positive").alias("p"), ev.feedback_percentage("negative").alias("n")).collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0), (33.33, 66.67), (66.67, 33.33)]


def test_segments():
    now = datetime(2024, 3, 15, 10)
    assert len(ev.segment_bounds("day", now)) == 13 and len(ev.segment_bounds("week", now)) == 8 and len(ev.segment_bounds("month", now)) == 5
    year = ev.segment_bounds("all", now)
    assert year[0] == datetime(2023, 3, 1, 10) and year[-2:] == [datetime(2024, 3, 1, 10), now]
    assert ev.segment_bounds("all", datetime(2024, 3, 1))[-1] == datetime(2024, 3, 1)
    with pytest.raises(ValueError):
        ev.segment_bounds("decade", now)


def test_last_microsecond_is_outside(spark):
    start, end = ev.day_bounds("2024-01-01", "2024-01-01")
    rows = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 23:59:59.999998",), ("2024-01-01 23:59:59.999999",)], "s string")
    assert ev.in_range(rows.withColumn("ts", F.col("s").cast("timestamp")), start, end).count() == 2


def test_clauses(spark):
    df = spark.createDataFrame([(1, "a", '{"t": {"n": 5}}'), (2, "b", '{"t": {"n": 7}}'), (3, None, "{}")], "id long, k string, j string")
    df = df.select("id", F.struct("k", F.parse_json("j").alias("custom")).alias("metadata"))
    ids = lambda *c: [r.id for r in flt.custom_filter(df, list(c)).orderBy("id").collect()]
    assert ids({"term": {"metadata.custom.t.n": 7}}) == [2]
    assert ids({"bool": {"must_not": {"term": {"metadata.k.keyword": "a"}}}}) == [2, 3]
    assert ids({"exists": {"field": "metadata.k"}}, {"range": {"metadata.custom.t.n": {"lt": 6}}}) == [1]
    with pytest.raises(ValueError):
        flt.custom_filter(df, [{"fuzzy": {}}])


def test_merge_and_insert(spark):
    target = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "_id string, name string, note string")
    updates = spark.createDataFrame([("1", None, "n", ["name"], 2), ("1", "old", None, ["name"], 1), ("9", "z", None, ["name"], 1)], "_id string, name string, note string, _set array<string>, _version int")
    merged, lost = cat.merge_update(target, updates, ["name", "note"])
    assert sorted(tuple(r) for r in merged.select("_id", "name", "note").collect()) == [("1", None, "x"), ("2", "b", "y")]
    assert [r._id for r in lost.collect()] == ["9"]
    fresh, conflicts = cat.insert_absent(target, target.limit(1).unionByName(spark.createDataFrame([("3", "n1", ""), ("3", "n2", "")], target.schema)), F.col("name"))
    assert [(r._id, r.name) for r in fresh.collect()] == [("3", "n1")] and conflicts.count() == 2


def test_reconcile_gives_up(spark):
    expected = spark.createDataFrame([("a", 2, 0), ("b", 2, 3), ("c", 1, 0)], "batch_id string, expected long, retries int")
    stored = spark.createDataFrame([("a",), ("a",), ("b",)], "batch_id string")
    assert {r.batch_id: r.action for r in store.reconcile(expected, stored, ["batch_id"]).collect()} == {"a": "skip", "b": "give up", "c": "send"}


def _sequential(seed, pages, redirects, max_pages):
    """Plain queue, one URL after the other."""
    queue, seen, out, n = deque([_normalised(seed, "")]), set(), [], 0

    def fresh(url):
        if url in seen:
            return False
        seen.add(url)
        return "/no" not in url and url.startswith("http://s.org")

    while queue and n < max_pages:
        url = queue.popleft()
        if not fresh(url):
            continue
        final = redirects.get(url, url)
        if final != url and not fresh(final):
            continue
        if final not in pages:
            continue
        if not final.endswith(".pdf"):
            n += 1
            queue.extend(u for u in (_normalised(final, h) for h in pages[final]) if u)
        out.append(final)
    return out


@pytest.mark.parametrize("max_pages", [1, 4, 7, 100])
def test_crawl_equals_queue(spark, max_pages):
    s = "http://s.org/"
    pages = {
        s + "a": ["b", "c?r=1", "#x", "f.pdf", "mailto:q"], s + "b": ["a", "d", "no/z", "c"], s + "c": ["e", "b/", "d"], s + "d": ["a", "g.pdf", "h"],
        s + "e": ["d?r=2", "i"], s + "f.pdf": [], s + "g.pdf": [], s + "h": ["http://other.org/", "e"], s + "i": ["a"],
    }
    redirects = {s + "c?r=1": s + "c", s + "d?r=2": s + "d"}
    html = lambda links: "<html><title>t</title>" + "".join(f'<a href="{h}">l</a>' for h in links)
    p = spark.createDataFrame([(u, html(ls), "text/html") for u, ls in pages.items()], "url string, html string, content_type string")
    r = spark.createDataFrame(list(redirects.items()), "url string, final_url string")
    seeds = spark.createDataFrame([("c", s + "a/")], "crawl_id string, url string")
    opts = crawl.CrawlOptions(max_pages=max_pages, exclude_substrings=["/NO"])
    rows = crawl.crawl_plan(spark, seeds, p, r, opts).orderBy("depth", "visit_key").collect()
    assert [x.final_url for x in rows] == _sequential(s + "a/", pages, redirects, max_pages)


def test_admission(spark):
    opts = crawl.CrawlOptions(exclude_query_params=["/Sid "], exclude_suffixes=["/print/"], exclude_mimetypes=["application/pdf"])
    cases = {
        "http://a.org/x": True, "http://A.org/v1.2/x": True, "http://a.org/x.PDF": False, "http://a.org/x.html": True, "http://a.org/y?SID=": False,
        "http://a.org/y?s=sid": True, "http://a.org/p/print/": False, "http://a.org:8080/x": False,
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string")
    got = rows.select("u", crawl.admitted(F.col("u"), F.lit("http://a.org/"), opts).alias("ok")).collect()
    assert {r.u: r.ok for r in got} == cases


PIECES = [
    ("r1", "s", 1, False, "b", None), ("r1", "s", 0, False, "a", None), ("r1", "s", 1, False, "b", None), ("r1", "s", 2, True, None, [("k", 3)]),
    ("r2", None, 0, True, "x", []), ("r3", "s", 0, False, "never", None), ("r4", "s", 1, True, "late", [("k", 1)]),
]


def test_answers_batch_equals_stream(spark):
    schema = "response_id string, session_id string, chunk_index long, is_last_chunk boolean, text string, matched array<struct<kb_id: string, page: bigint>>"
    table = spark.createDataFrame(PIECES, schema)
    source, out = scratch_path(spark, "t-pieces"), scratch_path(spark, "t-answers")
    table.repartition(3, "chunk_index").write.parquet(source)
    jobs.drain(an.assemble_stream(jobs.read_stream(spark, source, table.schema, files_per_trigger=1)), out)
    want = [("r1", "s", "ab"), ("r2", None, "x")]
    for df in (an.assemble(table), spark.read.parquet(f"{out}/data")):
        assert sorted(((r.response_id, r.session_id, r.text_full) for r in df.collect()), key=str) == want
    turns = an.turns(an.assemble(table), spark.createDataFrame([("r1", "why"), ("r2", "how")], "response_id string, user_query string")).collect()
    assert [(t.response_id, t.matched_kb_ids, t.matched_pages) for t in turns] == [("r1", ["k"], [3])]
