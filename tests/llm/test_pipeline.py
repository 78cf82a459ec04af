"""The stages of the pipeline, each on what the one before keeps."""

from collections import defaultdict

import corpus_pipeline
from kbspark.llm import line_templates, quality_rules
from kbspark.llm.queries import table
from tests.llm.test_duplicates import fingerprint, lines_left, smallest
from tests.llm.test_layout import packed_right

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    kept = corpus_pipeline.quality_classifier_stage(spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0.5 * len(before) < kept.count() < len(before)
    passed = corpus_pipeline.quality_rules_stage(spark, kept, SF).cache()
    assert passed.columns == docs.columns
    rows = passed.collect()
    for r in rows:
        words, *_, repeated = quality_rules.counts(r.text.encode())[:5]
        assert words >= 50 and 100 * repeated <= 50 * words and r == before[r.doc_id]
    lines = corpus_pipeline.line_dedup_stage(spark, passed, SF).cache()
    assert {r.doc_id: r.text for r in lines.collect()} == dict(zip([r.doc_id for r in rows], lines_left([r.text for r in rows], line_templates.MIN_DOCS), strict=True))
    one = corpus_pipeline.near_duplicate_stage(spark, lines, SF).cache()
    ids = sorted((r.doc_id, r.text) for r in lines.collect())
    groups = smallest([i for i, _ in ids], [fingerprint(t) for _, t in ids])
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(groups))
    pieces = corpus_pipeline.packing_stage(spark, one, SF)
    named = [r for r in pieces.collect()]
    assert packed_right(named, {r.doc_id: r.text for r in one.collect()}) > 0.95


def test_run_packs_what_is_left(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    lengths = defaultdict(int)
    for r in got:
        lengths[r.sequence_id] += r.length
    assert got and max(lengths.values()) <= 2048
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_classifier"


def test_stages_on_an_empty_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    empty = docs.where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
