"""Quality rules and the quality classifier against brute force and held-out labels."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import quality_classifier as qc
from kbspark.llm import quality_rules as qr
from kbspark.llm.queries import QUERIES, WANTED, WANTED_BITS, labelled, table

SF = "/root/testdata/sf0.1"
TEXTS = [
    None, "", " \t\n", "one", "a b c a b c a b c", "a a a a", "x\ny\nx\n\n \nx", "é|# $ <> über nbsp", "w " * 60, "A,!! B.!!\nA,!! B.!!",
    "lang " + "wort%s " * 70 % tuple(range(70)),
]
SCHEMA = "doc_id long, text string, n_words string, kept int"


def base(text):
    """The base statistics by their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts_match_their_definition(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS + TEXTS[:3])], SCHEMA)
    got = qr.with_counts(docs, "text", "c_").orderBy("doc_id").collect()
    for row, text in zip(got, TEXTS + TEXTS[:3], strict=True):
        assert tuple(row["c_" + x] for x in qr.BASE) == base(text), text


def test_rules_on_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    rules = qr.DecisionList([qr.Rule([("digit_share", ">", 0.1), ("words", "<=", 100.0)])])
    got = {r.doc_id: r for r in qr.apply_rules(docs, "text", rules, "p_").collect()}
    assert got[0].p_base_failed and not got[0].p_kept and got[0].n_words == "x"
    assert got[8].p_base_failed  # everything repeats
    assert not got[10].p_base_failed and got[10].p_rule == 1 and not got[10].p_kept
    assert qr.apply_rules(docs.limit(0), "text", rules, "p_").count() == 0
    assert qr.apply_rules(docs, "text", qr.DecisionList(), "p_").where("p_rule <> 0").count() == 0


def test_learning_finds_a_conjunction():
    random = np.random.default_rng(1)
    x = random.random((3000, 2))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.4)
    rules = qr.learn(x, bad, ["a", "b"], cuts=64)
    covered = np.zeros(len(x), bool)
    for r in rules.rules:
        covered |= qr._mask(x, ["a", "b"], r.tests)
    assert (covered == bad).mean() > 0.98
    assert qr.learn(x, np.zeros(3000, bool), ["a", "b"]).rules == []


@pytest.fixture(scope="module")
def held_out(spark):
    """Labelled documents in two halves."""
    docs = table(spark, SF, "documents")
    rows = labelled(spark, docs, SF, 10**6, WANTED).join(docs.select("doc_id", "source", "lang"), "doc_id")
    return rows.where("doc_id % 2 = 0").cache(), rows.where("doc_id % 2 = 1").cache()


def test_classifier_on_held_out_labels(spark, held_out):
    passes = [F.col("good").bitwiseAND(b) != 0 for b in WANTED_BITS]
    model = qc.fit(held_out[0], "text", passes, F.col("doc_id"))
    got = qc.classify(held_out[1], "text", F.col("source"), F.col("lang"), model).select((F.col("good") == sum(WANTED_BITS)).alias("good"), "kept").toPandas()
    assert (got.good == got.kept).mean() > 0.97
    assert got[got.good].kept.mean() > 0.97


def test_rules_on_held_out_labels(spark, held_out):
    quality = duckdb.execute(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df()
    with_label = [h.join(F.broadcast(spark.createDataFrame(quality)), "doc_id") for h in held_out]
    rules = qr.fit(with_label[0], "text", F.col("quality") == 0, F.col("doc_id"))
    got = qr.apply_rules(with_label[1], "text", rules).toPandas()
    assert ((got.quality == 0) == (got.rule > 0)).mean() > 0.97
    assert (got[got.quality == 1].rule == 0).mean() > 0.98


def test_classifier_shrinks_sparse_sites(spark):
    """One document of a small site barely moves its prior; a large bad site does. The sums are those of a brute-force version."""
    rows = [(i, "bad bad" if i % 10 else "fine", "big", "p") for i in range(400)] + [(1000, "bad", "tiny", None), (1001, None, None, "p")]
    rows += [(2000 + i, "fine", "good", "p") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    weights = np.zeros(qc.FEATURES)
    weights[qc._bucket(b"bad")] = -4.0
    got = qc.classify(docs, "text", F.col("host"), F.col("path"), qc.Evidence(weights[None], np.array([2.0]), 0.5)).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    assert got.site_prior[1] < 0.35 < got.site_prior[1000] < got.site_prior[2000]
    assert got.quality[1] < got.quality[1000] < 0.5 < got.quality[2000]
    assert qc.classify(docs.limit(0), "text", F.col("host"), F.col("path"), qc.Evidence(weights[None], np.array([2.0]), 0.5)).count() == 0


def test_classifier_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, None, None)], "doc_id long, text string, good boolean")
    assert qc.fit(docs, "text", [F.col("good")], F.col("doc_id")).intercepts[0] > 2
    assert qc.fit(docs.limit(0), "text", [F.col("good")], F.col("doc_id")).intercepts[0] == 0


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "h", "p", 7, "x")], "doc_id long, text string, _host string, quality string, kept int, evidence string")
    got = qc.classify(docs, "text", F.col("_host"), F.col("quality"), qc.Evidence(np.zeros((1, qc.FEATURES)), np.array([1.0]), 0.5))
    row = got.first()
    assert row["kept"] == 7 and row["quality"] == "p" and row["_kept"] is True


def test_rules_leave_clashing_columns_alone(spark):
    rows = [(i, t, "x", 1, 2, 3) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, Rule_n_words int, kept int, rule_kept int")
    rules = qr.DecisionList([qr.Rule([("digit_share", ">", 0.1)])])
    out = qr.apply_rules(docs, "text", rules)
    assert out.columns[: len(docs.columns)] == docs.columns and "_kept" in out.columns and out.count() == len(TEXTS)
    left = qr.passing(docs, "text", rules)
    assert left.columns == docs.columns and left.count() == 0
    assert qr.passing(docs, "text", qr.DecisionList()).first().asDict() == docs.where("doc_id = 10").first().asDict()


def test_rules_after_the_base_test(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(words[i % 9 :]) + (" 1234567890" * 40 if i % 4 == 0 else ""), i % 4 != 0) for i in range(400)]
    rows += [(1000 + i, "short text", False) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(3)
    rules = qr.fit(docs, "text", ~F.col("good"), F.col("doc_id"), after_base=True)
    assert rules.rules and all(r.covered <= 100 for r in rules.rules)
    assert qr.passing(docs, "text", rules).count() == 300


def test_labelled_sample_has_one_text_per_label(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (1, "other"), (2, None), (3, "x"), (4, "y")] + [(1, f"text {i}") for i in range(200)], "doc_id long, text string")
    got = labelled(spark, docs, str(tmp_path), 100, "quality = 1").collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def test_queries_keep_every_document(spark):
    for name in ("op1_quality_rules", "op2_quality_classifier"):
        got = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
        assert len(got) == 200 and got.doc_id.nunique() == 200
    texts = duckdb.execute("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet'").fetchall()
    got = QUERIES["op1_quality_rules"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    for doc_id, text in texts:
        assert tuple(got.loc[doc_id, list(qr.BASE)]) == base(text)
