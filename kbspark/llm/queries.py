"""Registered queries of the operators, each over its whole table with production parameters.

SQL cannot say what is learned, matched or packed here; the tests hold these queries against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, html_blocks, licenses, line_templates, minhash, nearest, packing, pieces, quality_classifier, quality_rules, sharding, simhash, spelling
from .common import hash_sample, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def labelled(spark: SparkSession, docs: DataFrame, sf_dir: str, rows: int, good: str) -> DataFrame:
    """``text``, ``doc_id`` and ``good`` of a bounded sample of labelled documents; the sample is chosen among the labels and broadcast.

    A label has one text, the one with the smallest hash, however many rows of ``docs`` have its id: the sample stays bounded.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr(good).alias("good")).where("good IS NOT NULL AND doc_id IS NOT NULL")
    sample = hash_sample(labels, F.col("doc_id"), rows).groupBy("doc_id").agg(F.min("good").alias("good"))
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("good").alias("good"))


# A document is wanted if its label says good quality and nothing toxic; the bits of ``good`` say which of the two holds.
WANTED = "CASE WHEN quality IS NOT NULL THEN int(quality = 1) + 2 * int(coalesce(toxic, 0) = 0) END"
WANTED_BITS = (1, 2)


def wanted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with the verdict of the classifier. The host is the source; below it, the language is the path."""
    sample = labelled(spark, docs, sf_dir, quality_classifier.FIT_ROWS, WANTED)
    model = quality_classifier.fit(sample, "text", [F.col("good").bitwiseAND(b) != 0 for b in WANTED_BITS], F.col("doc_id"))
    return quality_classifier.classify(docs, "text", F.col("source"), F.col("lang"), model)


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document, with the evidence and the site prior behind it."""
    out = wanted_documents(spark, table(spark, sf_dir, "documents"), sf_dir)
    return out.select("doc_id", "source", "lang", "evidence", "site_prior", "quality", "kept")


def learned_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_rules.DecisionList:
    """Rules that find documents labelled as of bad quality and pass the base tests."""
    sample = labelled(spark, docs, sf_dir, quality_rules.FIT_ROWS, "quality = 1")
    return quality_rules.fit(sample, "text", ~F.col("good"), F.col("doc_id"), after_base=True)


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    out = quality_rules.apply_rules(docs.select("doc_id", "text"), "text", learned_rules(spark, docs, sf_dir))
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "rule", "kept")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document, as its length and checksum."""
    out = line_templates.dedup_lines(table(spark, sf_dir, "documents"))
    left = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length(left).cast("long").alias("n_chars"), F.crc32(F.encode(left, "UTF-8")).alias("text_crc32"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; the shards' bytes are near equal, so nothing is said of one more shard."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.with_text(table(spark, sf_dir, "pages"), "html").select("page_id", "url", "text", "n_chars")


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return nearest.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0)


@query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice that a document holds."""
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text")


ORACLES["op4_license_scan"] = licenses.oracle()


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's ids, and whether they decode to its text."""
    out = pieces.with_pieces(table(spark, sf_dir, "documents"), "text", with_ids=False)
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), pieces.SPACE, " ")
    return out.select("doc_id", "n_ids", "ids_crc32", (F.col("decoded_crc32") == F.crc32(F.encode(text, "UTF-8"))).alias("round_trip"))


# The contract of op11 plants a misspelling where 31 divides the checksum.
PLANTED_EVERY = 31


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the documents."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"), "doc_id", "text", drop_every=PLANTED_EVERY)
    return spelling.variants(words.where(F.col("n") >= spelling.LEAST)).select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over links of sets that are alike to at least 80 per cent."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document between two tokenizers."""
    out = alignment.align(table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
