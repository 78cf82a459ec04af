"""Chunk store queries: overwrite, reconciliation, copies and artifacts, written to the shared folder and read back."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking as ck, compose, markdown as md, store
from ..session import scratch_path
from ..sources.tables import load
from .markup import MD_SQL, md_documents
from .registry import query


def _stored(spark, sf):
    """Whole documents as stored chunks."""
    k = F.col("doc_id")
    return load(spark, sf, "documents").select(
        F.concat(F.lit("c"), k.cast("string")).alias("_id"), F.col("source").alias("kb_id"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("project_id"),
        tx.with_header(F.col("text"), F.col("source")).alias("text"), F.concat(F.lit("Model:"), F.col("lang")).alias("embedding_model"), F.lit("old").alias("version"), k.alias("n"),
    ).withColumn("model_partition", tx.partition_name(F.col("embedding_model")))


@query(
    "store_overwrite",
    """WITH s AS (SELECT doc_id, source AS kb_id, 'p' || (doc_id % 5) AS project_id, 'model-' || lang AS model_partition FROM documents),
n AS (SELECT DISTINCT kb_id, project_id, model_partition FROM s WHERE doc_id % 17 = 0)
SELECT model_partition, count(*) AS rows, count(*) FILTER (version = 'new') AS new_rows, CAST(sum(doc_id) AS BIGINT) AS checksum FROM (
  SELECT doc_id, model_partition, 'old' AS version FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kb_id = s.kb_id AND n.project_id = s.project_id AND EXISTS (SELECT 1 FROM n AS m WHERE m.model_partition = s.model_partition AND m.project_id = s.project_id))
  UNION ALL SELECT doc_id, model_partition, 'new' FROM s WHERE doc_id % 17 = 0) GROUP BY model_partition""",
)
def store_overwrite(spark, sf):
    path = scratch_path(spark, "store")
    stored = _stored(spark, sf)
    incoming = stored.where(F.col("n") % 17 == 0).withColumn("version", F.lit("new"))
    keys, partitions = ["kb_id", "project_id"], ["model_partition", "project_id"]
    store.upsert(stored, path, keys, partitions)
    store.upsert(incoming, path, keys, partitions)
    back = spark.read.parquet(path)
    return back.groupBy("model_partition").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("version") == "new").alias("new_rows"), F.sum("n").alias("checksum"))


@query(
    "upload_reconcile",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
b AS (SELECT doc_id, k // 5 AS batch_no, count(*) AS expected FROM l GROUP BY ALL),
s AS (SELECT doc_id, k // 5 AS batch_no, count(*) AS stored FROM l WHERE NOT (doc_id % 7 = 0 AND k % 5 = 1) AND NOT (doc_id % 11 = 0 AND k // 5 = 1) GROUP BY ALL),
j AS (SELECT b.doc_id, b.batch_no, expected, coalesce(stored, 0) AS stored, b.doc_id % 4 AS retries FROM b LEFT JOIN s ON s.doc_id = b.doc_id AND s.batch_no = b.batch_no)
SELECT doc_id, batch_no, expected, stored, CASE WHEN stored = expected THEN 'ok' WHEN stored = 0 THEN 'missing' ELSE 'partial' END AS status,
  CASE WHEN stored = expected THEN 'skip' WHEN retries >= 3 THEN 'give up' WHEN stored = 0 THEN 'send' ELSE 'delete and send' END AS action FROM j""",
)
def upload_reconcile(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "x"))
    batched = lines.withColumn("batch_no", store.fixed_batch(F.col("k"), 5))
    expected = batched.groupBy("doc_id", "batch_no").agg(F.count(F.lit(1)).alias("expected")).withColumn("retries", F.col("doc_id") % 4)
    lost = ((F.col("doc_id") % 7 == 0) & (F.col("k") % 5 == 1)) | ((F.col("doc_id") % 11 == 0) & (F.col("batch_no") == 1))
    out = store.reconcile(expected, batched.where(~lost).select("doc_id", "batch_no"), ["doc_id", "batch_no"])
    return out.select("doc_id", "batch_no", "expected", "stored", "status", "action")


@query("copy_check", "SELECT count(*) AS rows_read, count(*) AS rows_written, CAST(0 AS BIGINT) AS without_id FROM documents")
def copy_check(spark, sf):
    return store.copy_table(_stored(spark, sf), scratch_path(spark, "copy"))


PLANTED_SQL = """r AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'c' || doc_id END AS id, doc_id % 23 = 0 AS wrong FROM documents),
f AS (SELECT doc_id, id, CASE WHEN id IS NULL AND wrong THEN 'no id,type of n' WHEN id IS NULL THEN 'no id' WHEN wrong THEN 'type of n' END AS reasons FROM r),
a AS (SELECT doc_id, id, reasons FROM f UNION ALL SELECT doc_id, id, coalesce(reasons, 'repeated id') FROM f WHERE doc_id % 29 = 0)"""


def _planted(spark, sf):
    """Rows without an id, with a number that is none, and repeats."""
    k = F.col("n")
    rows = _stored(spark, sf).select(F.when(k % 19 != 0, F.col("_id")).alias("_id"), "kb_id", "text", F.when(k % 23 == 0, F.concat(F.lit("n"), k)).otherwise(k.cast("string")).alias("n"), k.alias("doc_id"))
    return rows.unionByName(rows.where(F.col("doc_id") % 29 == 0))


@query(
    "copy_failures",
    f"""WITH {PLANTED_SQL} SELECT doc_id, coalesce(id, '') AS id, reasons, count(*) AS times FROM a WHERE reasons IS NOT NULL GROUP BY ALL""",
)
def copy_failures(spark, sf):
    """Planted bad rows of a copy are reported one by one."""
    _, failures = store.copy_rows(_planted(spark, sf), scratch_path(spark, "copy"), "_id string, kb_id string, text string, n bigint")
    return failures.groupBy(
        F.get_json_object("content", "$.doc_id").cast("long").alias("doc_id"), F.coalesce("id", F.lit("")).alias("id"), F.array_join("reasons", ",").alias("reasons")
    ).agg(F.count(F.lit(1)).alias("times"))


@query("copy_report", f"WITH {PLANTED_SQL} SELECT count(*) AS rows_read, count(*) FILTER (reasons IS NULL) AS rows_written, count(reasons) AS rows_failed FROM a")
def copy_report(spark, sf):
    report, _ = store.copy_rows(_planted(spark, sf), scratch_path(spark, "copy"), "_id string, kb_id string, text string, n bigint")
    return report


@query(
    "artifacts",
    f"""WITH {MD_SQL} SELECT doc_id AS document, (SELECT max(marker) FROM f WHERE f.doc_id = tot.doc_id) + 1 AS pages, 1 + (SELECT count(level) FROM f WHERE f.doc_id = tot.doc_id) AS sections FROM tot""",
)
def artifacts(spark, sf):
    """Pages, sections and chunks written as JSON and read back."""
    facts = md.line_facts(md_documents(spark, sf))
    chunks = md.pack_sections(md.paragraphs(facts)).select("doc_id", "chunk_no", "heading_path", "body")
    out = store.write_artifacts(spark, md.page_texts(facts), md.sections(facts).drop("filtered"), chunks, scratch_path(spark, "artifacts"))
    pages = spark.read.schema("document bigint, pages array<struct<page: bigint>>").json(out["pages"])
    sections = spark.read.schema("document bigint, sections array<struct<section_id: string>>").json(out["sections"])
    return pages.join(sections, "document").select("document", F.size("pages").cast("long").alias("pages"), F.size("sections").cast("long").alias("sections"))


FILE_SQL = """f AS (SELECT doc_id, 'SOURCE FILE: in/d' || doc_id || '.txt' AS h, regexp_replace(text, '\\s', '_', 'g') AS t FROM documents),
w AS (SELECT *, chr(10) || t AS u, len(h) + 2 + len(t) AS n FROM f),
c AS (SELECT doc_id, 0 AS i, CASE WHEN n <= 2000 THEN h || chr(10) || chr(10) || t ELSE h END AS x FROM w
  UNION ALL SELECT doc_id, 1 + j, CASE WHEN j = 0 THEN substr(u, 2, 1999) ELSE substr(u, CAST(1800 * j + 1 AS INTEGER), 2000) END FROM (
    SELECT *, unnest(range(1 + greatest(0, CAST(ceil((len(u) - 2000) / 1800.0) AS BIGINT)))) AS j FROM w WHERE n > 2000))"""


def _corpus(spark, sf):
    """Documents without white space as text files, so that chunks are windows, and their entries."""
    k = F.col("doc_id")
    path = F.concat(F.lit("in/d"), k.cast("string"), F.lit(".txt")).alias("path")
    docs = load(spark, sf, "documents")
    entries = docs.select(
        "doc_id", path, F.concat(F.lit("kb"), k.cast("string")).alias("kb_id"), F.concat(F.lit("p"), (k % 5).cast("string")).alias("project_id"),
        F.when(k % 3 != 0, F.lit("cs-CZ")).alias("language"),
    )
    return docs.select("doc_id", path, F.regexp_replace("text", r"(?U)\s", "_").alias("text")), entries


@query(
    "ingest_corpus",
    f"""WITH {FILE_SQL} SELECT 'kb' || doc_id || '_1_' || i AS _id, 'p' || (doc_id % 5) AS project_id, 'kb' || doc_id AS kb_id, md5(x) AS digest, i AS chunk_idx, CAST(1 AS BIGINT) AS page,
  CASE WHEN doc_id % 3 != 0 THEN 'cs-CZ' ELSE 'en-US' END AS language, 'hashed_bag' AS model, CAST(256 AS BIGINT) AS dims FROM c""",
)
def ingest_corpus(spark, sf):
    """Files are parsed, headed, chunked, embedded, described and stored; a second run replaces a third of the entries, whose first texts were other."""
    path = scratch_path(spark, "corpus")
    files, entries = _corpus(spark, sf)
    again = F.col("doc_id") % 3 == 0
    first = files.withColumn("text", F.when(again, F.concat(F.lit("old"), F.col("text"))).otherwise(F.col("text")))
    compose.ingest(first.drop("doc_id"), entries.drop("doc_id"), path)
    compose.ingest(files.where(again).drop("doc_id"), entries.where(again).drop("doc_id"), path)
    return spark.read.parquet(path).select(
        "_id", "project_id", "kb_id", F.md5("text").alias("digest"), F.col("metadata.chunk_idx").alias("chunk_idx"), F.col("metadata.page").alias("page"),
        F.col("metadata.language").alias("language"), F.col("metadata.embedding_model").alias("model"), F.size("vector").cast("long").alias("dims"),
    )
