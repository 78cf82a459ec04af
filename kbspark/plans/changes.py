"""Tables under change: versions, log compaction, statistics by difference, vectors kept from run to run."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F, types as T

from ..functions import text as tx
from ..operators import embeddings, knn, statistics, versions
from ..session import scratch_path
from ..sources.tables import RAW_LOGS_SQL, load, raw_logs
from ..streaming import jobs
from .registry import query
from .retrieval import text_table
from .store import _stored

# --- versions ------------------------------------------------------------------------------------------------

STORE_SQL = """s AS (SELECT doc_id, source AS kb_id, 'p' || (doc_id % 5) AS project_id, 'model-' || lang AS model_partition FROM documents),
n AS (SELECT DISTINCT kb_id, project_id, model_partition FROM s WHERE doc_id % 17 = 0),
v1 AS (SELECT 1 AS version, doc_id, model_partition, 'old' AS state FROM s),
v2 AS (SELECT 2 AS version, doc_id, model_partition, 'old' AS state FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kb_id = s.kb_id AND n.project_id = s.project_id
    AND EXISTS (SELECT 1 FROM n AS m WHERE m.model_partition = s.model_partition AND m.project_id = s.project_id))
  UNION ALL SELECT 2, doc_id, model_partition, 'new' FROM s WHERE doc_id % 17 = 0),
v3 AS (SELECT 3, doc_id, model_partition, state FROM v2 WHERE doc_id % 7 != 0)"""


@query(
    "store_versions",
    f"""WITH {STORE_SQL} SELECT CAST(version AS BIGINT) AS version, model_partition, count(*) AS rows, count(*) FILTER (state = 'new') AS new_rows, CAST(sum(doc_id) AS BIGINT) AS checksum
FROM (SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3) GROUP BY ALL""",
)
def store_versions(spark, sf):
    """A store is filled, upserted and cut; every version can still be read."""
    path = scratch_path(spark, "versions")
    stored = _stored(spark, sf).withColumnRenamed("version", "state")
    incoming = stored.where(F.col("n") % 17 == 0).withColumn("state", F.lit("new"))
    keys, partitions = ["kb_id", "project_id"], ["model_partition", "project_id"]
    made = [versions.upsert(stored, path, keys, partitions), versions.upsert(incoming, path, keys, partitions)]
    made.append(versions.delete(spark, path, stored.where(F.col("n") % 7 == 0), ["_id"]))
    out = None
    for number in made:
        rows = versions.read(spark, path, number).groupBy("model_partition").agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("state") == "new").alias("new_rows"), F.sum("n").alias("checksum")
        ).withColumn("version", F.lit(number).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "log_compaction",
    f"""WITH {RAW_LOGS_SQL}, r AS (SELECT strftime(created, '%Y-%m-%d') AS event_date, event_id FROM raw WHERE coalesce(path, '') != '/health'),
last AS (SELECT max(event_date) AS d FROM r) SELECT event_date, event_date < d AS closed, CASE WHEN event_date < d THEN 1 ELSE 0 END AS files, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS checksum FROM r, last GROUP BY ALL""",
)
def log_compaction(spark, sf):
    """Five micro-batches with repeats come in by versions; all dates but the last are closed and rewritten, each record once, in a file each."""
    source, path = scratch_path(spark, "raw"), scratch_path(spark, "log-versions")
    raw = raw_logs(spark, sf)
    raw.unionByName(raw.where(F.col("event_id") % 10 == 0)).repartition(10, F.xxhash64("event_id", F.rand(3))).write.json(source)
    stream = jobs.ingest_records(jobs.read_stream(spark, source, raw.schema, "json", files_per_trigger=2))
    jobs.drain_versions(stream, path, ["event_date"], "log")
    dates = sorted(versions.manifest(spark, path).parts)
    versions.compact(spark, path, set(dates[:-1]), ["event_id"])
    now = versions.manifest(spark, path)
    files = [(d.split("=")[1], sum(len(versions.files_of(spark, path, root, d)) for root in now.parts[d]), d != dates[-1]) for d in dates]
    held = spark.createDataFrame([(d, n if closed else 0, closed) for d, n, closed in files], "event_date string, files int, closed boolean")
    rows = versions.read(spark, path).dropDuplicates(["event_date", "event_id"]).groupBy(F.col("event_date").cast("string").alias("event_date"))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("checksum")).join(held, "event_date")


# --- statistics ----------------------------------------------------------------------------------------------


@query(
    "changed_statistics",
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN text || ' added words ' || text ELSE text END AS text FROM documents WHERE doc_id % 5 != 0),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM d), o AS (SELECT doc_id, unnest(toks) AS term FROM t)
SELECT term, count(DISTINCT doc_id) AS df, CAST(NULL AS BIGINT) AS tokens FROM o GROUP BY term
UNION ALL SELECT '', count(*) FILTER (len(toks) > 0), CAST(sum(len(toks)) AS BIGINT) FROM t""",
)
def changed_statistics(spark, sf):
    """A corpus is counted once; an upsert of every ninth text and the cascade of a project change the counts by what they change."""
    path = scratch_path(spark, "statistics")
    docs = text_table(spark, sf)
    ninth = F.col("doc_id") % 9 == 0
    later = docs.where(ninth).withColumn("text", F.concat("text", F.lit(" added words "), "text"))
    statistics.change(path, added=docs)
    statistics.change(path, added=later, removed=docs.where(ninth))
    doomed = docs.where(~ninth).unionByName(later).where(F.col("project_id") == "p0")
    statistics.change(path, removed=doomed)
    statistics.fold(spark, path)
    return statistics.current(spark, path).select("term", "df", F.col("dl").alias("tokens"))


# --- vectors -------------------------------------------------------------------------------------------------

DIMS = 16


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _bag(places: pa.Array) -> pa.Array:
    """Sums per element of what tokens add; a place is twice the element, and one more where the token takes."""
    n, sizes = len(places), pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
    flat = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    cell = np.repeat(np.arange(n) * DIMS, sizes) + flat // 2
    sums = np.bincount(cell, weights=1.0 - 2.0 * (flat % 2), minlength=n * DIMS)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * DIMS), pa.array(sums))


def md5_bag(text):
    """A model that SQL can compute as well: each token adds or takes one from an element that its MD5 names.

    Each token is hashed once; the elements are summed from small numbers, not by going over the tokens for each element.
    """
    hashes = F.transform(tx.tokens(text), lambda t: F.md5(t))
    place = lambda h: 2 * (F.conv(F.substring(h, 1, 7), 16, 10).cast("long") % DIMS) + F.when(F.substring(h, 8, 1) < "8", 0).otherwise(1)
    return _bag(F.transform(hashes, lambda h: place(h).cast("int")))


knn.register_embedder("md5_bag", md5_bag)


def _embedded(spark, sf):
    path, docs = scratch_path(spark, "vectors"), load(spark, sf, "documents")
    runs = [embeddings.refresh(docs.where(F.col("doc_id") % 3 != 0), path, "md5_bag"), embeddings.refresh(docs, path, "md5_bag"), embeddings.refresh(docs, path, "md5_bag")]
    return docs, path, runs


@query(
    "embed_runs",
    """WITH a AS (SELECT count(DISTINCT text) AS n FROM documents WHERE doc_id % 3 != 0), b AS (SELECT count(DISTINCT text) AS n FROM documents)
SELECT 1::BIGINT AS run, n AS texts, n AS embedded, 0::BIGINT AS failed FROM a UNION ALL SELECT 2, b.n, b.n - a.n, 0 FROM a, b UNION ALL SELECT 3, n, 0, 0 FROM b""",
)
def embed_runs(spark, sf):
    """Part of the documents, then all of them twice: copies are embedded once, what is known is not embedded again."""
    _, _, runs = _embedded(spark, sf)
    return spark.createDataFrame([(i, r["texts"], r["embedded"], r["failed"]) for i, r in enumerate(runs, 1)], "run long, texts long, embedded long, failed long")


@query(
    "embed_cached",
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM documents),
h AS (SELECT doc_id, CAST('0x' || substr(md5(t), 1, 7) AS BIGINT) % 16 AS dim, CASE WHEN substr(md5(t), 8, 1) < '8' THEN 1.0 ELSE -1.0 END AS delta FROM t),
v AS (SELECT d.doc_id, dim, coalesce((SELECT sum(delta) FROM h WHERE h.doc_id = d.doc_id AND h.dim = x.dim), 0) AS v FROM documents d, (SELECT unnest(range(16)) AS dim) x),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM v GROUP BY doc_id)
SELECT v.doc_id, dim, round(CASE WHEN n > 0 THEN v / n ELSE 0 END, 6)::DOUBLE AS x FROM v JOIN n ON n.doc_id = v.doc_id""",
)
def embed_cached(spark, sf):
    """Every element of every document's vector, from the cache that several runs filled."""
    docs, path, _ = _embedded(spark, sf)
    out = embeddings.with_vectors(docs, path, "md5_bag").select("doc_id", F.posexplode("vector").alias("dim", "x"))
    return out.select("doc_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))
