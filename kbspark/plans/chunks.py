"""Chunking queries over whole documents."""

from pyspark.sql import Window, functions as F

from ..functions import text as tx
from ..operators import chunking as ck
from ..sources.tables import load
from .registry import query

SOLID = r"(?U)\s"


def documents(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


def _coverage(chunks, docs):
    """Per document: every chunk is the text at its offsets, sizes hold, and the chunks together hold all solid characters."""
    w = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    before = F.coalesce(F.max("char_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("from", F.greatest(before, F.col("char_start")))
    fresh = F.substring(F.col("text"), (F.col("from") - F.col("char_start") + 1).cast("int"), F.greatest(F.col("char_end") - F.col("from"), F.lit(0)).cast("int"))
    rows = rows.join(docs.withColumnRenamed("text", "full"), "doc_id")
    same = F.substring(F.col("full"), (F.col("char_start") + 1).cast("int"), (F.col("char_end") - F.col("char_start")).cast("int")) == F.col("text")
    return rows.withColumns({"same": same, "solid": F.length(F.regexp_replace(fresh, SOLID, ""))}).groupBy("doc_id").agg(
        F.min(F.col("same").cast("int")).cast("long").alias("offsets_ok"), F.max(F.length("text")).alias("longest"), F.sum("solid").alias("solid")
    )


COVER_SQL = """SELECT doc_id, CAST(1 AS BIGINT) AS offsets_ok, CAST(1 AS BIGINT) AS size_ok, CAST(len(regexp_replace(text, '\\s', '', 'g')) AS BIGINT) AS solid
FROM documents WHERE trim(text) != ''"""


def _checked(chunks, docs, size, overlapping):
    """``overlapping`` chunks are counted by their offsets, others by their own text (equal lines may be located early)."""
    out = _coverage(chunks, docs)
    if not overlapping:
        own = chunks.groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("text", SOLID, ""))).alias("solid"))
        out = out.drop("solid").join(own, "doc_id")
    return out.select("doc_id", "offsets_ok", (F.col("longest") <= size).cast("long").alias("size_ok"), F.col("solid").cast("long").alias("solid"))


@query("chunk_simple", COVER_SQL)
def chunk_simple(spark, sf):
    d = documents(spark, sf)
    return _checked(ck.split_simple(d), d, 1200, False)


@query("chunk_recursive", COVER_SQL)
def chunk_recursive(spark, sf):
    d = documents(spark, sf)
    return _checked(ck.split_recursive(d), d, 2000, True)


@query("chunk_hier", COVER_SQL)
def chunk_hier(spark, sf):
    """Children cover the text, lie inside their parents and carry their ids."""
    d = documents(spark, sf)
    rows = ck.split_hierarchical(d.withColumn("text", tx.with_header(F.col("text"), F.lit("a.txt"))))
    return _checked(rows.where(F.col("chunk_level") == "L1"), d.withColumn("text", tx.strip(F.col("text"))), 700, False)


@query(
    "chunk_hier_parents",
    """SELECT doc_id, CAST(1 AS BIGINT) AS contained, CAST(1 AS BIGINT) AS ids_ok, CAST(1 AS BIGINT) AS has_child FROM documents WHERE trim(text) != ''""",
)
def chunk_hier_parents(spark, sf):
    rows = ck.split_hierarchical(documents(spark, sf))
    parents = rows.where(F.col("chunk_level") == "L0").select("doc_id", "chunk_id", F.col("char_start").alias("a"), F.col("char_end").alias("b"))
    children = rows.where(F.col("chunk_level") == "L1").select("doc_id", F.col("parent_chunk_id").alias("chunk_id"), "char_start", "char_end", F.col("chunk_id").alias("child"))
    j = parents.join(children, ["doc_id", "chunk_id"], "left")
    inside = (F.col("char_start") >= F.col("a")) & (F.col("char_end") <= F.col("b"))
    ids = F.col("chunk_id") == tx.chunk_id(F.col("doc_id").cast("string"), "L0", F.col("a"), F.col("b"))
    return j.groupBy("doc_id").agg(
        F.min(inside.cast("long")).alias("contained"), F.min(ids.cast("long")).alias("ids_ok"), F.min(F.col("child").isNotNull().cast("long")).alias("has_child")
    )


@query(
    "chunk_windows",
    """SELECT doc_id, i AS chunk_index, i * 450 AS char_start, least(i * 450 + 500, len(t)) AS char_end, md5(substr(t, CAST(i * 450 + 1 AS INTEGER), 500)) AS digest
FROM (SELECT doc_id, regexp_replace(text, '\\s', '_', 'g') AS t FROM documents), LATERAL (SELECT unnest(range(greatest(1, CAST(ceil((len(t) - 50) / 450.0) AS BIGINT)))) AS i)""",
)
def chunk_windows(spark, sf):
    """Texts without any separator are cut into windows that overlap."""
    d = documents(spark, sf).withColumn("text", F.regexp_replace("text", SOLID, "_"))
    out = ck.split_simple(d, size=500, overlap=50, separators=["\n\n", "\n"])
    return out.select("doc_id", "chunk_index", "char_start", "char_end", F.md5("text").alias("digest"))


def _folded_sql(size, overlap, behind):
    """Words a line, packed by their cut places. ``behind``: a place is behind the line break, else before it."""
    shift = 0 if behind else 1
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ', chr(10), 'g') AS t FROM documents),
w AS (SELECT doc_id, len(t) AS n, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
e AS (SELECT doc_id, i, least(n, sum(len(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - {shift}) AS e FROM w),
p AS (SELECT doc_id, list_concat([0], list(CAST(e AS BIGINT) ORDER BY i)) AS pl FROM e GROUP BY doc_id),
r AS (SELECT doc_id, pl, 0 AS k, CAST(1 AS BIGINT) AS lo, CAST(len(list_filter(pl, lambda x: x <= {size})) AS BIGINT) AS hi FROM p
  UNION ALL SELECT doc_id, pl, k + 1, lo, CAST(len(list_filter(pl, lambda x: x <= pl[lo] + {size})) AS BIGINT) FROM (
    SELECT doc_id, pl, k, CASE WHEN {overlap} = 0 THEN hi ELSE least(hi, 1 + len(list_filter(pl, lambda x: x < greatest(pl[hi] - {overlap}, pl[hi + 1] - {size})))) END AS lo FROM r WHERE hi < len(pl))),
c AS (SELECT r.doc_id, k, t, pl[lo] + CASE WHEN lo > 1 THEN {shift} ELSE 0 END AS a, pl[hi] - CASE WHEN {shift} = 0 AND hi < len(pl) THEN 1 ELSE 0 END AS b FROM r JOIN d ON d.doc_id = r.doc_id)
SELECT doc_id, CAST(k AS BIGINT) AS chunk_index, a AS char_start, b AS char_end, md5(substr(t, CAST(a + 1 AS INTEGER), CAST(b - a AS INTEGER))) AS digest FROM c WHERE b > a"""


def _word_lines(spark, sf):
    return documents(spark, sf).withColumn("text", F.replace(tx.collapse_space(F.col("text")), F.lit(" "), F.lit("\n")))


@query("chunk_simple_words", _folded_sql(1200, 0, True))
def chunk_simple_words(spark, sf):
    """A word a line: every chunk ends behind the last word in reach. Texts and offsets are compared one by one."""
    return ck.split_simple(_word_lines(spark, sf)).select("doc_id", "chunk_index", "char_start", "char_end", F.md5("text").alias("digest"))


@query("chunk_recursive_words", _folded_sql(2000, 200, False))
def chunk_recursive_words(spark, sf):
    """The same with chunks that share whole words of up to 200 characters."""
    return ck.split_recursive(_word_lines(spark, sf)).select("doc_id", "chunk_index", "char_start", "char_end", F.md5("text").alias("digest"))


@query(
    "chunk_hier_words",
    "WITH RECURSIVE parents AS (" + _folded_sql(1200, 0, True).replace("md5(substr(t, CAST(a + 1 AS INTEGER), CAST(b - a AS INTEGER))) AS digest", "substr(t, CAST(a + 1 AS INTEGER), CAST(b - a AS INTEGER)) AS text") + "), "
    + _folded_sql(700, 0, True).removeprefix("WITH RECURSIVE ").replace("regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ', chr(10), 'g') AS t FROM documents", "text AS t FROM (SELECT doc_id || '_L0_' || char_start || '_' || char_end AS doc_id, text FROM parents)")
    .replace("SELECT doc_id, CAST(k AS BIGINT) AS chunk_index", "SELECT doc_id AS parent_chunk_id, CAST(k AS BIGINT) AS chunk_index"),
)
def chunk_hier_words(spark, sf):
    """Children packed inside every parent, with the parent's id; offsets are relative to it here."""
    rows = ck.split_hierarchical(_word_lines(spark, sf)).where(F.col("chunk_level") == "L1")
    start = F.get(F.split("parent_chunk_id", "_"), F.lit(2)).cast("long")
    return rows.select(
        "parent_chunk_id", "chunk_index", (F.col("char_start") - start).alias("char_start"), (F.col("char_end") - start).alias("char_end"), F.md5("text").alias("digest")
    )


@query(
    "token_batches",
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
t AS (SELECT doc_id, n, CASE WHEN line = '' THEN 0 ELSE greatest(1, len(trim(line)) // 4) END AS tok FROM l),
r AS (SELECT doc_id, n, tok, CAST(0 AS BIGINT) AS batch, tok AS total, CAST(1 AS BIGINT) AS items FROM t WHERE n = 1
  UNION ALL SELECT t.doc_id, t.n, t.tok, CASE WHEN r.total + t.tok > 300 OR r.items >= 6 THEN r.batch + 1 ELSE r.batch END,
    CASE WHEN r.total + t.tok > 300 OR r.items >= 6 THEN t.tok ELSE r.total + t.tok END, CASE WHEN r.total + t.tok > 300 OR r.items >= 6 THEN 1 ELSE r.items + 1 END
  FROM r JOIN t ON t.doc_id = r.doc_id AND t.n = r.n + 1)
SELECT doc_id, batch, count(*) AS items, CAST(sum(tok) AS BIGINT) AS tokens FROM r GROUP BY doc_id, batch""",
)
def token_batches(spark, sf):
    lines = documents(spark, sf).select("doc_id", F.split("text", "\n").alias("lines"))
    sized = lines.select("doc_id", F.transform("lines", lambda x: tx.token_estimate(x).cast("long")).alias("sizes"))
    numbered = sized.withColumn("batches", ck.greedy_batch_numbers(F.col("sizes"), 300, 6))
    items = numbered.select("doc_id", F.inline(F.arrays_zip("batches", "sizes")))
    return items.groupBy("doc_id", F.col("batches").alias("batch")).agg(F.count(F.lit(1)).alias("items"), F.sum("sizes").alias("tokens"))


@query(
    "stable_ids",
    """SELECT doc_id, md5(concat_ws('|', CASE WHEN doc_id % 4 = 0 THEN 'None' ELSE 'p' || (doc_id % 5) END, source, 'f' || doc_id || '.txt', '1')) AS page_id,
  substr(md5(text), 1, 12) AS doc_hash, sha1('p' || (doc_id % 5) || '_' || source) AS url_id FROM documents""",
)
def stable_ids(spark, sf):
    d = load(spark, sf, "documents")
    project = F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string"))
    return d.select(
        "doc_id",
        tx.page_hash(F.when(F.col("doc_id") % 4 != 0, project), F.col("source"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt")), F.lit(1)).alias("page_id"),
        tx.text_hash(F.col("text")).alias("doc_hash"),
        tx.url_id(project, F.col("source")).alias("url_id"),
    )


@query(
    "clean_text",
    """SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS collapsed, len(text) + 13 + len(source) + 2 AS headed, CAST(greatest(1, len(trim(text)) // 4) AS BIGINT) AS tokens FROM documents""",
)
def clean_text(spark, sf):
    d = load(spark, sf, "documents")
    headed = tx.with_header(F.col("text"), F.col("source"))
    return d.select(
        "doc_id", F.md5(tx.collapse_space(F.col("text"))).alias("collapsed"), F.length(headed).cast("long").alias("headed"),
        tx.token_estimate(F.col("text")).cast("long").alias("tokens"),
    )
