"""Retrieval queries over documents, benchmark texts and embeddings."""

from pyspark.sql import functions as F

from ..constants import BM25_B, BM25_K1
from ..functions import text as tx
from ..functions.vectors import dot, knn_score, normalise
from ..operators import bm25, compose, fusion, knn, postings, vector_index
from ..session import scratch_path
from ..sources.tables import load
from .catalog import CONV_TURNS_SQL, conversation_turns
from .registry import query

# --- inputs --------------------------------------------------------------------------------------------------


def vector_table(spark, sf):
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.concat(F.lit("p"), (F.col("vec_id") % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("kb"), F.col("label").cast("string")).alias("kb_id"),
    )


def vector_queries(spark, sf):
    """Every vector reversed is a query of its own."""
    return load(spark, sf, "embeddings").select(
        F.concat(F.lit("q"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("query_id"), F.reverse("embedding").alias("vector"),
        F.concat(F.lit("p"), (F.col("vec_id") % 4).cast("string")).alias("project_id"), F.col("vec_id"),
    )


VEC_SQL = """vt AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS vector, 'p' || (vec_id % 5) AS project_id, 'kb' || label AS kb_id FROM embeddings),
vq AS (SELECT 'q' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS query_id, list_reverse(CAST(embedding AS DOUBLE[])) AS vector, 'p' || (vec_id % 4) AS project_id, vec_id FROM embeddings)"""


def text_table(spark, sf):
    return load(spark, sf, "documents").select(
        "doc_id", "text", F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string")).alias("project_id"), F.col("source").alias("kb_id")
    )


def text_queries(spark, sf):
    return load(spark, sf, "benchmark").select(
        F.concat(F.lit("q"), F.lpad(F.col("item_id").cast("string"), 9, "0")).alias("query_id"), "text",
        F.concat(F.lit("p"), (F.col("item_id") % 5).cast("string")).alias("project_id"), F.col("item_id"),
    )


def chunk_table(spark, sf):
    """Documents with a vector each: row ``doc_id modulo count`` of the embeddings."""
    docs, emb = text_table(spark, sf), load(spark, sf, "embeddings")
    n = emb.groupBy().agg(F.count(F.lit(1))).scalar()
    return docs.withColumn("vec_id", F.col("doc_id") % n).join(emb.select("vec_id", F.col("embedding").alias("vector")), "vec_id").drop("vec_id")


def question_vectors(spark, sf):
    """Text queries with a vector each."""
    emb = load(spark, sf, "embeddings")
    n = emb.groupBy().agg(F.count(F.lit(1))).scalar()
    q = text_queries(spark, sf).withColumn("vec_id", (F.col("item_id") * 7) % n)
    return q.join(emb.select("vec_id", F.reverse("embedding").alias("vector")), "vec_id").drop("vec_id")


TOKENS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
TEXT_SQL = f"""td AS (SELECT doc_id, 'p' || (doc_id % 5) AS project_id, source AS kb_id, text, {TOKENS_SQL.format('text')} AS toks FROM documents),
tq AS (SELECT 'q' || lpad(CAST(item_id AS VARCHAR), 9, '0') AS query_id, text, 'p' || (item_id % 5) AS project_id, item_id, {TOKENS_SQL.format('text')} AS toks FROM benchmark),
tot AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM td WHERE len(toks) > 0),
occ AS (SELECT doc_id, project_id, len(toks) AS dl, unnest(toks) AS term FROM td),
tf AS (SELECT doc_id, project_id, dl, term, count(*) AS tf FROM occ GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, tot),
qt AS (SELECT query_id, project_id, term, count(*) AS qtf FROM (SELECT query_id, project_id, unnest(toks) AS term FROM tq) GROUP BY ALL)"""


def bm25_sql(where: str, k: int = 5) -> str:
    return f"""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT qt.query_id, tf.doc_id, round(sum(qtf * idf * tf / (tf + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * dl / avgdl))), 6) AS score
  FROM qt JOIN tf ON tf.term = qt.term JOIN idf ON idf.term = tf.term, tot {where} GROUP BY qt.query_id, tf.doc_id)
QUALIFY rank <= {k}"""


KNN_FROM = """SELECT query_id, doc_id, cosine, (1 + cosine) / 2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(list_dot_product(vq.vector, vt.vector), 6) AS cosine FROM vq JOIN vt ON {on}) QUALIFY rank <= {k}"""


# --- vectors -------------------------------------------------------------------------------------------------


@query("knn_topk", f"WITH {VEC_SQL} {KNN_FROM.format(on='true', k=5)}")
def knn_topk(spark, sf):
    return knn.search(vector_queries(spark, sf), vector_table(spark, sf), k=5)


@query("knn_filtered", f"WITH {VEC_SQL} {KNN_FROM.format(on='vq.project_id = vt.project_id', k=5)}")
def knn_filtered(spark, sf):
    return knn.search(vector_queries(spark, sf), vector_table(spark, sf), by=("project_id",), k=5)


@query("knn_blocks", f"WITH {VEC_SQL} {KNN_FROM.format(on='vq.project_id = vt.project_id', k=10)}")
def knn_blocks(spark, sf):
    """The form for query tables beyond the broadcast bound."""
    return knn.search(vector_queries(spark, sf), vector_table(spark, sf), by=("project_id",), k=10, max_queries=0)


ALLOWED_SQL = "list_contains([CAST(vq.vec_id % 10 AS VARCHAR), CAST((vq.vec_id + 3) % 10 AS VARCHAR)], substr(vt.kb_id, 3))"


@query("knn_allowed_kb", f"WITH {VEC_SQL} {KNN_FROM.format(on=ALLOWED_SQL, k=5)}")
def knn_allowed_kb(spark, sf):
    """Any of several knowledge bases per query: one query row per allowed base."""
    q = vector_queries(spark, sf)
    bases = F.array(*[F.concat(F.lit("kb"), ((F.col("vec_id") + s) % 10).cast("string")) for s in (0, 3)])
    return knn.search(q.withColumn("kb_id", F.explode(bases)), vector_table(spark, sf), by=("kb_id",), k=5)


@query(
    "no_match",
    f"WITH {VEC_SQL} SELECT query_id FROM vq WHERE 'p' || (vec_id % 7) NOT IN (SELECT project_id FROM vt)",
)
def no_match(spark, sf):
    q = vector_queries(spark, sf).withColumn("project_id", F.concat(F.lit("p"), (F.col("vec_id") % 7).cast("string")))
    return fusion.no_match(q.select("query_id"), knn.search(q, vector_table(spark, sf), by=("project_id",)))


CELLS = 16
PROBES = 4
CELLS_SQL = f"""{VEC_SQL}, c AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS cell, vector FROM vt ORDER BY doc_id LIMIT {CELLS}),
vc AS (SELECT doc_id, vt.vector, cell FROM vt, c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(list_dot_product(vt.vector, c.vector), 6) DESC, cell) = 1),
qc AS (SELECT query_id, vq.vector, cell FROM vq, c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(vq.vector, c.vector), 6) DESC, cell) <= {PROBES}),
ap AS (SELECT query_id, doc_id, cosine, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(list_dot_product(qc.vector, vc.vector), 6) AS cosine FROM qc JOIN vc ON qc.cell = vc.cell) QUALIFY rank <= 5)"""


@query("knn_cells", f"WITH {CELLS_SQL} SELECT query_id, doc_id, cosine, (1 + cosine) / 2 AS score, rank FROM ap")
def knn_cells(spark, sf):
    rows = vector_table(spark, sf)
    return knn.search_cells(vector_queries(spark, sf), rows, knn.centroids(rows, CELLS), PROBES, k=5)


@query(
    "knn_cells_recall",
    f"""WITH {CELLS_SQL}, ex AS ({KNN_FROM.format(on='true', k=5)})
SELECT count(*) AS exact, count(ap.doc_id) AS found, round(count(ap.doc_id) / count(*), 6) AS recall FROM ex LEFT JOIN ap ON ap.query_id = ex.query_id AND ap.doc_id = ex.doc_id""",
)
def knn_cells_recall(spark, sf):
    exact = knn_topk(spark, sf).select("query_id", "doc_id")
    found = knn_cells(spark, sf).select("query_id", "doc_id", F.lit(True).alias("hit"))
    return exact.join(found, ["query_id", "doc_id"], "left").groupBy().agg(
        F.count(F.lit(1)).alias("exact"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall")
    )


@query("knn_candidates", f"WITH {VEC_SQL} {KNN_FROM.format(on='true', k=5)}")
def knn_candidates(spark, sf):
    """Cells are read until as many candidates are met as there are rows, so the result is that of the exact search."""
    rows = vector_table(spark, sf)
    return knn.search_cells(vector_queries(spark, sf), rows, knn.centroids(rows, CELLS), 1, k=5, num_candidates=rows.count())


# Every eleventh vector gets a NaN, every thirteenth loses its end, every seventeenth is missing.
BROKEN_SQL = """bt AS (SELECT vec_id AS doc_id, CASE WHEN vec_id % 17 = 0 THEN NULL WHEN vec_id % 13 = 0 THEN CAST(embedding AS DOUBLE[])[1:63]
  WHEN vec_id % 11 = 0 THEN list_concat(CAST(embedding AS DOUBLE[])[1:63], ['NaN'::DOUBLE]) ELSE CAST(embedding AS DOUBLE[]) END AS vector FROM embeddings)"""


def broken_vectors(spark, sf):
    k, v = F.col("doc_id"), F.transform("vector", lambda x: x.cast("double"))
    short = F.slice(v, 1, 63)
    vector = F.when(k % 17 == 0, F.lit(None)).when(k % 13 == 0, short).when(k % 11 == 0, F.concat(short, F.array(F.lit(float("nan"))))).otherwise(v)
    return vector_table(spark, sf).withColumn("vector", vector)


@query(
    "knn_rejects",
    """SELECT vec_id AS doc_id, CASE WHEN vec_id % 17 = 0 THEN 'missing' WHEN vec_id % 13 = 0 THEN 'size' ELSE 'not finite' END AS reason
FROM embeddings WHERE vec_id % 17 = 0 OR vec_id % 13 = 0 OR vec_id % 11 = 0""",
)
def knn_rejects(spark, sf):
    return knn.rejects(broken_vectors(spark, sf), 64)


def _broken(spark, sf, **form):
    asked = vector_queries(spark, sf)
    return knn.search(asked.unionByName(asked), broken_vectors(spark, sf), k=5, **form)


BROKEN_KNN = f"WITH {VEC_SQL}, {BROKEN_SQL} " + KNN_FROM.format(on="bt.vector IS NOT NULL AND len(bt.vector) = 64 AND NOT isnan(bt.vector[64])", k=5).replace("vt.", "bt.").replace("JOIN vt", "JOIN bt")


@query("knn_broken", BROKEN_KNN)
def knn_broken(spark, sf):
    """Rejected vectors and repeated queries change no other hit, in the form with shipped queries."""
    return _broken(spark, sf)


@query("knn_broken_blocks", BROKEN_KNN)
def knn_broken_blocks(spark, sf):
    return _broken(spark, sf, max_queries=0)


@query(
    "l2_normalise",
    """WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id + 2)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v)
SELECT vec_id, round(n, 3) AS length, round(v[1] / n, 6) AS first, round(v[64] / n, 6) AS last FROM n""",
)
def l2_normalise(spark, sf):
    from ..functions.vectors import norm

    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 2))
    v = load(spark, sf, "embeddings").select("vec_id", scaled.alias("v")).withColumns({"length": F.round(norm("v"), 3), "u": normalise("v")})
    return v.select("vec_id", "length", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query(
    "mean_pool",
    """WITH t AS (SELECT label, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE 1 END AS mask, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)
SELECT CAST(label AS BIGINT) AS label, dim - 1 AS dim, round(sum(x * mask) / greatest(sum(mask), 1e-9), 6) AS x FROM t GROUP BY label, dim""",
)
def mean_pool(spark, sf):
    tokens = load(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("label"), F.when(F.col("vec_id") % 4 == 0, 0).otherwise(1).alias("mask"), F.col("embedding").alias("vector")
    )
    pooled = knn.mean_pool(tokens, "label").select("label", F.posexplode("vector").alias("dim", "x"))
    return pooled.select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query("embed_text", "SELECT doc_id, CAST(256 AS BIGINT) AS dims, CASE WHEN regexp_matches(text, '[\\p{L}\\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS length FROM documents")
def embed_text(spark, sf):
    """Every text gets a vector of the model's size: of length one, or zero where the text has no tokens."""
    from ..functions.vectors import norm

    out = knn.embed(load(spark, sf, "documents"), "hashed_bag")
    return out.select("doc_id", F.size("vector").cast("long").alias("dims"), F.round(norm("vector"), 6).alias("length"))


# --- text ----------------------------------------------------------------------------------------------------


@query("corpus_stats", f"WITH {TEXT_SQL} SELECT term, df, CAST(NULL AS BIGINT) AS tokens FROM df UNION ALL SELECT '', n, CAST((SELECT count(*) FROM occ) AS BIGINT) FROM tot")
def corpus_stats(spark, sf):
    return bm25.term_statistics(text_table(spark, sf)).select("term", "df", F.col("dl").alias("tokens"))


@query("bm25_topk", f"WITH {TEXT_SQL} {bm25_sql('')}")
def bm25_topk(spark, sf):
    return bm25.search(text_queries(spark, sf), text_table(spark, sf))


@query("bm25_filtered", f"WITH {TEXT_SQL} {bm25_sql('WHERE qt.project_id = tf.project_id')}")
def bm25_filtered(spark, sf):
    return bm25.search(text_queries(spark, sf), text_table(spark, sf), by=("project_id",))


@query("bm25_blocks", f"WITH {TEXT_SQL} {bm25_sql('WHERE qt.project_id = tf.project_id', 10)}")
def bm25_blocks(spark, sf):
    """The form for query tables beyond the broadcast bound."""
    return bm25.search(text_queries(spark, sf), text_table(spark, sf), by=("project_id",), k=10, max_queries=0)


PHRASE_SQL = f"""WITH {TEXT_SQL}, p AS (SELECT query_id, ' ' || array_to_string(toks, '  ') || ' ' AS p, (SELECT sum(ln(1.0 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)))
    FROM (SELECT unnest(tq.toks) AS term) u LEFT JOIN df ON df.term = u.term, tot) AS w FROM tq),
s AS (SELECT doc_id, len(toks) AS dl, ' ' || array_to_string(toks, '  ') || ' ' AS s FROM td),
m AS (SELECT query_id, doc_id, dl, w, CAST((len(s) - len(replace(s, p, ''))) / len(p) AS BIGINT) AS freq FROM p JOIN s ON contains(s, p))
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(w * freq / (freq + {BM25_K1} * (1 - {BM25_B} + {BM25_B} * dl / avgdl)), 6) AS score FROM m, tot) QUALIFY rank <= 5"""


@query("phrase_hits", PHRASE_SQL)
def phrase_hits(spark, sf):
    return bm25.search(text_queries(spark, sf), text_table(spark, sf), phrase=True)


# --- stored indexes ------------------------------------------------------------------------------------------

_indexes: dict[tuple[str, str, str], str] = {}


def stored_index(spark, sf, name, write):
    """The folder of an index over the given tables; it is written when a session first asks for it, and searched by all later queries."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _indexes:
        path = scratch_path(spark, name)
        write(path)
        _indexes[key] = path
    return _indexes[key]


def text_index(spark, sf):
    return stored_index(spark, sf, "text-index", lambda path: postings.write(text_table(spark, sf), path, ("project_id",)))


@query("bm25_index_topk", f"WITH {TEXT_SQL} {bm25_sql('')}")
def bm25_index_topk(spark, sf):
    return postings.search(text_queries(spark, sf), text_index(spark, sf))


@query("bm25_index_filtered", f"WITH {TEXT_SQL} {bm25_sql('WHERE qt.project_id = tf.project_id')}")
def bm25_index_filtered(spark, sf):
    return postings.search(text_queries(spark, sf), text_index(spark, sf), by=("project_id",))


@query("phrase_index_hits", PHRASE_SQL)
def phrase_index_hits(spark, sf):
    return postings.search(text_queries(spark, sf), text_index(spark, sf), phrase=True)


@query("index_statistics", f"WITH {TEXT_SQL} SELECT term, df, CAST(NULL AS BIGINT) AS tokens FROM df UNION ALL SELECT '', n, CAST((SELECT count(*) FROM occ) AS BIGINT) FROM tot")
def index_statistics(spark, sf):
    """Document frequencies from the index, without reading a text."""
    return postings.statistics(spark, text_index(spark, sf)).select("term", "df", F.col("dl").alias("tokens"))


INDEX_CELLS = 32


def cell_index(spark, sf):
    return stored_index(spark, sf, "vector-index", lambda path: vector_index.write(vector_table(spark, sf), path, cells=INDEX_CELLS))


def twentieth(spark, sf):
    """Every twentieth row is a query."""
    return vector_table(spark, sf).where(F.col("doc_id") % 20 == 0).select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query_id"), "vector")


TWENTIETH_SQL = VEC_SQL.replace("list_reverse(CAST(embedding AS DOUBLE[]))", "CAST(embedding AS DOUBLE[])").replace(
    "'q' || lpad(CAST(vec_id AS VARCHAR), 9, '0')", "'q' || vec_id"
) + ", tw AS (SELECT query_id, vector FROM vq WHERE vec_id % 20 = 0)"


@query("knn_index_exact", f"WITH {TWENTIETH_SQL} {KNN_FROM.format(on='true', k=5).replace('vq', 'tw')}")
def knn_index_exact(spark, sf):
    """All cells are probed and all their rows scored: the index loses no row."""
    return vector_index.search(twentieth(spark, sf), cell_index(spark, sf), INDEX_CELLS, k=5, refine=1 << 30)


@query(
    "knn_index_recall",
    f"WITH {TWENTIETH_SQL}, ex AS ({KNN_FROM.format(on='true', k=5).replace('vq', 'tw')}) SELECT count(*) AS exact, true AS recalled FROM ex",
)
def knn_index_recall(spark, sf):
    """Some cells are probed and the best codes refined; at least nine tenths of the exact neighbours are found."""
    asked = twentieth(spark, sf)
    exact = knn.search(asked, vector_table(spark, sf), k=5).select("query_id", "doc_id")
    found = vector_index.search(asked, cell_index(spark, sf), 3 * INDEX_CELLS // 4, k=5, refine=100)
    met = exact.join(found.select("query_id", "doc_id", F.lit(True).alias("hit")), ["query_id", "doc_id"], "left")
    return met.groupBy().agg(F.count(F.lit(1)).alias("exact"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recalled"))


# --- fusion --------------------------------------------------------------------------------------------------

HYBRID_SQL = f"""{TEXT_SQL}, ec AS (SELECT count(*) AS c FROM embeddings),
ch AS (SELECT doc_id, project_id, text, CAST(embedding AS DOUBLE[]) AS vector FROM td, ec JOIN embeddings ON vec_id = doc_id % c),
qv AS (SELECT query_id, project_id, list_reverse(CAST(embedding AS DOUBLE[])) AS vector FROM tq, ec JOIN embeddings ON vec_id = (item_id * 7) % c),
tl AS ({bm25_sql('WHERE qt.project_id = tf.project_id')}),
vl AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM (
  SELECT query_id, doc_id, round(list_dot_product(qv.vector, ch.vector), 6) AS cosine FROM qv JOIN ch ON qv.project_id = ch.project_id) QUALIFY rank <= 5),
f AS (SELECT coalesce(vl.query_id, tl.query_id) AS query_id, coalesce(vl.doc_id, tl.doc_id) AS doc_id,
  round(coalesce(1.0 / (vl.rank + 60), 0) + coalesce(1.0 / (tl.rank + 60), 0), 9) AS score, vl.rank AS cosine_rank, tl.rank AS bm25_rank
  FROM vl FULL JOIN tl ON vl.query_id = tl.query_id AND vl.doc_id = tl.doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cosine_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank FROM f)"""


@query("hybrid_retrieve", f"WITH {HYBRID_SQL} SELECT query_id, doc_id, round(score, 6) AS score, cosine_rank, bm25_rank, rank FROM fr")
def hybrid_retrieve(spark, sf):
    out = fusion.retrieve(text_queries(spark, sf), question_vectors(spark, sf), chunk_table(spark, sf), by=("project_id",))
    return out.withColumn("score", F.round("score", 6))


@query(
    "union_hits",
    f"""WITH {HYBRID_SQL} SELECT coalesce(tl.query_id, vl.query_id) AS query_id, coalesce(tl.doc_id, vl.doc_id) AS doc_id,
  CASE WHEN tl.query_id IS NOT NULL THEN 'bm25' ELSE 'knn' END AS origin FROM tl FULL JOIN vl ON tl.query_id = vl.query_id AND tl.doc_id = vl.doc_id""",
)
def union_hits(spark, sf):
    chunks = chunk_table(spark, sf)
    text = bm25.search(text_queries(spark, sf), chunks, by=("project_id",)).select("query_id", "doc_id", F.lit("bm25").alias("origin"))
    vector = knn.search(question_vectors(spark, sf), chunks, by=("project_id",)).select("query_id", "doc_id", F.lit("knn").alias("origin"))
    return fusion.union_hits(text, vector)


@query(
    "rerank_plugin",
    f"""WITH {HYBRID_SQL}, s AS (SELECT fr.query_id, fr.doc_id, fr.rank,
  round(len(list_intersect(list_distinct(tq.toks), td.toks)) / greatest(len(list_distinct(tq.toks)), 1), 6) AS rerank_score FROM fr JOIN tq ON tq.query_id = fr.query_id JOIN td ON td.doc_id = fr.doc_id)
SELECT query_id, doc_id, rerank_score, rank, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS new_rank FROM s QUALIFY new_rank <= 5""",
)
def rerank_plugin(spark, sf):
    out = fusion.retrieve(text_queries(spark, sf), question_vectors(spark, sf), chunk_table(spark, sf), by=("project_id",), reranker="token_overlap")
    return out.select("query_id", "doc_id", "rerank_score", "rank", "new_rank")


@query(
    "rerank_by_answer",
    f"""WITH {VEC_SQL}, h AS ({KNN_FROM.format(on='true', k=5)}), ec AS (SELECT count(*) AS c FROM embeddings),
a AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS av FROM vq, ec JOIN embeddings e ON e.vec_id = (vq.vec_id + 7) % c WHERE vq.vec_id % 3 != 0),
s AS (SELECT h.query_id, h.doc_id, h.rank, round(list_dot_product(vt.vector, av), 6) AS answer_score FROM h JOIN vt ON vt.doc_id = h.doc_id LEFT JOIN a ON a.query_id = h.query_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY answer_score DESC NULLS LAST, rank, doc_id) AS new_rank FROM s""",
)
def rerank_by_answer(spark, sf):
    emb = load(spark, sf, "embeddings")
    n = emb.groupBy().agg(F.count(F.lit(1))).scalar()
    asked = vector_queries(spark, sf).where(F.col("vec_id") % 3 != 0).select("query_id", ((F.col("vec_id") + 7) % n).alias("vec_id"))
    answers = asked.join(emb, "vec_id").select("query_id", F.col("embedding").alias("vector"))
    hits = knn_topk(spark, sf).join(vector_table(spark, sf).select("doc_id", "vector"), "doc_id")
    return fusion.rerank_by_answer(hits, answers).select("query_id", "doc_id", "rank", "answer_score", "new_rank")


@query(
    "top_n_mode",
    f"""WITH {TEXT_SQL}, r AS ({bm25_sql('', 10**9)}) SELECT r.query_id, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS matched
FROM r JOIN tq ON tq.query_id = r.query_id WHERE rank <= 1 + item_id % 7 GROUP BY r.query_id""",
)
def top_n_mode(spark, sf):
    """Every query asks for its own number of chunks."""
    q = text_queries(spark, sf).withColumn("k", (1 + F.col("item_id") % 7).cast("int"))
    hits = bm25.search(q, text_table(spark, sf))
    ordered = F.sort_array(F.collect_list(F.struct("rank", "doc_id")))
    joined = F.array_join(F.transform(ordered, lambda s: s["doc_id"].cast("string")), ",")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), joined.alias("matched"))


# --- whole jobs ----------------------------------------------------------------------------------------------

CONTEXT_SQL = f"""{TEXT_SQL}, r AS ({bm25_sql('WHERE qt.project_id = tf.project_id')}), {CONV_TURNS_SQL},
hn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, _id DESC) AS k FROM ct),
hm AS (SELECT session_id, count(*) FILTER (trim(user_query) != '') + count(*) FILTER (trim(system_response) != '') AS n FROM hn WHERE k <= 5 GROUP BY session_id),
cx AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM r JOIN td ON td.doc_id = r.doc_id GROUP BY query_id),
qs AS (SELECT query_id, 's' || item_id AS session_id, item_id, text FROM tq)"""


def _questions(spark, sf):
    k = F.col("item_id")
    return text_queries(spark, sf).withColumns({"session_id": F.concat(F.lit("s"), k.cast("string")), "language": F.when(k % 2 == 0, "cs").otherwise("en")})


@query(
    "answer_context",
    f"""WITH {CONTEXT_SQL} SELECT qs.query_id, md5(CASE WHEN coalesce(n, 0) > 0 AND item_id % 2 = 0 THEN text || ' ?!' ELSE text END) AS query,
  md5('Answer in ' || CASE WHEN item_id % 2 = 0 THEN 'Czech' ELSE 'English' END || ' and only from this context.' || chr(10) || chr(10) || '<CONTEXT>' || chr(10) || coalesce(context, '') || chr(10) || '</CONTEXT>') AS prompt,
  2 + coalesce(n, 0) AS messages FROM qs LEFT JOIN hm ON hm.session_id = qs.session_id LEFT JOIN cx ON cx.query_id = qs.query_id""",
)
def answer_context(spark, sf):
    """History, rewriting (which fails for every odd question), search by project, prompt and messages of every question."""
    docs = text_table(spark, sf)
    rewrite = lambda text, history: F.when(F.col("item_id") % 2 == 0, F.concat(text, F.lit(" ?!")))
    search = lambda asked: bm25.search(asked, docs, by=("project_id",))
    out, _ = compose.answer_context(_questions(spark, sf), conversation_turns(spark, sf), search, docs.select("doc_id", "text"), rewrite=rewrite)
    return out.select("query_id", F.md5("query").alias("query"), F.md5("prompt").alias("prompt"), F.size("messages").cast("long").alias("messages"))


@query(
    "rewrite_prompts",
    """SELECT item_id, 'Write the last question in ' || CASE item_id % 4 WHEN 0 THEN 'Czech' WHEN 1 THEN 'English' ELSE 'English' END
  || ' so that it can be understood without the conversation. Give the question only.' AS prompt FROM benchmark""",
)
def rewrite_prompts(spark, sf):
    """The rewriting prompt by language; no language and an unknown one get the default."""
    k = F.col("item_id")
    code = F.when(k % 4 == 0, "cs").when(k % 4 == 1, "en").when(k % 4 == 2, "xx")
    return load(spark, sf, "benchmark").select("item_id", tx.rewrite_prompt(code).alias("prompt"))


@query(
    "top_n_turns",
    f"""WITH {TEXT_SQL}, r AS ({bm25_sql('', 10**9)}), m AS (SELECT r.query_id, r.doc_id, rank, kb_id FROM r JOIN tq ON tq.query_id = r.query_id JOIN td ON td.doc_id = r.doc_id WHERE rank <= 1 + item_id % 7),
f AS (SELECT query_id, kb_id, min(rank) AS rank FROM m GROUP BY ALL), k AS (SELECT query_id, string_agg(kb_id, ',' ORDER BY rank) AS kb_ids FROM f GROUP BY query_id),
g AS (SELECT query_id, string_agg(CAST(1 + doc_id % 9 AS VARCHAR), ',' ORDER BY rank) AS pages FROM m GROUP BY query_id)
SELECT sha1('s' || item_id || '|' || tq.query_id) AS _id, md5(text) AS user_query, coalesce(kb_ids, '') AS kb_ids, coalesce(pages, '') AS pages FROM tq LEFT JOIN k ON k.query_id = tq.query_id LEFT JOIN g ON g.query_id = tq.query_id""",
)
def top_n_turns(spark, sf):
    """Every question asks for its own number of chunks and leaves a turn."""
    questions = _questions(spark, sf).withColumn("k", (1 + F.col("item_id") % 7).cast("int"))
    docs = text_table(spark, sf)
    hits = bm25.search(questions, docs).join(docs.select("doc_id", "kb_id", (1 + F.col("doc_id") % 9).alias("page")), "doc_id")
    out = compose.turn_records(questions, hits)
    pages = F.array_join(F.transform("matched_pages", lambda p: p.cast("string")), ",")
    return out.select("_id", F.md5("user_query").alias("user_query"), F.array_join("matched_kb_ids", ",").alias("kb_ids"), pages.alias("pages"))
