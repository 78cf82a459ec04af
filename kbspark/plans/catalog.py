"""Catalog queries."""

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import catalog as cat, filters as flt
from ..sources.tables import (
    KB_SQL, PROJECTS_SQL, SESSIONS_SQL, TURNS_SQL, knowledge_base, load, projects, sessions, turns,
)
from .registry import query

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
STAMP_SQL = "'%Y-%m-%d %H:%M:%S.%f'"


@query(
    "kb_list_page",
    f"""WITH {KB_SQL}, f AS (SELECT * FROM kb WHERE source_type = 'pdf' AND language IN ('cs', 'en-US'))
SELECT _id, name, price, (SELECT count(*) FROM f) AS total FROM f ORDER BY price DESC NULLS LAST, _id LIMIT 20 OFFSET 40""",
)
def kb_list_page(spark, sf):
    rows = flt.equality_filter(knowledge_base(spark, sf), {"source_type": "pdf", "language": ["cs", "en-US"], "project_id": None})
    rows = flt.select_fields(rows, "name,price")
    return cat.list_page(rows, "-price", page_no=3, per_page=20).select("_id", "name", "price", "total")


@query(
    "kb_list_nulls_first",
    f"WITH {KB_SQL} SELECT _id, language, (SELECT count(*) FROM kb) AS total FROM kb ORDER BY language NULLS FIRST, _id LIMIT 50",
)
def kb_list_nulls_first(spark, sf):
    return cat.list_page(flt.select_fields(knowledge_base(spark, sf), "language"), "language", 1, 50).select("_id", "language", "total")


@query(
    "project_search",
    """SELECT 'u' || c_custkey AS _id, c_name AS name FROM customer WHERE contains(lower(c_name), lower('Er#00000001'))""",
)
def project_search(spark, sf):
    rows = load(spark, sf, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("_id"), F.col("c_name").alias("name"))
    return rows.where(flt.contains_ignore_case("name", "Er#00000001"))


def _hits(spark, sf):
    t = turns(spark, sf)
    # every 50th line refers to an entry that does not exist
    kb = F.when(F.col("l_orderkey") % 50 == 0, F.concat(F.lit("x"), F.col("kb_id"))).otherwise(F.col("kb_id"))
    return t.select(F.col("session_id").alias("query_id"), "rank", kb.alias("kb_id"), "page", F.lit("stale").alias("name"))


HITS_SQL = f"""{TURNS_SQL}, hits AS (
  SELECT session_id AS query_id, rank, CASE WHEN l_orderkey % 50 = 0 THEN 'x' || kb_id ELSE kb_id END AS kb_id, page FROM turns)"""


@query(
    "enrich_hits",
    f"""WITH {HITS_SQL}, {KB_SQL}
SELECT query_id, rank, hits.kb_id, page, name, description, source_file, source_type FROM hits LEFT JOIN kb ON kb._id = hits.kb_id""",
)
def enrich_hits(spark, sf):
    return cat.enrich_hits(_hits(spark, sf), knowledge_base(spark, sf))


@query(
    "missing_hits",
    f"WITH {HITS_SQL}, {KB_SQL} SELECT DISTINCT kb_id FROM hits WHERE kb_id NOT IN (SELECT _id FROM kb)",
)
def missing_hits(spark, sf):
    return cat.missing_keys(_hits(spark, sf), knowledge_base(spark, sf))


@query(
    "turn_matches",
    f"""WITH {TURNS_SQL}
SELECT session_id, string_agg(kb_id || ':' || page, ',' ORDER BY rank, kb_id, page) AS matches FROM turns GROUP BY session_id""",
)
def turn_matches(spark, sf):
    """Parallel arrays of a session's matches zipped into pairs."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "kb_id", "page")))
    arrays = turns(spark, sf).groupBy("session_id").agg(ordered.alias("o"))
    arrays = arrays.select("session_id", F.col("o.kb_id").alias("matched_kb_ids"), F.col("o.page").alias("matched_pages"))
    pairs = cat.zip_pairs(arrays, "matched_kb_ids", "matched_pages", "pairs")
    joined = F.array_join(F.transform("pairs", lambda p: F.concat_ws(":", p["matched_kb_ids"], p["matched_pages"].cast("string"))), ",")
    return pairs.select("session_id", joined.alias("matches"))


RESOURCES_SQL = """resources AS (
  SELECT 'data/projects/p' || (doc_id % 30) || '/' || CASE WHEN doc_id % 2 = 0 THEN 'knowledge_base' ELSE 'documents' END
    || '/kb' || doc_id || '/source.' || CASE doc_id % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' ELSE 'md' END AS path FROM documents)"""


def resource_paths(spark, sf):
    k = F.col("doc_id")
    return load(spark, sf, "documents").select(
        F.concat(
            F.lit("data/projects/p"), (k % 30).cast("string"), F.lit("/"),
            F.when(k % 2 == 0, "knowledge_base").otherwise("documents"), F.lit("/kb"), k.cast("string"), F.lit("/source."),
            F.when(k % 3 == 0, "pdf").when(k % 3 == 1, "html").otherwise("md"),
        ).alias("path")
    )


@query(
    "orphans",
    f"""WITH {PROJECTS_SQL}, {KB_SQL}, {SESSIONS_SQL}, {TURNS_SQL}, {RESOURCES_SQL},
known AS (SELECT _id AS project_id FROM projects),
tp AS (SELECT turns._id, project_id FROM turns JOIN sessions ON sessions._id = turns.session_id),
rp AS (SELECT split_part(path, '/', 3) AS project_id, path AS _id FROM resources WHERE split_part(path, '/', 2) = 'projects'),
idx AS (SELECT DISTINCT 'p' || (doc_id % 31) AS project_id, 'kb' || (doc_id * 3) AS kb_id FROM documents)
SELECT 'kb_without_project' AS kind, project_id, _id AS object_id FROM kb WHERE project_id NOT IN (SELECT project_id FROM known)
UNION ALL SELECT 'session_without_project', project_id, _id FROM sessions WHERE project_id NOT IN (SELECT project_id FROM known)
UNION ALL SELECT 'turn_without_project', project_id, _id FROM tp WHERE project_id NOT IN (SELECT project_id FROM known)
UNION ALL SELECT 'resource_without_project', project_id, _id FROM rp WHERE project_id NOT IN (SELECT project_id FROM known)
UNION ALL SELECT DISTINCT 'index_project_unknown', project_id, '' FROM idx WHERE project_id NOT IN (SELECT project_id FROM known)
UNION ALL SELECT 'index_kb_unknown', project_id, kb_id FROM idx WHERE kb_id NOT IN (SELECT _id FROM kb)
UNION ALL SELECT 'project_without_kb', project_id, '' FROM known WHERE project_id NOT IN (SELECT project_id FROM kb)""",
)
def orphans(spark, sf):
    s = sessions(spark, sf)
    t = turns(spark, sf).join(s.select(F.col("_id").alias("session_id"), "project_id"), "session_id").select("_id", "project_id")
    res = resource_paths(spark, sf).select(cat.project_of_path(F.col("path")).alias("project_id"), F.col("path").alias("_id"))
    k = F.col("doc_id")
    index = load(spark, sf, "documents").select(
        F.concat(F.lit("p"), (k % 31).cast("string")).alias("project_id"), F.concat(F.lit("kb"), (k * 3).cast("string")).alias("kb_id")
    )
    return cat.orphan_report(projects(spark, sf), knowledge_base(spark, sf), s, t, res.where(F.col("project_id").isNotNull()), index)


@query(
    "insert_absent",
    f"""WITH {SESSIONS_SQL}, inc AS (
  SELECT 's' || (l_orderkey + CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 10000000 END) AS _id, l_linenumber AS n, l_partkey FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY n, l_partkey) AS rn FROM inc)
SELECT CASE WHEN rn = 1 AND _id NOT IN (SELECT _id FROM sessions) THEN 'inserted' ELSE 'conflict' END AS outcome,
  count(*) AS rows, CAST(sum(l_partkey) AS BIGINT) AS checksum FROM r GROUP BY outcome""",
)
def insert_absent(spark, sf):
    base = F.col("l_orderkey") + F.when(F.col("l_partkey") % 2 == 0, 0).otherwise(10_000_000)
    incoming = load(spark, sf, "lineitem").select(F.concat(F.lit("s"), base.cast("string")).alias("_id"), F.col("l_linenumber").alias("n"), "l_partkey")
    fresh, conflicts = cat.insert_absent(sessions(spark, sf), incoming, F.struct("n", "l_partkey"))
    both = fresh.select(F.lit("inserted").alias("outcome"), "l_partkey").unionByName(conflicts.select(F.lit("conflict").alias("outcome"), "l_partkey"))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"), F.sum("l_partkey").alias("checksum"))


@query(
    "merge_update",
    f"""WITH {KB_SQL}, u AS (
  SELECT 'kb' || (l_partkey + CASE WHEN l_linenumber = 7 THEN 1000000 ELSE 0 END) AS _id,
         l_linenumber % 2 = 0 AS set_name, 'renamed ' || l_orderkey AS name, CAST(NULL AS VARCHAR) AS description,
         l_linenumber % 3 = 0 AS set_description, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS v FROM lineitem),
last AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY _id ORDER BY v DESC) = 1)
SELECT kb._id, CASE WHEN set_name THEN last.name ELSE kb.name END AS name,
  CASE WHEN set_description THEN last.description ELSE kb.description END AS description,
  CASE WHEN last._id IS NULL THEN 'kept' ELSE 'updated' END AS outcome
FROM kb LEFT JOIN last ON last._id = kb._id
UNION ALL SELECT _id, NULL, NULL, 'not found' FROM last WHERE _id NOT IN (SELECT _id FROM kb)""",
)
def merge_update(spark, sf):
    n = F.col("l_linenumber")
    updates = load(spark, sf, "lineitem").select(
        F.concat(F.lit("kb"), (F.col("l_partkey") + F.when(n == 7, 1_000_000).otherwise(0)).cast("string")).alias("_id"),
        F.concat(F.lit("renamed "), F.col("l_orderkey").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.array_compact(F.array(F.when(n % 2 == 0, "name"), F.when(n % 3 == 0, "description"))).alias("_set"),
        ((F.col("l_orderkey") * 10 + n) * 100_000 + F.col("l_suppkey")).alias("_version"),
    )
    merged, unmatched = cat.merge_update(knowledge_base(spark, sf).select("_id", "name", "description"), updates, ["name", "description"])
    none = F.lit(None).cast("string")
    return merged.select("_id", "name", "description", F.when(F.col("_updated"), "updated").otherwise("kept").alias("outcome")).unionByName(
        unmatched.select("_id", none.alias("name"), none.alias("description"), F.lit("not found").alias("outcome"))
    )


CASCADE_SQL = f"""WITH {PROJECTS_SQL}, {KB_SQL}, {SESSIONS_SQL}, {TURNS_SQL}, {RESOURCES_SQL},
doomed AS (SELECT _id AS project_id FROM projects WHERE author = 'author1'),
ch AS (SELECT 'p' || (doc_id % 25) AS project_id FROM documents), bl AS (SELECT split_part(path, '/', 3) AS project_id FROM resources),
g AS (SELECT project_id, 'projects' AS what FROM doomed UNION ALL SELECT project_id, 'kb' FROM kb UNION ALL SELECT project_id, 'chunks' FROM ch
  UNION ALL SELECT project_id, 'blobs' FROM bl UNION ALL SELECT project_id, 'sessions' FROM sessions
  UNION ALL SELECT project_id, 'turns' FROM turns JOIN sessions ON sessions._id = turns.session_id)
"""


def _cascade(spark, sf):
    p = projects(spark, sf)
    chunks = load(spark, sf, "documents").select(F.concat(F.lit("p"), (F.col("doc_id") % 25).cast("string")).alias("project_id"))
    blobs = resource_paths(spark, sf).select(cat.project_of_path(F.col("path")).alias("project_id"), "path")
    doomed = p.where(F.col("author") == "author1").select(F.col("_id").alias("project_id"))
    return cat.cascade_delete(doomed, p, knowledge_base(spark, sf), chunks, sessions(spark, sf), turns(spark, sf), blobs)


@query(
    "cascade_delete_counts",
    CASCADE_SQL
    + """SELECT project_id, count(*) FILTER (what = 'projects') AS deleted_projects, count(*) FILTER (what = 'kb') AS deleted_kb,
  count(*) FILTER (what = 'chunks') AS deleted_chunks, count(*) FILTER (what = 'blobs') AS deleted_blobs,
  count(*) FILTER (what = 'sessions') AS deleted_sessions, count(*) FILTER (what = 'turns') AS deleted_turns
FROM g WHERE project_id IN (SELECT project_id FROM doomed) GROUP BY project_id""",
)
def cascade_delete_counts(spark, sf):
    return _cascade(spark, sf)[1]


@query(
    "cascade_delete_total",
    CASCADE_SQL
    + """SELECT count(*) FILTER (what = 'projects') AS deleted_projects, count(*) FILTER (what = 'kb') AS deleted_kb,
  count(*) FILTER (what = 'chunks') AS deleted_chunks, count(*) FILTER (what = 'blobs') AS deleted_blobs,
  count(*) FILTER (what = 'sessions') AS deleted_sessions, count(*) FILTER (what = 'turns') AS deleted_turns
FROM g WHERE project_id IN (SELECT project_id FROM doomed)""",
)
def cascade_delete_total(spark, sf):
    return cat.total_deleted(_cascade(spark, sf)[1])


@query(
    "cascade_delete_remaining",
    CASCADE_SQL
    + """SELECT what AS table_name, count(*) AS rows FROM (SELECT * FROM g UNION ALL SELECT _id, 'projects' FROM projects WHERE author != 'author1')
WHERE project_id NOT IN (SELECT project_id FROM doomed) GROUP BY what""",
)
def cascade_delete_remaining(spark, sf):
    remaining, _ = _cascade(spark, sf)
    parts = [df.groupBy().agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows")) for name, df in remaining.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(
    "update_metadata",
    f"""WITH {KB_SQL}, u AS (
  SELECT 'kb' || l_partkey AS kb_id, CASE l_linenumber % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'custom.brand' ELSE 'custom.added' END AS path,
         CASE WHEN l_linenumber = 5 THEN NULL ELSE 'v' || l_orderkey END AS value, (l_orderkey * 10 + l_linenumber) * 100000 + l_suppkey AS v FROM lineitem),
last AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY kb_id, path ORDER BY v DESC) = 1)
SELECT kb._id AS kb_id, CASE WHEN t.kb_id IS NULL THEN kb.name ELSE t.value END AS title, kb.description AS subject,
  CASE WHEN b.kb_id IS NULL THEN kb.source_type ELSE b.value END AS brand, a.value AS added
FROM kb LEFT JOIN last t ON t.kb_id = kb._id AND t.path = 'title' LEFT JOIN last b ON b.kb_id = kb._id AND b.path = 'custom.brand'
LEFT JOIN last a ON a.kb_id = kb._id AND a.path = 'custom.added'""",
)
def update_metadata(spark, sf):
    chunks = knowledge_base(spark, sf).select(
        F.col("_id").alias("kb_id"),
        F.struct(F.col("name").alias("title"), F.col("description").alias("subject"), F.create_map(F.lit("brand"), F.col("source_type")).alias("custom")).alias("metadata"),
    )
    n = F.col("l_linenumber")
    updates = load(spark, sf, "lineitem").select(
        F.concat(F.lit("kb"), F.col("l_partkey").cast("string")).alias("kb_id"),
        F.when(n % 3 == 0, "title").when(n % 3 == 1, "custom.brand").otherwise("custom.added").alias("path"),
        F.when(n != 5, F.concat(F.lit("v"), F.col("l_orderkey").cast("string"))).alias("value"),
        ((F.col("l_orderkey") * 10 + n) * 100_000 + F.col("l_suppkey")).alias("_version"),
    )
    out = cat.update_metadata(chunks, updates, ["title", "subject"], ["kb_id"])
    return out.select("kb_id", "metadata.title", "metadata.subject", F.col("metadata.custom")["brand"].alias("brand"), F.col("metadata.custom")["added"].alias("added"))


@query(
    "migrate_kb",
    f"""WITH {KB_SQL} SELECT _id, CASE WHEN model_version < 2 THEN CASE WHEN language = 'cs' THEN 'cs-CZ' ELSE 'en-US' END ELSE language END AS language,
  model_version < 2 AS migrated, CAST(2 AS BIGINT) AS model_version FROM kb""",
)
def migrate_kb(spark, sf):
    return cat.migrate_kb(knowledge_base(spark, sf)).select("_id", "language", "migrated", "model_version")


@query(
    "migrate_projects",
    f"""WITH {PROJECTS_SQL}, m AS (SELECT *, split_part(language, '-', 2) != '' AS ok FROM projects)
SELECT _id, strftime(CASE WHEN model_version < 4 THEN created_at ELSE modified_at END, {STAMP_SQL}) AS modified_at,
  CAST(4 AS BIGINT) AS model_version, CASE WHEN model_version >= 4 THEN 'current' WHEN ok THEN 'migrated' ELSE 'rejected: language' END AS outcome FROM m""",
)
def migrate_projects(spark, sf):
    moved = cat.migrate_projects(projects(spark, sf)).withColumn("modified_at", F.date_format("modified_at", STAMP))
    ok, bad = flt.split_valid(moved, {"language": flt.language_ok("language") | ~F.col("migrated")})
    outcome = F.concat(F.lit("rejected: "), F.array_join("broken", ",")).alias("outcome")
    columns = ["_id", "modified_at", F.col("model_version").cast("long").alias("model_version")]
    return ok.select(*columns, F.when(F.col("migrated"), "migrated").otherwise("current").alias("outcome")).unionByName(bad.select(*columns, outcome))


@query(
    "migrate_sessions",
    f"""WITH {SESSIONS_SQL}, {TURNS_SQL} SELECT 'session' AS what, _id, model_version < 3 AS migrated, CAST(greatest(model_version, 3) AS BIGINT) AS model_version FROM sessions
UNION ALL SELECT 'turn', _id, l_orderkey % 3 < 2, CAST(greatest(l_orderkey % 3, 2) AS BIGINT) FROM turns""",
)
def migrate_sessions(spark, sf):
    """Sessions and turns of several versions."""
    columns = ["_id", "migrated", F.col("model_version").cast("long").alias("model_version")]
    moved = cat.migrate_sessions(sessions(spark, sf)).select(F.lit("session").alias("what"), *columns)
    old = turns(spark, sf).withColumn("model_version", F.col("l_orderkey") % 3)
    return moved.unionByName(cat.migrate_turns(old).select(F.lit("turn").alias("what"), *columns))


@query(
    "cascade_sessions",
    f"""WITH {SESSIONS_SQL}, {TURNS_SQL}, d AS (SELECT _id AS session_id FROM sessions WHERE CAST(substr(_id, 2) AS BIGINT) % 7 = 0)
SELECT d.session_id, CAST(1 AS BIGINT) AS deleted_sessions, count(turns._id) AS deleted_turns FROM d LEFT JOIN turns ON turns.session_id = d.session_id GROUP BY d.session_id
UNION ALL SELECT 'left', (SELECT count(*) FROM sessions WHERE _id NOT IN (SELECT session_id FROM d)), (SELECT count(*) FROM turns WHERE session_id NOT IN (SELECT session_id FROM d))""",
)
def cascade_sessions(spark, sf):
    """Every seventh session goes with its turns."""
    own = sessions(spark, sf).withColumn("session_id", F.col("_id"))
    doomed = own.where(F.substring("_id", 2, 20).cast("long") % 7 == 0)
    remaining, counts = cat.cascade(doomed, "session_id", {"sessions": own, "turns": turns(spark, sf)})
    left = [remaining[n].select(F.lit(n).alias("what")) for n in ("sessions", "turns")]
    left = left[0].unionByName(left[1]).groupBy().agg(*[F.count_if(F.col("what") == n).alias(f"deleted_{n}") for n in remaining])
    return counts.unionByName(left.withColumn("session_id", F.lit("left")))


@query(
    "cascade_entries",
    f"""WITH {KB_SQL}, c AS (SELECT 'kb' || doc_id AS kb_id FROM documents), d AS (SELECT _id AS kb_id FROM kb WHERE source_type = 'html')
SELECT d.kb_id, CAST(1 AS BIGINT) AS deleted_kb, count(c.kb_id) AS deleted_chunks, CAST(1 AS BIGINT) AS deleted_blobs FROM d LEFT JOIN c ON c.kb_id = d.kb_id GROUP BY d.kb_id""",
)
def cascade_entries(spark, sf):
    """Entries of one type go with their chunks and files."""
    own = knowledge_base(spark, sf).withColumn("kb_id", F.col("_id"))
    chunks = load(spark, sf, "documents").select(F.concat(F.lit("kb"), F.col("doc_id").cast("string")).alias("kb_id"))
    tables = {"kb": own, "chunks": chunks, "blobs": own.select("kb_id", F.col("source_file").alias("path"))}
    return cat.cascade(own.where(F.col("source_type") == "html"), "kb_id", tables)[1]


@query(
    "first_user_query",
    f"""WITH {SESSIONS_SQL}, {TURNS_SQL}, f AS (
  SELECT session_id, user_query FROM turns QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at, _id) = 1)
SELECT sessions._id, CASE WHEN model_version < 3 AND coalesce(first_user_query, '') = '' THEN coalesce(nullif(user_query, ''), first_user_query)
  ELSE first_user_query END AS first_user_query FROM sessions LEFT JOIN f ON f.session_id = sessions._id""",
)
def first_user_query(spark, sf):
    return cat.backfill_first_query(sessions(spark, sf), turns(spark, sf)).select("_id", "first_user_query")


@query(
    "touch_projects",
    f"""WITH {PROJECTS_SQL}, {SESSIONS_SQL} SELECT projects._id, strftime(max(sessions.created_at), {STAMP_SQL}) AS modified_at
FROM projects LEFT JOIN sessions ON sessions.project_id = projects._id GROUP BY projects._id""",
)
def touch_projects(spark, sf):
    changes = sessions(spark, sf).select("project_id", F.col("created_at").alias("changed_at"))
    return cat.touch(projects(spark, sf), changes).select("_id", F.date_format("modified_at", STAMP).alias("modified_at"))


def conversation_turns(spark, sf):
    """A user message with the assistant message that follows it."""
    from pyspark.sql import Window

    c = load(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = c.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"))
    return paired.where(F.col("role") == "user").select(
        F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.col("turn").alias("created_at"),
        F.col("text").alias("user_query"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("").alias("system_response"),
    )


CONV_TURNS_SQL = """p AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
ct AS (SELECT 't' || conv_id || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS _id, 's' || conv_id AS session_id, turn AS created_at, text AS user_query,
  CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS system_response FROM p WHERE role = 'user')"""


def _context(mode):
    direction = "DESC" if mode == "latest" else "ASC"

    @query(
        f"context_window_{mode}",
        f"""WITH {TURNS_SQL} SELECT session_id, _id, user_query, strftime(created_at, {STAMP_SQL}) AS created_at FROM turns
QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turns.created_at {direction}, _id {direction}) <= 3""",
    )
    def plan(spark, sf):
        out = cat.context_window(turns(spark, sf), 3, mode)
        return out.select("session_id", "_id", "user_query", F.date_format("created_at", STAMP).alias("created_at"))


_context("latest")
_context("first")

MESSAGES_SQL = f"""{CONV_TURNS_SQL}, win AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, _id DESC) <= 5),
m AS (SELECT session_id, created_at, 0 AS k, 'user' AS role, trim(user_query) AS content FROM win
  UNION ALL SELECT session_id, created_at, 1, 'assistant', trim(system_response) FROM win),
h AS (SELECT session_id, count(*) AS n, string_agg(role || ': ' || content, chr(10) ORDER BY created_at, k) AS history FROM m WHERE content != '' GROUP BY session_id)"""


@query(
    "message_list",
    f"""WITH {MESSAGES_SQL}
SELECT session_id, n + 2 AS messages, 'system: sys' || chr(10) || history || chr(10) || 'user: next question' AS dialogue FROM h""",
)
def message_list(spark, sf):
    history = cat.history_messages(cat.context_window(conversation_turns(spark, sf)))
    msg = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), F.lit(text).alias("content")))
    messages = F.concat(msg("system", "sys"), F.col("history"), msg("user", "next question"))
    rendered = F.array_join(F.transform(messages, lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    return history.select("session_id", F.size(messages).cast("long").alias("messages"), rendered.alias("dialogue"))


@query(
    "rewrite_select",
    f"""WITH {CONV_TURNS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at) AS k FROM ct)
SELECT _id, CASE WHEN k = 1 THEN user_query WHEN k % 2 = 0 THEN 'rewritten ' || _id ELSE user_query END AS query FROM n""",
)
def rewrite_select(spark, sf):
    """The first turn has no history; the stand-in rewriter fails on every odd turn."""
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("created_at")
    ct = conversation_turns(spark, sf).withColumns(
        {"k": F.row_number().over(w), "previous": F.lag("user_query").over(w)}
    )
    history = F.when(F.col("previous").isNull(), F.array().cast("array<string>")).otherwise(F.array("previous"))
    rewritten = F.when(F.col("k") % 2 == 0, F.concat(F.lit("rewritten "), F.col("_id")))
    return ct.select("_id", tx.rewritten_query(F.col("user_query"), history, rewritten).alias("query"))


@query(
    "custom_filters",
    f"""WITH {KB_SQL} SELECT _id, total_pages FROM kb
WHERE source_type = 'pdf' AND total_pages >= 10 AND total_pages < 40 AND (name LIKE '%a%' OR project_id IN ('p1', 'p2')) IS NOT NULL
  AND (language = 'cs' OR project_id IN ('p1', 'p2')) AND NOT (project_id = 'p3') AND language IS NOT NULL""",
)
def custom_filters(spark, sf):
    """Clauses on struct fields and on a variant column."""
    kb = knowledge_base(spark, sf)
    shaped = kb.select(
        "_id",
        "total_pages",
        F.struct(
            "project_id",
            "language",
            F.parse_json(F.to_json(F.struct("source_type", F.struct(F.col("total_pages").alias("pages")).alias("size")))).alias("custom"),
        ).alias("metadata"),
    )
    clauses = [
        {"term": {"metadata.custom.source_type.keyword": "pdf"}},
        {"range": {"metadata.custom.size.pages": {"gte": 10, "lt": 40}}},
        {"bool": {"should": [{"term": {"metadata.language": "cs"}}, {"terms": {"metadata.project_id": ["p1", "p2"]}}], "must_not": {"term": {"metadata.project_id": "p3"}}}},
        {"exists": {"field": "metadata.language"}},
    ]
    return flt.custom_filter(shaped, clauses).select("_id", "total_pages")


@query(
    "validated_rows",
    """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'en-US' WHEN 1 THEN 'cs' WHEN 2 THEN 'cs-CZ' ELSE NULL END AS language,
  event_type AS kind, CASE WHEN value >= 34 THEN 1 WHEN value < 10 THEN 0 ELSE -1 END AS feedback FROM events)
SELECT event_id, concat_ws(',', CASE WHEN language NOT LIKE '%-%' THEN 'language' END, CASE WHEN kind NOT IN ('click', 'view', 'purchase') THEN 'kind' END,
  CASE WHEN feedback NOT IN (1, -1) THEN 'feedback' END) AS broken FROM e""",
)
def validated_rows(spark, sf):
    k = F.col("event_id")
    rows = load(spark, sf, "events").select(
        "event_id",
        F.when(k % 4 == 0, "en-US").when(k % 4 == 1, "cs").when(k % 4 == 2, "cs-CZ").alias("language"),
        F.col("event_type").alias("kind"),
        F.when(F.col("value") >= 34, 1).when(F.col("value") < 10, 0).otherwise(-1).alias("feedback"),
    )
    rules = {
        "language": flt.language_ok("language"),
        "kind": F.col("kind").isin("click", "view", "purchase"),
        "feedback": F.col("feedback").isin(1, -1),
    }
    ok, bad = flt.split_valid(rows, rules)
    return ok.select("event_id", F.lit("").alias("broken")).unionByName(bad.select("event_id", F.array_join("broken", ",").alias("broken")))


@query(
    "defaults_fill",
    f"""WITH {KB_SQL}, {PROJECTS_SQL} SELECT kb._id, coalesce(nullif(kb.language, ''), p.language) AS language,
  coalesce(nullif(CASE WHEN kb.total_pages % 2 = 0 THEN '' ELSE kb.name END, ''), split_part(source_file, '/', -1)) AS name
FROM kb LEFT JOIN projects p ON p._id = kb.project_id""",
)
def defaults_fill(spark, sf):
    kb = knowledge_base(spark, sf).withColumn("given", F.when(F.col("total_pages") % 2 == 0, "").otherwise(F.col("name")))
    proj = projects(spark, sf).select(F.col("_id").alias("project_id"), F.col("language").alias("project_language"))
    filled = kb.join(proj, "project_id", "left").withColumn("base_name", flt.file_name(F.col("source_file")))
    return filled.select("_id", flt.filled("language", "project_language").alias("language"), flt.filled("given", "base_name").alias("name"))


@query(
    "metadata_assembly",
    f"""WITH {KB_SQL}, {TURNS_SQL}, d AS (
  SELECT kb_id, rank AS chunk_idx, CASE WHEN page % 2 = 0 THEN 'T' || page END AS title, CASE WHEN page > 5 THEN page END AS page, _id
  FROM turns QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY rank, _id) = 1)
SELECT d.kb_id, chunk_idx, coalesce(d.title, '') AS title, '' AS author, coalesce(d.page, 1) AS page, kb.project_id,
  coalesce(kb.language, 'en-US') AS language, 'pages=' || total_pages AS custom FROM d JOIN kb ON kb._id = d.kb_id""",
)
def metadata_assembly(spark, sf):
    from ..operators.store import assemble_metadata, first_metadata

    loader = turns(spark, sf).select(
        "kb_id", "_id", F.col("rank").alias("chunk_idx"), F.when(F.col("page") % 2 == 0, F.concat(F.lit("T"), F.col("page").cast("string"))).alias("title"),
        F.when(F.col("page") > 5, F.col("page")).alias("page"), F.lit("ignored").alias("unknown_field"),
    )
    general = knowledge_base(spark, sf).select(
        F.col("_id").alias("kb_id"), "project_id", "language", "source_file", "source_type",
        F.create_map(F.lit("pages"), F.col("total_pages").cast("string")).alias("custom"),
    )
    out = first_metadata(assemble_metadata(loader, general))
    return out.select(
        "kb_id", "metadata.chunk_idx", "metadata.title", "metadata.author", "metadata.page", "metadata.project_id", "metadata.language",
        F.concat(F.lit("pages="), F.col("metadata.custom")["pages"]).alias("custom"),
    )


@query(
    "distinct_ids",
    """SELECT DISTINCT 'p' || (doc_id % 5) AS project_id, source AS kb_id FROM documents ORDER BY 1, 2""",
)
def distinct_ids(spark, sf):
    rows = load(spark, sf, "documents").select(F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string")).alias("project_id"), F.col("source").alias("_id"))
    return cat.id_counts(rows).withColumnRenamed("_id", "kb_id").orderBy("project_id", "kb_id")


@query(
    "resource_listing",
    f"""WITH {RESOURCES_SQL} SELECT path FROM resources WHERE starts_with(path, 'data/projects/p1') AND contains(path, '/knowledge_base/')
  AND ends_with(regexp_replace(path, '\\.[^.]*$', ''), 'source') ORDER BY path""",
)
def resource_listing(spark, sf):
    from ..sources.files import list_paths, source_files

    return source_files(list_paths(resource_paths(spark, sf), "data/projects/p1"), "kb_source", "source")


@query(
    "resource_fallback",
    f"""WITH {KB_SQL}, c AS (
  SELECT _id AS request_id, unnest([{{'priority': 0, 'path': 'data/projects/' || project_id || '/dialogue.json'}}, {{'priority': 1, 'path': 'data/dialogue.json'}}]) AS c FROM kb),
e AS (SELECT DISTINCT 'data/projects/p' || (n_nationkey) || '/dialogue.json' AS path FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'data/dialogue.json')
SELECT request_id, arg_min(c.path, c.priority) AS path, CAST(min(c.priority) AS BIGINT) AS priority FROM c JOIN e ON e.path = c.path GROUP BY request_id""",
)
def resource_fallback(spark, sf):
    from ..sources.files import resource_candidates

    requests = knowledge_base(spark, sf).select(F.col("_id").alias("request_id"), "project_id", F.lit("dialogue_fsm").alias("resource_type"))
    own = load(spark, sf, "nation").where(F.col("n_nationkey") % 3 == 0).select(
        F.concat(F.lit("data/projects/p"), F.col("n_nationkey").cast("string"), F.lit("/dialogue.json")).alias("path")
    )
    default = load(spark, sf, "nation").where(F.col("n_nationkey") == 0).select(F.lit("data/dialogue.json").alias("path"))
    out = cat.first_existing(resource_candidates(requests, "data"), own.unionByName(default))
    return out.withColumn("priority", F.col("priority").cast("long"))


@query(
    "name_normalise",
    """SELECT p_partkey, translate(lower(p_name || ' ' || p_brand || '_v1.2/x'), ' "#*+,./:<>?\\_|', '---------------') AS partition_name FROM part""",
)
def name_normalise(spark, sf):
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("_v1.2/x"))
    return load(spark, sf, "part").select("p_partkey", tx.partition_name(name).alias("partition_name"))


@query(
    "dotted_keys",
    f"""WITH {KB_SQL} SELECT _id, unnest(['name', 'size.pages', 'size.unit.code']) AS key, unnest([name, CAST(total_pages AS VARCHAR), source_type]) AS value FROM kb""",
)
def dotted_keys(spark, sf):
    nested = knowledge_base(spark, sf).select(
        "_id",
        F.struct("name", F.struct(F.col("total_pages").alias("pages"), F.struct(F.col("source_type").alias("code")).alias("unit")).alias("size")).alias("m"),
    )
    return flt.dotted_rows(nested, "_id", "m")


@query("header_b64", """SELECT doc_id, to_base64(encode(text)) AS header FROM documents""")
def header_b64(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.header_base64(F.col("text")).alias("header"))


@query(
    "context_prompt",
    f"""WITH {TURNS_SQL}, {KB_SQL} SELECT session_id, 'Answer in ' || CASE WHEN l_orderkey % 2 = 0 THEN 'Czech' ELSE 'English' END || ' and only from this context.' || chr(10) || chr(10)
  || '<CONTEXT>' || chr(10) || string_agg(kb.name || ' {{language}}', chr(10) || chr(10) ORDER BY rank, turns._id) || chr(10) || '</CONTEXT>' AS prompt
FROM turns JOIN kb ON kb._id = turns.kb_id GROUP BY session_id, l_orderkey""",
)
def context_prompt(spark, sf):
    from ..operators.fusion import context_text

    kb = knowledge_base(spark, sf).select(F.col("_id").alias("kb_id"), F.concat(F.col("name"), F.lit(" {language}")).alias("text"))
    hits = turns(spark, sf).select("session_id", "l_orderkey", "kb_id", "rank", F.col("_id").alias("doc_id")).join(kb, "kb_id")
    context = context_text(hits, ["session_id", "l_orderkey"])
    language = F.when(F.col("l_orderkey") % 2 == 0, "cs-CZ").otherwise("xx")
    return context.select("session_id", tx.fill_template(tx.CONTEXT_TEMPLATE, F.col("context"), language).alias("prompt"))
