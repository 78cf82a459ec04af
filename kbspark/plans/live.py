"""Streaming queries: every one drains what is available and is compared with its batch form in SQL."""

from pyspark.sql import functions as F

from ..operators import catalog as cat
from ..session import scratch_path
from ..sources.tables import LOGS_SQL, RAW_LOGS_SQL, event_log, load, raw_logs
from ..streaming import answers as an, jobs
from .catalog import CONV_TURNS_SQL, conversation_turns
from .events import COUNTS_SQL
from .registry import query


def pieces(spark, sf):
    """Assistant messages cut every 20 characters; some pieces come twice, some answers never end, some have no session."""
    c = load(spark, sf, "conversations").where(F.col("role") == "assistant")
    k = F.col("conv_id")
    count = F.greatest(F.lit(1), F.ceil(F.length("text") / 20)).cast("int")
    cut = c.withColumn("n", count).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    last = (F.col("i") == F.col("n") - 1) & (k % 9 != 5)
    rows = cut.select(
        F.concat(F.lit("r"), k.cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("response_id"),
        F.when(k % 8 != 3, F.concat(F.lit("s"), k.cast("string"))).alias("session_id"),
        F.col("i").cast("long").alias("chunk_index"), last.alias("is_last_chunk"), F.substring(F.col("text"), F.col("i") * 20 + 1, F.lit(20)).alias("text"),
        F.when(last, F.array(*[F.struct(F.concat(F.lit("kb"), (k + s).cast("string")).alias("kb_id"), (F.col("turn") + s).alias("page")) for s in (0, 1)])).alias("matched"),
    )
    return rows.unionByName(rows.where(F.col("chunk_index") % 7 == 3))


ANSWERS_SQL = """a AS (SELECT conv_id, turn, 'r' || conv_id || '-' || turn AS response_id, CASE WHEN conv_id % 8 != 3 THEN 's' || conv_id END AS session_id, text FROM conversations WHERE role = 'assistant' AND conv_id % 9 != 5)"""
ANSWER_SELECT = """SELECT response_id, session_id, md5(text) AS digest, 'kb' || conv_id || ':' || turn || ',kb' || (conv_id + 1) || ':' || (turn + 1) AS matched FROM a"""


def _shown(answers):
    matched = F.array_join(F.transform("matched", lambda m: F.concat_ws(":", m["kb_id"], m["page"].cast("string"))), ",")
    return answers.select("response_id", "session_id", F.md5("text_full").alias("digest"), matched.alias("matched"))


@query("answer_assembly", f"WITH {ANSWERS_SQL} {ANSWER_SELECT}")
def answer_assembly(spark, sf):
    return _shown(an.assemble(pieces(spark, sf)))


@query("answer_assembly_stream", f"WITH {ANSWERS_SQL} {ANSWER_SELECT}")
def answer_assembly_stream(spark, sf):
    source, out = scratch_path(spark, "pieces"), scratch_path(spark, "answers")
    # ordered by a hash, so pieces of an answer arrive out of order and in different micro-batches
    table = pieces(spark, sf).repartition(4, F.xxhash64("response_id", "chunk_index"))
    table.write.parquet(source)
    stream = jobs.read_stream(spark, source, table.schema, files_per_trigger=2)
    jobs.drain(an.assemble_stream(stream), out)
    return _shown(spark.read.parquet(f"{out}/data"))


@query("answer_assembly_expiring", f"WITH {ANSWERS_SQL} {ANSWER_SELECT}")
def answer_assembly_expiring(spark, sf):
    """Pieces carry the time they were sent; an answer's pieces come out of order over three batches, and its state ends an hour after the last."""
    source, out = scratch_path(spark, "pieces"), scratch_path(spark, "answers")
    minute = F.crc32("response_id") % 600 + F.col("chunk_index")
    rows = pieces(spark, sf).withColumn("sent_at", F.timestamp_seconds(F.lit(1_700_000_000) + 60 * minute))
    table = rows.repartition(6, F.xxhash64("response_id", "chunk_index"))
    table.write.parquet(source)
    stream = jobs.read_stream(spark, source, table.schema, files_per_trigger=2)
    jobs.drain(an.assemble_stream(stream, timeout_minutes=60, late_minutes=10_000), out)
    return _shown(spark.read.parquet(f"{out}/data"))


@query(
    "turns_from_answers",
    f"""WITH {ANSWERS_SQL}, q AS (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS asked, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS who FROM conversations)
SELECT session_id, response_id, sha1(session_id || '|' || response_id) AS _id, md5(asked) AS query_digest, md5(text) AS digest, 'kb' || a.conv_id || ',kb' || (a.conv_id + 1) AS kb_ids, a.turn || ',' || (a.turn + 1) AS pages
FROM a JOIN q ON q.conv_id = a.conv_id AND q.turn = a.turn WHERE session_id IS NOT NULL AND who = 'user'""",
)
def turns_from_answers(spark, sf):
    asked = conversation_turns(spark, sf).select(
        F.concat(F.lit("r"), F.substring("session_id", 2, 20), F.lit("-"), (F.col("created_at") + 1).cast("string")).alias("response_id"), "user_query"
    )
    out = an.turns(an.assemble(pieces(spark, sf)), asked)
    return out.select(
        "session_id", "response_id", "_id", F.md5("user_query").alias("query_digest"), F.md5("system_response").alias("digest"),
        F.array_join("matched_kb_ids", ",").alias("kb_ids"), F.array_join(F.transform("matched_pages", lambda p: p.cast("string")), ",").alias("pages"),
    )


def _in_files(df, spark, name, key, files=6):
    """``df`` written to files dealt by a hash of ``key``, so that a stream of two files a batch gets rows of all times in every batch."""
    path = scratch_path(spark, name)
    df.repartition(files, F.xxhash64(key)).write.parquet(path)
    return path


def _event_stream(spark, sf):
    events = load(spark, sf, "events")
    return event_log(jobs.read_stream(spark, _in_files(events, spark, "events", "event_id"), events.schema, files_per_trigger=2))


@query(
    "stream_session_metrics",
    f"""WITH {LOGS_SQL} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, project_id, session_id, {COUNTS_SQL}, count(DISTINCT user_id) AS users FROM logs GROUP BY ALL""",
)
def stream_session_metrics(spark, sf):
    """A session has one user, so the sketch of its users is exact."""
    out, keys = scratch_path(spark, "metrics"), ("project_id", "session_id")
    jobs.drain_batches(_event_stream(spark, sf), out, lambda batch: jobs.partial_metrics(batch, "1 day", keys))
    return jobs.merged_metrics(spark, out, keys).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), *keys, *jobs.COUNTS, "users")


@query(
    "stream_segments",
    f"""WITH {LOGS_SQL}, w AS (SELECT logs.*, unnest([0, 6]) AS back FROM logs)
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(back), '%Y-%m-%d %H') AS window_start, project_id, {COUNTS_SQL} FROM w GROUP BY ALL""",
)
def stream_segments(spark, sf):
    """Sliding windows of 12 hours every 6 hours."""
    out, keys = scratch_path(spark, "segments"), ("project_id",)
    jobs.drain_batches(_event_stream(spark, sf), out, lambda batch: jobs.partial_metrics(batch, "12 hours", keys, "6 hours"))
    return jobs.merged_metrics(spark, out, keys).drop("users").withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


@query(
    "log_ingest",
    f"""WITH {RAW_LOGS_SQL} SELECT strftime(created, '%Y-%m-%d') AS event_date, CASE WHEN response THEN 'response' WHEN name LIKE 'urllib3%' THEN 'request' ELSE 'log' END AS log_type,
  count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS checksum FROM raw WHERE coalesce(path, '') != '/health' GROUP BY ALL""",
)
def log_ingest(spark, sf):
    """JSON records with repeats, out of order over five micro-batches, through the normaliser into a table partitioned by date."""
    source, out = scratch_path(spark, "raw"), scratch_path(spark, "log")
    raw = raw_logs(spark, sf)
    raw.unionByName(raw.where(F.col("event_id") % 10 == 0)).repartition(10, F.xxhash64("event_id", F.rand(3))).write.json(source)
    jobs.drain(jobs.ingest_records(jobs.read_stream(spark, source, raw.schema, "json", files_per_trigger=2)), out, ["event_date"])
    grouped = jobs.stored_records(spark, out).groupBy(F.col("event_date").cast("string").alias("event_date"), "log_type")
    return grouped.agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("checksum"))


@query(
    "keep_first_query",
    f"""WITH {CONV_TURNS_SQL} SELECT session_id, md5(arg_min(user_query, created_at)) AS digest FROM ct WHERE user_query != '' GROUP BY session_id""",
)
def keep_first_query(spark, sf):
    out, table = scratch_path(spark, "first"), conversation_turns(spark, sf)
    stream = jobs.read_stream(spark, _in_files(table, spark, "turns", "_id", 3), table.schema, files_per_trigger=1)
    jobs.drain_batches(stream, out, jobs.first_queries)
    return jobs.first_queries(spark.read.parquet(f"{out}/data")).select("session_id", F.md5("user_query").alias("digest"))


@query(
    "stream_touch",
    """SELECT 'p' || (user_id % 5) AS _id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS modified_at FROM events GROUP BY 1""",
)
def stream_touch(spark, sf):
    """Latest change per project, merged into the projects that changed."""
    out = scratch_path(spark, "touch")
    latest = lambda rows: rows.groupBy("project_id").agg(F.max("changed_at").alias("changed_at"))
    jobs.drain_batches(_event_stream(spark, sf).select("project_id", F.col("ts").alias("changed_at")), out, latest)
    changed = latest(spark.read.parquet(f"{out}/data"))
    projects = changed.select(F.col("project_id").alias("_id"), F.lit(None).cast("timestamp").alias("modified_at"))
    return cat.touch(projects, changed).select("_id", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("modified_at"))
