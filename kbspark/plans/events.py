"""Event-log reports."""

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import events as ev
from ..sources import logs as records
from ..sources.tables import LOGS_SQL, RAW_LOGS_SQL, load, logs, raw_logs
from .registry import query

RANGE = ("2024-01-03", "2024-01-20")
RANGE_SQL = "ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20 23:59:59.999999'"
NOW = datetime(2024, 1, 28, 12, 30)
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
STAMP_SQL = "'%Y-%m-%d %H:%M:%S.%f'"

COUNTS_SQL = """count(*) FILTER (message = 'query') AS queries, count(*) FILTER (message = 'user_feedback') AS feedbacks,
  count(*) FILTER (message = 'user_feedback' AND feedback = 1) AS positive,
  count(*) FILTER (message = 'user_feedback' AND feedback = -1) AS negative"""


@query(
    "session_report",
    f"""WITH {LOGS_SQL}, g AS (
  SELECT project_id, session_id, min(ts) FILTER (func_name = 'start_session') AS started, {COUNTS_SQL}
  FROM logs WHERE {RANGE_SQL} GROUP BY project_id, session_id)
SELECT project_id, session_id, strftime(started, {STAMP_SQL}) AS started_at, queries, feedbacks, positive, negative,
  CASE WHEN positive + negative > 0 THEN round(positive * 100.0 / (positive + negative), 2) ELSE 0.0 END::DOUBLE AS positive_pct,
  CASE WHEN positive + negative > 0 THEN round(negative * 100.0 / (positive + negative), 2) ELSE 0.0 END::DOUBLE AS negative_pct
FROM g WHERE started IS NOT NULL""",
)
def session_report(spark, sf):
    report = ev.session_report(logs(spark, sf), *ev.day_bounds(*RANGE))
    return report.withColumn("started_at", F.date_format("started_at", STAMP)).orderBy(F.col("started_at").desc(), "session_id")


@query(
    "project_summary",
    f"""WITH {LOGS_SQL} SELECT project_id, count(DISTINCT session_id) FILTER (query IS NOT NULL) AS sessions, {COUNTS_SQL}
FROM logs WHERE {RANGE_SQL} GROUP BY project_id""",
)
def project_summary(spark, sf):
    return ev.project_summary(ev.in_range(logs(spark, sf), *ev.day_bounds(*RANGE)))


@query("unique_users", f"WITH {LOGS_SQL} SELECT project_id, count(DISTINCT user_id) AS users FROM logs WHERE {RANGE_SQL} GROUP BY project_id")
def unique_users(spark, sf):
    return ev.unique_users(ev.in_range(logs(spark, sf), *ev.day_bounds(*RANGE)))


@query("approx_sessions_users")
def approx_sessions_users(spark, sf):
    """Sketch twins of the exact distinct counts."""
    rows = ev.in_range(logs(spark, sf), *ev.day_bounds(*RANGE))
    both = ev.project_summary(rows, approximate=True).select("project_id", F.col("sessions").alias("approx_sessions"))
    return both.join(ev.unique_users(rows, approximate=True).withColumnRenamed("users", "approx_users"), "project_id")


@query(
    "approx_error",
    f"WITH {LOGS_SQL} SELECT project_id, true AS sessions_close, true AS users_close FROM logs WHERE {RANGE_SQL} GROUP BY project_id",
)
def approx_error(spark, sf):
    """The sketches against the exact counts: each is at most a tenth away, and one more where there are few."""
    rows = ev.in_range(logs(spark, sf), *ev.day_bounds(*RANGE))
    exact = ev.project_summary(rows).select("project_id", "sessions").join(ev.unique_users(rows), "project_id")
    both = exact.join(approx_sessions_users(spark, sf), "project_id")
    close = lambda c: F.abs(F.col(f"approx_{c}") - F.col(c)) <= 1 + 0.1 * F.col(c)
    return both.select("project_id", close("sessions").alias("sessions_close"), close("users").alias("users_close"))


def _segment_sql(bounds):
    rows = ", ".join(f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, (a, b) in enumerate(zip(bounds, bounds[1:])))
    return f"""WITH {LOGS_SQL}, seg(segment, a, b) AS (VALUES {rows}), pr AS (SELECT DISTINCT project_id FROM logs)
SELECT pr.project_id, segment, strftime(a, {STAMP_SQL}) AS "start", strftime(b, {STAMP_SQL}) AS "end",
  count(DISTINCT session_id) FILTER (query IS NOT NULL) AS sessions, {COUNTS_SQL}
FROM pr CROSS JOIN seg LEFT JOIN logs ON logs.project_id = pr.project_id AND ts >= a AND ts < b
GROUP BY pr.project_id, segment, a, b"""


def _segments(time_range):
    bounds = ev.segment_bounds(time_range, NOW)

    @query(f"segment_summary_{time_range}", _segment_sql(bounds))
    def plan(spark, sf):
        out = ev.segment_summary(logs(spark, sf), time_range, NOW)
        return out.withColumns({c: F.date_format(c, STAMP) for c in ("start", "end")})


for _r in ("hour", "day", "week", "month", "all"):
    _segments(_r)


@query(
    "latest_logs",
    f"""WITH {LOGS_SQL} SELECT event_id, strftime(ts, {STAMP_SQL}) AS ts, project_id, message, (SELECT count(*) FROM logs) AS total
FROM logs ORDER BY logs.ts DESC, event_id DESC LIMIT 1000""",
)
def latest_logs(spark, sf):
    out = ev.latest_logs(logs(spark, sf).select("event_id", "ts", "project_id", "message"), 1000)
    return out.withColumn("ts", F.date_format("ts", STAMP))


@query(
    "error_counts",
    f"""WITH {LOGS_SQL} SELECT project_id, session_id, count(*) AS errors FROM logs WHERE func_name = 'log_client_event'
GROUP BY project_id, session_id""",
)
def error_counts(spark, sf):
    return ev.error_counts(logs(spark, sf))


@query(
    "error_counts_top",
    f"""WITH {LOGS_SQL}, c AS (SELECT project_id, session_id, count(*) AS errors FROM logs WHERE func_name = 'log_client_event' GROUP BY project_id, session_id)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY errors DESC, session_id) <= 10""",
)
def error_counts_top(spark, sf):
    """The sessions of each project that have most errors."""
    return ev.error_counts(logs(spark, sf), 10)


def _session_timeline_sql(session="session_id"):
    return f"""WITH {LOGS_SQL}, r AS (
  SELECT * REPLACE ({session} AS session_id), CASE WHEN func_name = 'start_session' THEN 'start_session' ELSE message END AS kind FROM logs), n AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, session_id ORDER BY ts, event_id) AS seq FROM r
  WHERE kind IN ('start_session', 'query', 'answer', 'user_feedback'))
SELECT project_id, session_id, seq, kind AS message, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp,
  CASE WHEN kind = 'start_session' THEN component_id END AS component_id, CASE WHEN kind = 'start_session' THEN user_id END AS user_id,
  CASE WHEN kind = 'query' THEN query END AS query, CASE WHEN kind = 'answer' THEN answer END AS answer,
  CAST(CASE WHEN kind = 'user_feedback' THEN feedback END AS BIGINT) AS feedback
FROM n"""


@query("session_timeline", _session_timeline_sql())
def session_timeline(spark, sf):
    out = ev.session_timeline(logs(spark, sf)).select("*", "data.*").drop("data")
    return out.withColumn("feedback", F.col("feedback").cast("long"))


# All events of a project as one session of thousands of events.
ONE_SESSION = "'all'"


@query("session_timeline_long", _session_timeline_sql(ONE_SESSION))
def session_timeline_long(spark, sf):
    out = ev.session_timeline(logs(spark, sf).withColumn("session_id", F.expr(ONE_SESSION))).select("*", "data.*").drop("data")
    return out.withColumn("feedback", F.col("feedback").cast("long"))


def _error_timeline_sql(session="session_id"):
    return f"""WITH {LOGS_SQL}, n AS (
  SELECT * REPLACE ({session} AS session_id), row_number() OVER (PARTITION BY project_id, {session} ORDER BY ts, event_id) AS seq FROM logs WHERE func_name = 'log_client_event')
SELECT project_id, session_id, seq, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, 'client' AS type,
  coalesce(log_level, '') AS level, coalesce(log_stack, '') AS stack, coalesce(log_message, '') AS message
FROM n"""


@query("error_timeline", _error_timeline_sql())
def error_timeline(spark, sf):
    return ev.error_timeline(logs(spark, sf))


@query("error_timeline_long", _error_timeline_sql(ONE_SESSION))
def error_timeline_long(spark, sf):
    return ev.error_timeline(logs(spark, sf).withColumn("session_id", F.expr(ONE_SESSION)))


@query(
    "log_normalise",
    f"""WITH {RAW_LOGS_SQL}
SELECT event_id, strftime(created, {STAMP_SQL}) AS ts, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, name AS logger_name,
  func_name, module, CASE WHEN response THEN 'response' WHEN name LIKE 'urllib3%' THEN 'request' ELSE 'log' END AS log_type, props AS message,
  CAST(status_code AS BIGINT) AS status_code, method, CASE WHEN response THEN '10.0.0.1:8080' END AS server, client, path, query_string, request_id, elapsed_us,
  CASE WHEN event_type = 'error' THEN 'Traceback ' || props END AS exception, CASE WHEN event_type = 'error' THEN event_id % 400 END AS lineno
FROM raw WHERE coalesce(path, '') != '/health'""",
)
def log_normalise(spark, sf):
    out = records.drop_health_checks(records.normalise_records(raw_logs(spark, sf)))
    return out.withColumn("ts", F.date_format("ts", STAMP)).withColumn("status_code", F.col("status_code").cast("long"))


@query(
    "log_fields",
    f"""WITH {RAW_LOGS_SQL}
SELECT event_id, '1' AS version, 'node' AS host, module || '.py' AS filename, 'nlp' AS component, CASE WHEN response THEN 'http://h' || path END AS request_url,
  CASE WHEN response THEN CASE WHEN event_id % 4 = 0 THEN 'c' || event_id ELSE '' END END AS correlation_id,
  CASE WHEN event_type = 'error' THEN 7 END::BIGINT AS process, CASE WHEN event_type = 'error' THEN 'main' END AS thread_name,
  CASE WHEN event_id % 6 = 0 THEN 'x' || event_id END AS request_id_field, CASE WHEN response AND event_id % 8 = 0 THEN 'u' || user_id END AS user_field,
  (CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN response AND event_id % 8 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_fields FROM raw""",
)
def log_fields(spark, sf):
    """Where records were written, headers, process fields with exceptions and added fields under their column names."""
    k, raw = F.col("event_id"), raw_logs(spark, sf)
    ids = load(spark, sf, "events").select(k.alias("e"), "user_id")
    scope = F.col("scope")
    raw = raw.join(ids, k == F.col("e")).withColumns(
        {
            "filename": F.concat(F.coalesce("module_override", "module"), F.lit(".py")), "process": F.lit(7), "thread_name": F.lit("main"), "process_name": F.lit("worker"),
            "extra": F.when(k % 6 == 0, F.create_map(F.lit("x-request-id"), F.concat(F.lit("x"), k.cast("string")))),
            "scope": F.when(
                scope.isNotNull(),
                scope.withField("request_url", F.concat(F.lit("http://h"), scope["path"]))
                .withField("headers", F.when(k % 4 == 0, F.create_map(F.lit("x-correlation-id"), F.concat(F.lit("c"), k.cast("string")))))
                .withField("attributes", F.create_map(F.lit("user"), F.when(k % 8 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.lit("other"), F.lit("o"))),
            ),
        }
    )
    out = records.record_fields(raw, "node", {"component": "nlp"}, ("user",))
    return out.select(
        "event_id", "version", "host", "filename", "component", "request_url", "correlation_id", "process", "thread_name",
        F.element_at("fields", "request_id").alias("request_id_field"), F.element_at("fields", "user").alias("user_field"), F.size("fields").cast("long").alias("n_fields"),
    )


@query(
    "request_context",
    f"""WITH {RAW_LOGS_SQL}
SELECT event_id, coalesce(nullif(regexp_extract(coalesce(path, ''), '/projects/([^/]+)', 1), ''),
    nullif(regexp_extract(coalesce(query_string, ''), 'project_id=([^&]*)', 1), '')) AS project_id,
  nullif(regexp_extract(coalesce(path, ''), '/sessions/([^/]+)', 1), '') AS session_id,
  nullif(regexp_extract(coalesce(query_string, ''), 'user_id=([^&]*)', 1), '') AS user_id, CAST(NULL AS VARCHAR) AS kb_id,
  coalesce(request_id, substr(sha256(event_id || '|' || strftime(created, {STAMP_SQL})), 1, 32)) AS correlation_id,
  client, round(elapsed_us / 1000.0, 3)::DOUBLE AS response_ms
FROM raw WHERE response""",
)
def request_context(spark, sf):
    flat = records.normalise_records(raw_logs(spark, sf)).where(F.col("log_type") == "response")
    return records.request_context(flat).select(
        "event_id", "project_id", "session_id", "user_id", "kb_id", "correlation_id", "client", "response_ms"
    )
