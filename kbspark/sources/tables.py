"""Given tables and the event log, catalog and retrieval tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


# Tables whose rows are expensive to process, with the key they may be spread by.
HEAVY = {"documents": "doc_id", "pages": "page_id"}


SMALL_BYTES = 256 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a small table that its few files would give to few tasks.

    A table above SMALL_BYTES is left alone whatever the number of cores, so at scale nothing is shuffled. The rows are dealt by a hash of the
    key and not by the key, so later joins and windows plan as for a large table. Hashing is repeatable after a lost task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, F.xxhash64(key)) if size <= SMALL_BYTES and len(df.inputFiles()) < cores else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, HEAVY[name]) if name in HEAVY else df


def event_log(events: DataFrame) -> DataFrame:
    """Project raw events onto the event-log schema (one row per event)."""
    kind = F.col("event_type")

    def by_kind(**values):
        out = F.lit(None).cast("string")
        for name, value in values.items():
            out = F.when(kind == name, value).otherwise(out)
        return out

    user = F.col("user_id").cast("string")
    project = F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string"))
    ts = F.col("ts").cast("timestamp")
    session = F.concat(F.lit("s"), user, F.lit("-"), F.date_format(ts, "yyyyMMdd"))
    return events.select(
        "event_id",
        ts.alias("ts"),
        project.alias("project_id"),
        session.alias("session_id"),
        F.concat(F.lit("u"), user).alias("user_id"),
        by_kind(
            signup=F.lit("start_session"),
            click=F.lit("ask_question"),
            view=F.lit("response_generator"),
            purchase=F.lit("user_feedback"),
            error=F.lit("log_client_event"),
        ).alias("func_name"),
        by_kind(
            signup=F.lit("Starting session"),
            click=F.lit("query"),
            view=F.lit("answer"),
            purchase=F.lit("user_feedback"),
            error=F.lit("client_log"),
        ).alias("message"),
        F.when(kind == "click", F.col("props")).alias("query"),
        F.when(kind == "view", F.col("props")).alias("answer"),
        F.when(kind == "purchase", F.when(F.col("value") >= 34, 1).otherwise(-1)).alias("feedback"),
        F.when(kind == "signup", F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string"))).alias("component_id"),
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"),
        F.when(
            kind == "error",
            F.struct(
                ts.alias("timestamp"),
                F.lit("client").alias("type"),
                F.when(F.col("event_id") % 2 == 0, "error").alias("level"),
                F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("stack-"), F.col("event_id").cast("string"))).alias("stack"),
                F.col("props").alias("message"),
                project.alias("project_id"),
                session.alias("session_id"),
            ),
        ).alias("logs"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(load(spark, sf_dir, "events"))


# The same event log for the oracle.
LOGS_SQL = """logs AS (
  SELECT event_id, ts, 'p' || (user_id % 5) AS project_id,
         's' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, 'u' || user_id AS user_id,
         CASE event_type WHEN 'signup' THEN 'start_session' WHEN 'click' THEN 'ask_question' WHEN 'view' THEN 'response_generator'
              WHEN 'purchase' THEN 'user_feedback' WHEN 'error' THEN 'log_client_event' END AS func_name,
         CASE event_type WHEN 'signup' THEN 'Starting session' WHEN 'click' THEN 'query' WHEN 'view' THEN 'answer'
              WHEN 'purchase' THEN 'user_feedback' WHEN 'error' THEN 'client_log' END AS message,
         CASE WHEN event_type = 'click' THEN props END AS query,
         CASE WHEN event_type = 'view' THEN props END AS answer,
         CASE WHEN event_type = 'purchase' THEN CASE WHEN value >= 34 THEN 1 ELSE -1 END END AS feedback,
         CASE WHEN event_type = 'signup' THEN 'c' || (event_id % 3) END AS component_id,
         CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'error' END AS log_level,
         CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'stack-' || event_id END AS log_stack,
         CASE WHEN event_type = 'error' THEN props END AS log_message
  FROM events)"""


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log before normalisation, shaped like application log records."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id")
    response = k % 2 == 0
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("created"),
        F.when(response, "uvicorn.access").when(k % 5 == 1, "urllib3.connectionpool").otherwise("app").alias("name"),
        F.col("props").alias("message"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.lit("wrapper").alias("func_name"),
        F.lit("decorators").alias("module"),
        F.when(k % 3 == 0, F.concat(F.lit("handle_"), F.col("event_type"))).alias("func_name_override"),
        F.when(k % 4 == 0, F.lit("api.nlp")).alias("module_override"),
        F.lit(None).cast("string").alias("log_type"),
        F.when(response, F.when(F.col("event_type") == "error", "500 Internal Server Error").otherwise("200 OK")).alias("status_code"),
        F.when(
            response,
            F.struct(
                F.when(k % 4 == 0, "POST").otherwise("GET").alias("method"),
                F.array(F.lit("10.0.0.1"), F.lit("8080")).alias("server"),
                F.array(F.concat(F.lit("10.1.0."), (k % 250).cast("string")), (40000 + k % 1000).cast("string")).alias("client"),
                F.when(k % 11 == 0, "/health")
                .when(k % 3 == 0, F.concat(F.lit("/projects/p"), (F.col("user_id") % 5).cast("string"), F.lit("/sessions/s"), F.col("user_id").cast("string")))
                .otherwise("/nlp/query")
                .alias("path"),
                F.when(
                    k % 7 != 0,
                    F.concat(F.lit("user_id=u"), F.col("user_id").cast("string"), F.lit("&project_id=q"), (k % 4).cast("string"), F.lit("&kb_id=")),
                ).alias("query_string"),
                F.when(k % 6 == 0, F.concat(F.lit("req-"), k.cast("string"))).alias("request_id"),
                (F.col("value") * 10).cast("long").alias("elapsed_us"),
            ),
        ).alias("scope"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Traceback "), F.col("props"))).alias("exc_text"),
        (k % 400).alias("lineno"),
    )


RAW_LOGS_SQL = """raw AS (
  SELECT event_id, user_id, ts AS created, event_type, props, event_id % 2 = 0 AS response,
         CASE WHEN event_id % 2 = 0 THEN 'uvicorn.access' WHEN event_id % 5 = 1 THEN 'urllib3.connectionpool' ELSE 'app' END AS name,
         CASE WHEN event_id % 3 = 0 THEN 'handle_' || event_type ELSE 'wrapper' END AS func_name,
         CASE WHEN event_id % 4 = 0 THEN 'api.nlp' ELSE 'decorators' END AS module,
         CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_type = 'error' THEN 500 ELSE 200 END END AS status_code,
         CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 4 = 0 THEN 'POST' ELSE 'GET' END END AS method,
         CASE WHEN event_id % 2 = 0 THEN '10.1.0.' || (event_id % 250) || ':' || (40000 + event_id % 1000) END AS client,
         CASE WHEN event_id % 2 = 0 THEN CASE WHEN event_id % 11 = 0 THEN '/health'
              WHEN event_id % 3 = 0 THEN '/projects/p' || (user_id % 5) || '/sessions/s' || user_id ELSE '/nlp/query' END END AS path,
         CASE WHEN event_id % 2 = 0 AND event_id % 7 != 0 THEN 'user_id=u' || user_id || '&project_id=q' || (event_id % 4) || '&kb_id=' END AS query_string,
         CASE WHEN event_id % 2 = 0 AND event_id % 6 = 0 THEN 'req-' || event_id END AS request_id,
         CASE WHEN event_id % 2 = 0 THEN CAST(trunc(value * 10) AS BIGINT) END AS elapsed_us
  FROM events)"""


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog projects, one per nation."""
    k = F.col("n_nationkey")
    return load(spark, sf_dir, "nation").select(
        F.concat(F.lit("p"), k.cast("string")).alias("_id"),
        F.concat(F.lit("author"), (k % 4).cast("string")).alias("author"),
        F.concat(F.lit("Project "), F.col("n_name")).alias("name"),
        F.when(k % 4 == 0, "cs").when(k % 4 == 1, "en-US").when(k % 4 == 2, "cs-CZ").otherwise("bad").alias("language"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(k.cast("int"))).alias("created_at"),
        F.lit(None).cast("timestamp").alias("modified_at"),
        (2 + k % 3).alias("model_version"),
    )


PROJECTS_SQL = """projects AS (
  SELECT 'p' || n_nationkey AS _id, 'author' || (n_nationkey % 4) AS author, 'Project ' || n_name AS name,
         CASE n_nationkey % 4 WHEN 0 THEN 'cs' WHEN 1 THEN 'en-US' WHEN 2 THEN 'cs-CZ' ELSE 'bad' END AS language,
         TIMESTAMP '2024-01-01' + to_days(CAST(n_nationkey AS INTEGER)) AS created_at, CAST(NULL AS TIMESTAMP) AS modified_at,
         2 + n_nationkey % 3 AS model_version
  FROM nation)"""


def knowledge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries, one per part; two of the 27 project values do not exist."""
    k = F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        F.concat(F.lit("kb"), k.cast("string")).alias("_id"),
        F.concat(F.lit("p"), (k % 27).cast("string")).alias("project_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("description"),
        F.when(k % 3 == 0, "cs").when(k % 3 == 1, "en-US").alias("language"),
        F.col("p_size").cast("long").alias("total_pages"),
        F.concat(F.lit("files/"), F.col("p_brand"), F.lit("/"), k.cast("string"), F.lit(".pdf")).alias("source_file"),
        F.when(k % 5 == 0, "html").otherwise("pdf").alias("source_type"),
        F.col("p_retailprice").alias("price"),
        (1 + k % 2).alias("model_version"),
    )


KB_SQL = """kb AS (
  SELECT 'kb' || p_partkey AS _id, 'p' || (p_partkey % 27) AS project_id, p_name AS name, p_type AS description,
         CASE p_partkey % 3 WHEN 0 THEN 'cs' WHEN 1 THEN 'en-US' END AS language, CAST(p_size AS BIGINT) AS total_pages,
         'files/' || p_brand || '/' || p_partkey || '.pdf' AS source_file,
         CASE WHEN p_partkey % 5 = 0 THEN 'html' ELSE 'pdf' END AS source_type, p_retailprice AS price, 1 + p_partkey % 2 AS model_version
  FROM part)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog sessions, one per order."""
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), k.cast("string")).alias("_id"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 26).cast("string")).alias("project_id"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).when(k % 3 == 1, "").alias("first_user_query"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (1 + k % 2).alias("model_version"),
    )


SESSIONS_SQL = """sessions AS (
  SELECT 's' || o_orderkey AS _id, 'p' || (o_custkey % 26) AS project_id, 'u' || o_custkey AS user_id,
         CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority WHEN 1 THEN '' END AS first_user_query, o_orderdate AS created_at,
         1 + o_orderkey % 2 AS model_version
  FROM orders)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog turns, one per order line; the matched page is the quantity."""
    return load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("t"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("bigint").cast("string"))).alias("_id"),
        F.concat(F.lit("s"), F.col("l_orderkey").cast("string")).alias("session_id"),
        F.concat(F.lit("kb"), F.col("l_partkey").cast("string")).alias("kb_id"),
        F.when(F.col("l_linenumber") % 4 == 1, "").otherwise(F.concat(F.lit("q"), F.col("l_partkey").cast("string"))).alias("user_query"),
        F.col("l_quantity").cast("long").alias("page"),
        F.col("l_linenumber").cast("long").alias("rank"),
        F.col("l_orderkey"),
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(secs=F.col("l_linenumber").cast("decimal(18,6)"))).alias("created_at"),
    )


TURNS_SQL = """turns AS (
  SELECT 't' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS BIGINT)) AS _id, 's' || l_orderkey AS session_id, 'kb' || l_partkey AS kb_id,
         CASE WHEN l_linenumber % 4 = 1 THEN '' ELSE 'q' || l_partkey END AS user_query, CAST(trunc(l_quantity) AS BIGINT) AS page,
         CAST(l_linenumber AS BIGINT) AS rank, l_orderkey, l_shipdate + to_seconds(l_linenumber) AS created_at
  FROM lineitem)"""
