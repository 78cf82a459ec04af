"""Application log records to flat event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Headers that extra fields and scopes carry, and the names of their columns (fixed values).
HEADER_NAMES = {"x-correlation-id": "correlation_id", "x-request-id": "request_id", "x-response-time": "response_time"}
FORMAT_VERSION = "1"


def log_type() -> Column:
    """Access records and records that name a type are responses, client library records are requests."""
    named = F.coalesce(F.col("log_type"), F.lit("")) != ""
    return (
        F.when(F.col("name").contains("uvicorn.access") | named, "response")
        .when(F.col("name").contains("urllib3"), "request")
        .otherwise("log")
    )


def leading_int(text: Column) -> Column:
    """Integer before the first space."""
    return F.split(text, " ", 2)[0].cast("int")


def host_port(pair: Column) -> Column:
    return F.when(F.size(pair) == 2, F.concat_ws(":", pair[0], pair[1])).otherwise(pair.cast("string"))


def normalise_records(raw: DataFrame) -> DataFrame:
    """One flat row per record: overrides win, scope fields only for responses, exception fields only with one."""
    kind = log_type()
    response = kind == "response"
    scope = F.col("scope")
    failed = F.col("exc_text").isNotNull()
    return raw.select(
        "event_id",
        F.col("created").alias("ts"),
        "level",
        F.col("name").alias("logger_name"),
        F.coalesce("func_name_override", "func_name").alias("func_name"),
        F.coalesce("module_override", "module").alias("module"),
        kind.alias("log_type"),
        "message",
        F.when(response, leading_int(F.col("status_code"))).alias("status_code"),
        F.when(response, scope["method"]).alias("method"),
        F.when(response, host_port(scope["server"])).alias("server"),
        F.when(response, host_port(scope["client"])).alias("client"),
        F.when(response, scope["path"]).alias("path"),
        F.when(response, scope["query_string"]).alias("query_string"),
        F.when(response, scope["request_id"]).alias("request_id"),
        F.when(response, scope["elapsed_us"]).alias("elapsed_us"),
        F.when(failed, F.col("exc_text")).alias("exception"),
        F.when(failed, F.col("lineno")).alias("lineno"),
    )


def record_fields(raw: DataFrame, host: str, component: dict[str, str] | None = None, scope_attributes: tuple[str, ...] = ()) -> DataFrame:
    """What a record has beside :func:`normalise_records`: where it was written, the request's further fields and whatever the caller added.

    ``raw`` may have filename, process, thread_name, process_name (kept with an exception only), ``extra`` (map of added fields; headers get their
    column's name, and the later of two entries of one name wins) and, in its scope, path_params, request_url, ``headers`` (map) and
    ``attributes`` (map), of which ``scope_attributes`` with a value are kept. ``component`` are fields of the whole application. Missing columns
    are null.
    """
    kind, failed = log_type(), F.col("exc_text").isNotNull()
    response = kind == "response"
    inner = {f.name for f in raw.schema["scope"].dataType.fields}

    def own(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in raw.columns else F.lit(None).cast(kind)

    def scoped(name: str, kind: str = "string") -> Column:
        return F.when(response, F.col(f"scope.{name}").cast(kind)) if name in inner else F.lit(None).cast(kind)

    no_map = F.create_map().cast("map<string,string>")
    extra = F.coalesce(own("extra", "map<string,string>"), no_map)
    renamed = F.transform_keys(extra, lambda k, _: F.coalesce(F.element_at(_names(), k), k))
    headers = F.coalesce(scoped("headers", "map<string,string>"), no_map)
    header = lambda name: F.when(response, F.coalesce(F.element_at(headers, name), F.lit("")))
    named = [header(name).alias(column) for name, column in HEADER_NAMES.items()]
    attributes = F.coalesce(scoped("attributes", "map<string,string>"), no_map)
    kept = F.map_filter(attributes, lambda k, v: k.isin(*scope_attributes) & (F.coalesce(v, F.lit("")) != "")) if scope_attributes else no_map
    return raw.select(
        "event_id", F.lit(FORMAT_VERSION).alias("version"), F.lit(host).alias("host"), own("filename").alias("filename"),
        *[F.lit(v).alias(k) for k, v in (component or {}).items()],
        scoped("path_params").alias("path_params"), scoped("request_url").alias("request_url"), *named,
        *[F.when(failed, own(c, t)).alias(c) for c, t in (("process", "bigint"), ("thread_name", "string"), ("process_name", "string"))],
        F.map_concat(F.map_filter(kept, lambda k, _: ~F.map_contains_key(renamed, k)), renamed).alias("fields"),
    )


def _names() -> Column:
    return F.create_map(*[F.lit(x) for pair in HEADER_NAMES.items() for x in pair])


def drop_health_checks(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce(F.col("path"), F.lit("")) != "/health")


PATH_PARAMETERS = {"project_id": "projects", "session_id": "sessions", "kb_id": "knowledge_base", "user_id": "users"}


def request_context(records: DataFrame) -> DataFrame:
    """Ids of a request from its path and query string (the path wins) and a request id that is never empty."""
    params = F.str_to_map(F.coalesce(F.col("query_string"), F.lit("")), F.lit("&"), F.lit("="))
    out = records.withColumn("_params", params)
    ids = []
    for name, segment in PATH_PARAMETERS.items():
        from_path = F.regexp_extract(F.coalesce(F.col("path"), F.lit("")), rf"/{segment}/([^/]+)", 1)
        from_query = F.element_at(F.col("_params"), name)
        ids.append(F.coalesce(F.nullif(from_path, F.lit("")), F.nullif(from_query, F.lit(""))).alias(name))
    generated = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256)
    return out.select(
        "*",
        *ids,
        F.coalesce(F.nullif(F.col("request_id"), F.lit("")), F.substring(generated, 1, 32)).alias("correlation_id"),
        F.round(F.col("elapsed_us") / 1000.0, 3).alias("response_ms"),
    ).drop("_params")
