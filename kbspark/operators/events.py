"""Session, user, feedback and error statistics over the event log.

Every report is one conditional aggregation on its key, so the log is scanned and shuffled once and only
partial counts cross the network; a project that owns most of the log is combined before the shuffle.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import TIMELINE_SHIFT_HOURS


def day_bounds(start_date: str, end_date: str) -> tuple[Column, Column]:
    """Start of the first day and the last microsecond of the last day (UTC)."""
    start = F.lit(start_date).cast("timestamp")
    end = F.lit(f"{end_date} 23:59:59.999999").cast("timestamp")
    return start, end


def in_range(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Half-open time range ``start <= ts < end``."""
    start = F.lit(start) if not isinstance(start, Column) else start
    end = F.lit(end) if not isinstance(end, Column) else end
    return df.where((F.col(ts) >= start.cast("timestamp")) & (F.col(ts) < end.cast("timestamp")))


def is_start() -> Column:
    return F.col("func_name") == "start_session"


def is_query() -> Column:
    return F.col("message") == "query"


def is_feedback() -> Column:
    return F.col("message") == "user_feedback"


def metric_columns() -> list[Column]:
    """Counts of queries and feedback; null-safe so an empty group counts zero."""
    return [
        F.count_if(is_query()).alias("queries"),
        F.count_if(is_feedback()).alias("feedbacks"),
        F.count_if(is_feedback() & (F.col("feedback") == 1)).alias("positive"),
        F.count_if(is_feedback() & (F.col("feedback") == -1)).alias("negative"),
    ]


def feedback_percentage(part: str, positive: str = "positive", negative: str = "negative") -> Column:
    """Share of ``part`` among rated answers in percent, two digits; 0 when nothing was rated."""
    total = F.col(positive) + F.col(negative)
    return F.when(total > 0, F.round(F.col(part) * 100.0 / total, 2)).otherwise(F.lit(0.0))


def session_report(logs: DataFrame, start=None, end=None) -> DataFrame:
    """Started sessions with their query and feedback counts, in one pass over the log.

    Sessions that only have metrics are dropped, sessions without metrics count zero, because start and
    counts come from the same group.
    """
    if start is not None:
        logs = in_range(logs, start, end)
    grouped = logs.groupBy("project_id", "session_id").agg(
        F.min(F.when(is_start(), F.col("ts"))).alias("started_at"), *metric_columns()
    )
    return grouped.where(F.col("started_at").isNotNull()).select(
        "*",
        feedback_percentage("positive").alias("positive_pct"),
        feedback_percentage("negative").alias("negative_pct"),
    )


def project_summary(logs: DataFrame, approximate: bool = False, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Sessions that asked something, queries and feedback per project.

    Sessions are counted where the field ``query`` exists, queries by their message.
    """
    asked = F.when(F.col("query").isNotNull(), F.col("session_id"))
    sessions = F.approx_count_distinct(asked, 0.01) if approximate else F.count_distinct(asked)
    return logs.groupBy(*keys).agg(sessions.alias("sessions"), *metric_columns())


def unique_users(logs: DataFrame, approximate: bool = False) -> DataFrame:
    users = F.approx_count_distinct("user_id", 0.01) if approximate else F.count_distinct("user_id")
    return logs.groupBy("project_id").agg(users.alias("users"))


def _months_back(day: datetime, months: int) -> datetime:
    index = day.year * 12 + day.month - 1 - months
    return day.replace(year=index // 12, month=index % 12 + 1)


def segment_bounds(time_range: str, now: datetime) -> list[datetime]:
    """Boundaries of the time segments of a period that ends at ``now`` (at most 14 values)."""
    fixed = {
        "hour": (timedelta(hours=1), 1),
        "day": (timedelta(hours=2), 12),
        "week": (timedelta(days=1), 7),
        "month": (timedelta(weeks=1), 4),
    }
    if time_range in fixed:
        step, n = fixed[time_range]
        return [now - step * (n - i) for i in range(n + 1)]
    if time_range != "all":
        raise ValueError(f"unknown time range {time_range!r}")
    first = now.replace(day=1)
    months = [_months_back(first, m) for m in range(12, -1, -1)]
    return months + ([now] if months[-1] < now else [])


def segment_index(bounds: list[datetime], ts: Column) -> Column:
    """0-based segment of a timestamp, null outside the period. A ladder over literals, no join."""
    ladder = F.lit(None).cast("int")
    for i in range(len(bounds) - 2, -1, -1):
        inside = (ts >= F.lit(bounds[i]).cast("timestamp")) & (ts < F.lit(bounds[i + 1]).cast("timestamp"))
        ladder = F.when(inside, F.lit(i)).otherwise(ladder)
    return ladder


def segment_summary(logs: DataFrame, time_range: str, now: datetime) -> DataFrame:
    """Project summary per time segment; segments without events stay with zeros."""
    bounds = segment_bounds(time_range, now)
    projects = logs.select("project_id").distinct()
    frame = projects.select(
        "project_id",
        F.posexplode(
            F.array(*[F.struct(F.lit(a).cast("timestamp").alias("start"), F.lit(b).cast("timestamp").alias("end")) for a, b in zip(bounds, bounds[1:])])
        ).alias("segment", "range"),
    ).select("project_id", "segment", "range.start", "range.end")
    inside = in_range(logs, bounds[0], bounds[-1]).withColumn("segment", segment_index(bounds, F.col("ts")))
    stats = project_summary(inside, keys=("project_id", "segment"))
    counts = ["sessions", "queries", "feedbacks", "positive", "negative"]
    return frame.join(stats, ["project_id", "segment"], "left").select(
        "project_id", "segment", "start", "end", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts]
    )


def latest_logs(logs: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` rows with the total number of matches."""
    total = logs.groupBy().agg(F.count(F.lit(1)).alias("total"))
    return logs.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n).withColumn("total", total.scalar())


def error_counts(logs: DataFrame, limit: int | None = None) -> DataFrame:
    """Error events per session; with a limit, the sessions of each project that have most."""
    counted = logs.where(F.col("logs").isNotNull()).groupBy("project_id", "session_id").agg(F.count(F.lit(1)).alias("errors"))
    if limit is None:
        return counted
    most = Window.partitionBy("project_id").orderBy(F.col("errors").desc(), "session_id")
    return counted.withColumn("_n", F.row_number().over(most)).where(F.col("_n") <= limit).drop("_n")


TIMELINE_MESSAGES = ("start_session", "query", "answer", "user_feedback")


def timeline_message(strict: bool = False) -> Column:
    """Message that decides the payload; the session start is recognised by its function unless ``strict``."""
    if strict:
        return F.col("message")
    return F.when(is_start(), F.lit("start_session")).otherwise(F.col("message"))


def event_payload(message: Column) -> Column:
    """Payload by message type as a struct with only the fields of that type filled."""
    return F.struct(
        F.when(message == "start_session", F.col("component_id")).alias("component_id"),
        F.when(message == "start_session", F.col("user_id")).alias("user_id"),
        F.when(message == "query", F.col("query")).alias("query"),
        F.when(message == "answer", F.col("answer")).alias("answer"),
        F.when(message == "user_feedback", F.col("feedback")).alias("feedback"),
    )


def in_time_order(rows: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows numbered from 1 in each session by time, in column ``seq``; with a cap, only the first ones.

    A cap is pushed below the shuffle as a window group limit. Without one, a session may hold any number of events, so the hours of a session
    are numbered apart and each starts where those before it end; the counts are one row per session and hour.
    """
    keys = ["project_id", "session_id"]
    if cap is not None:
        seq = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
        return rows.withColumn("seq", seq).where(F.col("seq") <= cap)
    rows = rows.withColumn("_hour", F.date_trunc("hour", "ts"))
    counts = rows.groupBy(*keys, "_hour").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_hour").orderBy("ts", "event_id")))
    same = [own[c].eqNullSafe(starts[c]) for c in (*keys, "_hour")]
    joined = own.join(starts, same[0] & same[1] & same[2])
    return joined.select(*[own[c] for c in rows.columns if c != "_hour"], (own["_own"] + starts["_before"]).alias("seq"))


def session_timeline(logs: DataFrame, cap: int | None = None, strict: bool = False) -> DataFrame:
    """Events of every session in time order with their payload."""
    rows = logs.withColumn("kind", timeline_message(strict)).where(F.col("kind").isin(*TIMELINE_MESSAGES))
    rows = in_time_order(rows, cap)
    shifted = F.col("ts") + F.make_dt_interval(hours=F.lit(TIMELINE_SHIFT_HOURS))
    return rows.select(
        "project_id",
        "session_id",
        F.col("seq").cast("long").alias("seq"),
        F.col("kind").alias("message"),
        iso_utc(shifted).alias("timestamp"),
        event_payload(F.col("kind")).alias("data"),
    )


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def error_timeline(logs: DataFrame, cap: int | None = None) -> DataFrame:
    """Client errors of every session; the time is the client's own and missing fields are empty strings."""
    rows = logs.where(F.col("logs").isNotNull())
    rows = in_time_order(rows, cap)
    text = [F.coalesce(F.col(f"logs.{c}"), F.lit("")).alias(c) for c in ("type", "level", "stack", "message")]
    return rows.select(
        "project_id", "session_id", F.col("seq").cast("long").alias("seq"), iso_utc(F.col("logs.timestamp")).alias("timestamp"), *text
    )
