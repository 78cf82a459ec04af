"""Catalog tables: listing, enrichment, merges, deletes, migrations and integrity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import CONTEXT_TURNS


# --- listing -------------------------------------------------------------------------------------------------


def sort_columns(order: str | None, id_col: str = "_id") -> list[Column]:
    """``field`` or ``-field`` with the id as tie break; missing values are the smallest."""
    if not order:
        return [F.col(id_col).asc()]
    name = order.lstrip("-")
    first = F.col(name).desc_nulls_last() if order.startswith("-") else F.col(name).asc_nulls_first()
    return [first] if name == id_col else [first, F.col(id_col).asc()]


def list_page(df: DataFrame, order: str | None, page_no: int = 1, per_page: int = 0, id_col: str = "_id") -> DataFrame:
    """One page of a sorted listing with the total; ``per_page=0`` lists everything."""
    total = df.groupBy().agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(*sort_columns(order, id_col))
    if per_page > 0:
        page = page.offset(per_page * (page_no - 1)).limit(per_page)
    return page.withColumns({"total": total.scalar(), "page_no": F.lit(page_no), "per_page": F.lit(per_page)})


# --- lookups -------------------------------------------------------------------------------------------------

CATALOG_FIELDS = ("name", "description", "source_file", "source_type")


def enrich_hits(hits: DataFrame, catalog: DataFrame, fields: tuple[str, ...] = CATALOG_FIELDS) -> DataFrame:
    """Catalog fields for every hit, order column and duplicates kept; catalog values replace those of the hit."""
    looked_up = catalog.select(F.col("_id").alias("kb_id"), *fields)
    kept = hits.drop(*[c for c in fields if c in hits.columns])
    return kept.join(looked_up, "kb_id", "left")


def missing_keys(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    return hits.select("kb_id").distinct().join(catalog.select(F.col("_id").alias("kb_id")), "kb_id", "left_anti")


def zip_pairs(df: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Two parallel arrays as one array of pairs."""
    return df.withColumn(out, F.arrays_zip(left, right)).drop(left, right)


def first_existing(candidates: DataFrame, existing: DataFrame, key: str = "request_id") -> DataFrame:
    """Per request the path with the smallest priority among those that exist."""
    return (
        candidates.join(existing.select("path").distinct(), "path", "left_semi")
        .groupBy(key)
        .agg(F.min_by("path", "priority").alias("path"), F.min("priority").alias("priority"))
    )


# --- integrity -----------------------------------------------------------------------------------------------


def orphan_report(
    projects: DataFrame,
    kb: DataFrame,
    sessions: DataFrame,
    turns: DataFrame,
    resources: DataFrame,
    index: DataFrame,
) -> DataFrame:
    """Rows of unknown projects, index entries absent from the catalog, and projects without entries."""
    known = projects.select(F.col("_id").alias("project_id"))

    def unknown(rows: DataFrame, what: str) -> DataFrame:
        return rows.join(known, "project_id", "left_anti").select(
            F.lit(what).alias("kind"), "project_id", F.col("_id").alias("object_id")
        )

    index_projects = index.select("project_id").distinct()
    index_kb = index.select("project_id", "kb_id").distinct()
    parts = [
        unknown(kb, "kb_without_project"),
        unknown(sessions, "session_without_project"),
        unknown(turns, "turn_without_project"),
        unknown(resources, "resource_without_project"),
        index_projects.join(known, "project_id", "left_anti").select(
            F.lit("index_project_unknown").alias("kind"), "project_id", F.lit("").alias("object_id")
        ),
        index_kb.join(kb.select(F.col("_id").alias("kb_id")), "kb_id", "left_anti").select(
            F.lit("index_kb_unknown").alias("kind"), "project_id", F.col("kb_id").alias("object_id")
        ),
        known.join(kb.select("project_id").distinct(), "project_id", "left_anti").select(
            F.lit("project_without_kb").alias("kind"), "project_id", F.lit("").alias("object_id")
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def project_of_path(path: Column) -> Column:
    """Project id of a stored path ``<prefix>/projects/<project>/...``."""
    parts = F.split(path, "/")
    return F.when(F.get(parts, F.lit(1)) == "projects", F.get(parts, F.lit(2)))


def id_counts(rows: DataFrame) -> DataFrame:
    """Distinct ids per project (a set per project as a table, so no group is collected)."""
    return rows.select("project_id", "_id").distinct()


# --- writes --------------------------------------------------------------------------------------------------


def insert_absent(target: DataFrame, incoming: DataFrame, order: Column, key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Rows whose key is new (the first of equal incoming keys) and the conflicting rest."""
    ranked = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    fresh = ranked.where(F.col("_n") == 1).drop("_n").join(target.select(key), key, "left_anti")
    known = ranked.join(target.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    conflicts = known.where(F.col("_known").isNotNull() | (F.col("_n") > 1)).drop("_n", "_known")
    return fresh, conflicts


def merge_update(target: DataFrame, updates: DataFrame, fields: list[str], key: str = "_id") -> tuple[DataFrame, DataFrame]:
    """Write only the fields named in ``updates._set``; return the merged table and the unmatched updates.

    Of several updates with the same key the latest ``_version`` wins.
    """
    latest = updates.groupBy(key).agg(F.max_by(F.struct(*fields, "_set"), "_version").alias("_u"))
    joined = target.join(latest, key, "left")
    written = {f: F.when(F.array_contains("_u._set", f), F.col(f"_u.{f}")).otherwise(F.col(f)) for f in fields}
    merged = joined.withColumns({**written, "_updated": F.col("_u").isNotNull()}).drop("_u")
    return merged, latest.select(key).join(target.select(key), key, "left_anti")


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Remaining rows and deleted rows for a set of keys."""
    wanted = keys.select(*on).distinct()
    return table.join(wanted, on, "left_anti"), table.join(wanted, on, "left_semi")


def cascade_delete(
    doomed: DataFrame,
    projects: DataFrame,
    kb: DataFrame,
    chunks: DataFrame,
    sessions: DataFrame,
    turns: DataFrame,
    blobs: DataFrame,
    delete_sessions: bool = True,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete projects with everything below them; return the remaining tables and counts per project."""
    key = doomed.select("project_id").distinct()
    remaining, gone = {}, []
    by_project = projects.withColumn("project_id", F.col("_id"))
    remaining["projects"], deleted = delete_keys(by_project, key, ["project_id"])
    gone.append(deleted.select("project_id", F.lit("projects").alias("what")))
    for name, table in (("kb", kb), ("chunks", chunks), ("blobs", blobs)):
        remaining[name], deleted = delete_keys(table, key, ["project_id"])
        gone.append(deleted.select("project_id", F.lit(name).alias("what")))
    if delete_sessions:
        remaining["sessions"], deleted = delete_keys(sessions, key, ["project_id"])
        gone.append(deleted.select("project_id", F.lit("sessions").alias("what")))
        dead = deleted.select(F.col("_id").alias("session_id"), "project_id")
        remaining["turns"] = turns.join(dead.select("session_id"), "session_id", "left_anti")
        gone.append(turns.select("session_id").join(dead, "session_id").select("project_id", F.lit("turns").alias("what")))
    else:
        remaining["sessions"], remaining["turns"] = sessions, turns
    rows = gone[0]
    for part in gone[1:]:
        rows = rows.unionByName(part)
    counts = rows.groupBy("project_id").agg(
        *[F.count_if(F.col("what") == w).alias(f"deleted_{w}") for w in ("projects", "kb", "chunks", "blobs", "sessions", "turns")]
    )
    return remaining, counts


def cascade(doomed: DataFrame, key: str, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete what belongs to some keys from tables that all carry the key: sessions with their turns, entries with their chunks and files.

    Returns the remaining tables and, for every key that had anything, how much of each table was deleted.
    """
    keys = doomed.select(key).distinct()
    remaining, gone = {}, None
    for name, table in tables.items():
        remaining[name], deleted = delete_keys(table, keys, [key])
        part = deleted.select(key, F.lit(name).alias("what"))
        gone = part if gone is None else gone.unionByName(part)
    return remaining, gone.groupBy(key).agg(*[F.count_if(F.col("what") == n).alias(f"deleted_{n}") for n in tables])


def total_deleted(counts: DataFrame) -> DataFrame:
    """Counters of a bulk delete summed into one row."""
    names = [c for c in counts.columns if c.startswith("deleted_")]
    return counts.groupBy().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def update_metadata(chunks: DataFrame, updates: DataFrame, struct_fields: list[str], on: list[str]) -> DataFrame:
    """Set metadata fields by dotted key. ``updates``: the key columns, ``path``, ``value`` and ``_version``.

    Paths below ``custom.`` write into the custom map, other paths into the named struct field.
    """
    latest = updates.groupBy(*on, "path").agg(F.max_by(F.struct("value"), "_version").alias("v"))
    patch = latest.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("path", "v.value"))).alias("_patch"))
    joined = chunks.join(patch, on, "left")
    meta = F.col("metadata")
    for name in struct_fields:
        new = F.when(F.map_contains_key("_patch", name), F.element_at("_patch", name)).otherwise(F.col(f"metadata.{name}"))
        meta = meta.withField(name, F.when(F.col("_patch").isNull(), F.col(f"metadata.{name}")).otherwise(new))
    custom = F.map_filter("_patch", lambda k, v: k.startswith("custom."))
    custom = F.transform_keys(custom, lambda k, v: F.substring(k, F.lit(len("custom.") + 1), F.length(k)))
    keep = F.map_filter("metadata.custom", lambda k, v: ~F.map_contains_key(custom, k))
    meta = meta.withField("custom", F.when(F.col("_patch").isNull(), F.col("metadata.custom")).otherwise(F.map_concat(keep, custom)))
    return joined.withColumn("metadata", meta).drop("_patch")


# --- migrations ----------------------------------------------------------------------------------------------

# Versions of the entries and the two language codes of old ones (fixed values).
VERSIONS = {"kb": 2, "projects": 4, "sessions": 3, "turns": 2}


def stamp_version(rows: DataFrame, version: int) -> DataFrame:
    """Mark old rows and bring them to a version that changes no field; sessions and turns need no more."""
    old = F.col("model_version") < version
    return rows.withColumns({"migrated": old, "model_version": F.when(old, version).otherwise(F.col("model_version"))})


def migrate_sessions(sessions: DataFrame, version: int = VERSIONS["sessions"]) -> DataFrame:
    return stamp_version(sessions, version)


def migrate_turns(turns: DataFrame, version: int = VERSIONS["turns"]) -> DataFrame:
    return stamp_version(turns, version)


def migrate_kb(kb: DataFrame, version: int = VERSIONS["kb"]) -> DataFrame:
    """Normalise the language of old entries and stamp the version."""
    old = F.col("model_version") < version
    language = F.when(F.col("model_version") < 2, F.when(F.col("language") == "cs", "cs-CZ").otherwise("en-US")).otherwise(F.col("language"))
    return kb.withColumns({"language": language, "migrated": old, "model_version": F.when(old, version).otherwise(F.col("model_version"))})


def migrate_projects(projects: DataFrame, version: int = VERSIONS["projects"]) -> DataFrame:
    old = F.col("model_version") < version
    return projects.withColumns(
        {
            "modified_at": F.when(F.col("model_version") < 4, F.col("created_at")).otherwise(F.col("modified_at")),
            "migrated": old,
            "model_version": F.when(old, version).otherwise(F.col("model_version")),
        }
    )


def earliest_query(turns: DataFrame) -> DataFrame:
    """Query of the earliest turn per session; a session whose earliest query is empty is skipped."""
    first = turns.groupBy("session_id").agg(F.min_by("user_query", F.struct("created_at", "_id")).alias("first_query"))
    return first.where(F.coalesce(F.col("first_query"), F.lit("")) != "")


def backfill_first_query(sessions: DataFrame, turns: DataFrame, before_version: int = 3) -> DataFrame:
    """Fill a missing first query of old sessions from their earliest turn."""
    first = earliest_query(turns).withColumnRenamed("session_id", "_id")
    eligible = (F.col("model_version") < before_version) & (F.coalesce(F.col("first_user_query"), F.lit("")) == "")
    return (
        sessions.join(first, "_id", "left")
        .withColumn("first_user_query", F.when(eligible, F.coalesce("first_query", "first_user_query")).otherwise(F.col("first_user_query")))
        .drop("first_query")
    )


def touch(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """``modified_at`` becomes the time of the latest change of any child."""
    last = changes.groupBy("project_id").agg(F.max("changed_at").alias("_changed")).withColumnRenamed("project_id", "_id")
    return projects.join(last, "_id", "left").withColumn("modified_at", F.coalesce("_changed", "modified_at")).drop("_changed")


# --- conversations -------------------------------------------------------------------------------------------


def context_window(turns: DataFrame, n: int = CONTEXT_TURNS, mode: str = "latest", order=("created_at", "_id")) -> DataFrame:
    """``n`` turns of every session in time order; ``n=0`` keeps all.

    ``latest`` keeps the newest turns, ``first`` the oldest ones. Ranks are pruned below the shuffle, so a
    session with very many turns sends only ``n`` rows per task.
    """
    if n > 0:
        keys = [F.col(c).desc() if mode == "latest" else F.col(c).asc() for c in order]
        turns = turns.withColumn("_rn", F.row_number().over(Window.partitionBy("session_id").orderBy(*keys))).where(F.col("_rn") <= n).drop("_rn")
    return turns


def history_messages(window: DataFrame, order=("created_at", "_id")) -> DataFrame:
    """Messages of the windowed turns: user and assistant text, blank ones skipped, in order."""
    def message(role: str, column: str) -> Column:
        text = F.trim(F.coalesce(F.col(column), F.lit("")))
        return F.when(text != "", F.struct(F.lit(role).alias("role"), text.alias("content")))

    pair = F.array_compact(F.array(message("user", "user_query"), message("assistant", "system_response")))
    ordered = F.sort_array(F.collect_list(F.struct(*order, pair.alias("pair"))))
    return window.groupBy("session_id").agg(F.flatten(F.transform(ordered, lambda x: x["pair"])).alias("history"))
