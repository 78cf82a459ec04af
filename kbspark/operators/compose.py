"""The two whole jobs: files to a searchable store, and questions to everything an answer needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import CONTEXT_TURNS
from ..functions import text as tx
from ..sources.files import parse_files
from . import catalog, chunking, fusion, knn, store

STORE_KEYS = ["kb_id", "project_id"]
STORE_PARTITIONS = ["model_partition", "project_id"]


def corpus_chunks(files: DataFrame, entries: DataFrame, model: str = "hashed_bag") -> tuple[DataFrame, DataFrame]:
    """Chunks of all files with header, vector and metadata, and the files that gave none, with the reason.

    ``files``: path, text. ``entries``: path, kb_id, project_id and optionally language, source_type, custom, created_at. Files without an
    entry are left out.
    """
    documents, rejected = parse_files(files)
    general = entries.withColumns({"source_file": F.col("path"), "embedding_model": F.lit(model)})
    for name, kind in (("language", "string"), ("source_type", "string"), ("custom", "string"), ("created_at", "timestamp")):
        if name not in general.columns:
            general = general.withColumn(name, F.lit(None).cast(kind))
    # an entry with several files: the file is part of the chunk's id
    several = F.count(F.lit(1)).over(Window.partitionBy("kb_id")) > 1
    general = general.withColumn("of_file", F.when(several, tx.text_hash(F.col("path"))))
    own = documents.join(general.select("path", F.struct(*[c for c in general.columns if c != "path"]).alias("entry")), "path")
    headed = own.withColumn("text", tx.with_header(F.col("text"), F.col("path")))
    chunks = chunking.chunk_records(headed, F.col("page") - 1)
    entry = lambda c: F.col(f"entry.{c}")
    described = store.metadata_struct(F.col, entry, chunks.columns, general.columns).alias("metadata")
    place = [F.col("page").cast("string"), F.col("chunk_idx").cast("string")]
    rows = knn.embed(chunks, model).select(
        F.concat_ws("_", entry("kb_id"), entry("of_file"), *place).alias("_id"), entry("kb_id").alias("kb_id"), entry("project_id").alias("project_id"),
        "text", "vector", described, tx.partition_name(F.lit(model)).alias("model_partition"),
    )
    return rows, rejected


def ingest(files: DataFrame, entries: DataFrame, path: str, model: str = "hashed_bag") -> DataFrame:
    """Parse, chunk, embed and describe files, and put them in the store at ``path`` in place of what it has of their entries.

    Returns the rejected files.
    """
    chunks, rejected = corpus_chunks(files, entries, model)
    store.upsert(chunks, path, STORE_KEYS, STORE_PARTITIONS)
    return rejected


def answer_context(
    questions: DataFrame,
    turns: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    chunks: DataFrame,
    n_turns: int = CONTEXT_TURNS,
    rewrite: Callable[[Column, Column], Column] | None = None,
    template: str = tx.CONTEXT_TEMPLATE,
) -> tuple[DataFrame, DataFrame]:
    """What a model is asked for every question, and the hits behind it.

    ``questions``: query_id, session_id, text, language and what ``search`` needs (the ``by`` columns, a vector). The last turns of its session
    are the history of a question; with a history, ``rewrite`` (question, history) gives the text that is searched, null where it fails.
    ``search`` maps questions to (query_id, doc_id, rank). The first result has query_id, session_id, query, prompt and messages; a question
    without hits has an empty context. The second has a row per hit with the chunk's columns.
    """
    history = catalog.history_messages(catalog.context_window(turns, n_turns))
    none = F.array().cast(history.schema["history"].dataType)
    asked = questions.join(history, "session_id", "left").withColumn("history", F.coalesce("history", none))
    rewritten = rewrite(F.col("text"), F.col("history")) if rewrite else F.lit(None).cast("string")
    asked = asked.withColumns({"question": F.col("text"), "text": tx.rewritten_query(F.col("text"), F.col("history"), rewritten)})
    hits = search(asked.drop("history", "question")).select("query_id", "doc_id", "rank")
    shown = hits.join(chunks, "doc_id")
    context = fusion.context_text(shown, ["query_id"])
    whole = asked.join(context, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    message = lambda role, text: F.array(F.struct(F.lit(role).alias("role"), text.alias("content")))
    whole = whole.withColumn("prompt", tx.fill_template(template, F.col("context"), F.col("language")))
    messages = F.concat(message("system", F.col("prompt")), F.col("history"), message("user", F.col("text")))
    return whole.select("query_id", "session_id", F.col("text").alias("query"), "prompt", messages.alias("messages")), shown


def turn_records(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """A turn for every question that is answered by its hits alone: matched entries (each once) and pages in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "kb_id", "page")))
    matched = hits.groupBy("query_id").agg(ordered.alias("m"))
    ids = F.array_distinct(F.transform("m", lambda x: x["kb_id"]))
    rows = questions.join(matched, "query_id", "left")
    return rows.select(
        F.sha1(F.concat_ws("|", "session_id", "query_id")).alias("_id"), "session_id", "query_id", F.col("text").alias("user_query"),
        F.lit("").alias("system_response"), F.coalesce(ids, F.array().cast("array<string>")).alias("matched_kb_ids"),
        F.coalesce(F.transform("m", lambda x: x["page"]), F.array().cast("array<bigint>")).alias("matched_pages"),
    )
