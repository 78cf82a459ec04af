"""Streamed answers: pieces of text to finished answers and conversation turns, batch and streaming."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MATCHES = "array<struct<kb_id: string, page: bigint>>"


def assemble(pieces: DataFrame) -> DataFrame:
    """Answers whose pieces are all there, from (response_id, session_id, chunk_index, is_last_chunk, text, matched).

    Pieces may come twice and in any order; a missing text counts as empty; matches come from the last piece.
    """
    once = pieces.groupBy("response_id", "chunk_index").agg(
        F.first("session_id", ignorenulls=True).alias("session_id"), F.bool_or("is_last_chunk").alias("is_last_chunk"),
        F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("matched", ignorenulls=True).alias("matched"),
    )
    done = once.groupBy("response_id").agg(
        F.first("session_id", ignorenulls=True).alias("session_id"),
        F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("parts"),
        F.max(F.when(F.col("is_last_chunk"), F.col("chunk_index"))).alias("last"),
        F.first(F.when(F.col("is_last_chunk"), F.col("matched")), ignorenulls=True).alias("matched"),
    )
    whole = done.where(F.col("last").isNotNull() & (F.size(F.filter("parts", lambda p: p["chunk_index"] <= F.col("last"))) == F.col("last") + 1))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["chunk_index"] <= F.col("last")), lambda p: p["text"]), "")
    return whole.select("response_id", "session_id", text.alias("text_full"), "matched")


_OUT = "response_id string, text_full string, others string"
_OTHERS = f"session_id string, matched {MATCHES}"  # in JSON
_STATE = "held string"  # JSON of the answers of a key: the pieces that wait for the rest, or the mark of a finished answer
_EMPTY = {"session": None, "parts": {}, "last": -1, "matched": [], "done": False, "latest": 0}
_FIELDS = ("response_id", "session_id", "chunk_index", "is_last_chunk", "text", "matched")
BUCKETS = 16_384


def _add(own: dict, piece: dict) -> None:
    """A piece to its answer; null fields of a piece are not there."""
    own["latest"] = max(own["latest"], piece.get("sent_ms", 0))
    number, text = str(piece.get("chunk_index")), piece.get("text", "")
    own["parts"][number] = min(own["parts"].get(number, text), text)  # as in the batch form
    own["session"] = own["session"] or piece.get("session_id")
    if piece.get("is_last_chunk") and "chunk_index" in piece:
        own["last"], own["matched"] = piece["chunk_index"], piece.get("matched", [])


def _collect(frames: Iterator[pd.DataFrame], state: GroupState, timeout_ms: int | None = None, event_time: bool = False) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut and not event_time:  # abandoned or long finished
        state.remove()
        return
    held = dict(json.loads(state.get[0])) if state.exists else {}
    watermark, met, finished = state.getCurrentWatermarkMs() if event_time else 0, set(), []
    for frame in () if state.hasTimedOut else frames:
        for piece in map(json.loads, frame["piece"]):
            response = piece.get("response_id")
            met.add(response)
            _add(held.setdefault(response, dict(_EMPTY, parts={})), piece)
    for response in met:
        own = held[response]
        last, parts = own["last"], own["parts"]
        if not own["done"] and last >= 0 and all(str(i) in parts for i in range(last + 1)):
            others = json.dumps({"session_id": own["session"], "matched": own["matched"]})
            finished.append((response, "".join(parts[str(i)] for i in range(last + 1)), others))
            own["done"] = True
        if own["done"]:  # a finished answer only keeps its mark, so that late copies do not emit it again
            own = held[response] = dict(_EMPTY, parts={}, done=True, latest=own["latest"])
        own["until"] = max(own["latest"] + (timeout_ms or 0), watermark + 1)
    if finished:
        yield pd.DataFrame(finished, columns=["response_id", "text_full", "others"])
    if event_time:
        held = {response: own for response, own in held.items() if own["until"] >= watermark}
        if not held:
            state.remove()
            return
    state.update((json.dumps(list(held.items())),))
    if event_time:
        state.setTimeoutTimestamp(max(min(own["until"] for own in held.values()), watermark + 1))
    elif timeout_ms:
        state.setTimeoutDuration(timeout_ms)


def assemble_stream(pieces: DataFrame, timeout_minutes: int | None = None, late_minutes: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Emit an answer once, as soon as its last missing piece is there.

    Without a timeout a mark of each finished answer stays for good. With ``late_minutes`` the pieces carry ``sent_at``: the state of an answer,
    finished or not, goes ``timeout_minutes`` after its latest piece by event time, once pieces that are ``late_minutes`` younger have come.
    Pieces older than that are dropped. This ends in a drained run too, since it does not wait for a clock. With a timeout alone, processing time
    counts; this suits a continuous run, because a drained run with a processing-time timeout never ends.

    Spark calls Python for every key of a micro-batch, at some milliseconds a key and column. So a piece travels as one JSON text, and where state
    ends by event time the answers share ``buckets`` keys; each answer still ends at its own time. A bucket holds the open answers of its share.
    """
    by_event = late_minutes is not None
    if by_event:
        pieces = pieces.withWatermark("sent_at", f"{late_minutes} minutes")
    timeout = GroupStateTimeout.EventTimeTimeout if by_event else GroupStateTimeout.ProcessingTimeTimeout if timeout_minutes else GroupStateTimeout.NoTimeout
    timeout_ms = (timeout_minutes or 0) * 60_000 or (1 if by_event else None)

    def collect(_, frames, state):
        return _collect(frames, state, timeout_ms, by_event)

    if by_event:
        key = F.pmod(F.xxhash64("response_id"), F.lit(buckets)).cast("int").alias("key")
        packed = pieces.select(key, "sent_at", F.to_json(F.struct(*_FIELDS, F.unix_millis("sent_at").alias("sent_ms"))).alias("piece"))
    else:
        packed = pieces.select(F.col("response_id").alias("key"), F.to_json(F.struct(*_FIELDS)).alias("piece"))
    answers = packed.groupBy("key").applyInPandasWithState(collect, _OUT, _STATE, "append", timeout)
    return answers.withColumn("others", F.from_json("others", _OTHERS)).select("response_id", "others.session_id", "text_full", "others.matched")


def turns(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Conversation turns of finished answers; answers outside a session give none."""
    rows = answers.where(F.col("session_id").isNotNull()).join(questions, "response_id")
    return rows.select(
        F.sha1(F.concat_ws("|", "session_id", "response_id")).alias("_id"), "session_id", "response_id", "user_query", F.col("text_full").alias("system_response"),
        F.transform("matched", lambda m: m["kb_id"]).alias("matched_kb_ids"), F.transform("matched", lambda m: m["page"]).alias("matched_pages"),
    )
