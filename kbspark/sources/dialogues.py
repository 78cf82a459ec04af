"""Dialogue definitions: JSON documents to tables of states, buttons and alternate sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Command types a state may have (fixed values).
COMMAND_TYPES = ["buttons", "display_text", "get_text", "image", "get_rag", "get_top_n", "select_intent"]

SCHEMA = """dialogue_id bigint, dialogue_name string, dialogue_author string, dialogue_description string, language string,
editor_active boolean, editor_initial_file string, commands array<struct<name: string, state: int>>,
states array<struct<state_id: int, command: struct<type: string, text: string, link: string, next_state: int, streaming: boolean,
top_n_buttons_enabled: boolean, top_n_count: int, buttons: array<struct<class: string, text: string, next_state: int>>,
alternate_sentences: array<struct<sentences: array<string>, next_state: int>>>>>"""


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", "true").json(path)


def parse_dialogues(rows: DataFrame, column: str = "json") -> DataFrame:
    return rows.select(F.from_json(column, SCHEMA).alias("d")).select("d.*")


def states(dialogues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per state with its command, and the states whose command type nobody knows."""
    rows = dialogues.select("dialogue_id", F.inline("states")).select("dialogue_id", "state_id", "command.*")
    known = F.coalesce(F.col("type").isin(*COMMAND_TYPES), F.lit(False))
    return rows.where(known), rows.where(~known)


def buttons(states_table: DataFrame) -> DataFrame:
    return states_table.select("dialogue_id", "state_id", F.posexplode("buttons").alias("pos", "b")).select("dialogue_id", "state_id", "pos", "b.*")


def sentences(states_table: DataFrame) -> DataFrame:
    """Alternate sentences of every state with the state they lead to."""
    rows = states_table.select("dialogue_id", "state_id", F.inline("alternate_sentences"))
    return rows.select("dialogue_id", "state_id", "next_state", F.explode("sentences").alias("sentence"))


def find_states(requests: DataFrame, states_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State of every request (dialogue_id, state_id), and the requests whose state does not exist."""
    keys = ["dialogue_id", "state_id"]
    return requests.join(states_table, keys), requests.join(states_table.select(*keys), keys, "left_anti")


def initialise(states_table: DataFrame, updates: DataFrame) -> DataFrame:
    """Set state texts of a new project's dialogue.

    ``updates``: dialogue_id, image_url, image_state, message, message_state and optionally ``chatbot``, the look of the chat window, which
    takes the place of the dialogue's own and is given with each of its states. ``changed`` marks dialogues that differ from the default one;
    the others keep using it.
    """
    chatbot = "chatbot" in updates.columns
    look = updates.where(F.col("chatbot").isNotNull()).select("dialogue_id") if chatbot else None
    rows = states_table.join(updates, "dialogue_id", "left")
    ids = states_table.select("dialogue_id", "state_id")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    image = given("image_url") & (F.col("state_id") == F.col("image_state"))
    message = given("message") & (F.col("state_id") == F.col("message_state"))
    text = F.when(message, F.col("message")).when(image, F.col("image_url")).otherwise(F.col("text"))
    hit = updates.join(ids, "dialogue_id").where(image | message).select("dialogue_id")
    hit = (hit.unionByName(look) if chatbot else hit).distinct().withColumn("changed", F.lit(True))
    return (
        rows.withColumn("text", text)
        .drop("image_url", "image_state", "message", "message_state")
        .join(hit, "dialogue_id", "left")
        .withColumn("changed", F.coalesce("changed", F.lit(False)))
    )
