"""Dialogue definitions built from the conversations: one dialogue per conversation, one state per message."""

from pyspark.sql import Window, functions as F

from ..sources import dialogues as dl
from ..sources.tables import load
from .registry import query


def _json(spark, sf):
    c = load(spark, sf, "conversations")
    w = Window.partitionBy("conv_id")
    n = F.max("turn").over(w)
    turn = F.col("turn").cast("int")
    follow = F.when(F.col("turn") < n, turn + 1)
    kind = (
        F.when(F.col("role") == "assistant", F.when(F.col("turn") % 5 == 3, "buttons").otherwise("display_text"))
        .when(F.col("role") == "user", "get_text").otherwise("get_projects")
    )
    button = F.array(
        F.struct(F.lit("primary").alias("class"), F.col("text").alias("text"), follow.alias("next_state")),
        F.struct(F.lit("plain").alias("class"), F.lit("again").alias("text"), F.lit(0).alias("next_state")),
    )
    command = F.struct(
        kind.alias("type"), F.col("text").alias("text"), follow.alias("next_state"), (F.col("turn") % 2 == 0).alias("streaming"),
        F.when(kind == "buttons", button).alias("buttons"),
        F.when(kind == "get_text", F.array(F.struct(F.split("text", r"\.\s*").alias("sentences"), F.lit(0).alias("next_state")))).alias("alternate_sentences"),
        F.lit("dropped").alias("unknown"),
    )
    state = F.struct(turn.alias("state_id"), command.alias("command"))
    rows = c.select("conv_id", state.alias("state"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("state")).alias("states")).select(
        F.to_json(F.struct(F.col("conv_id").alias("dialogue_id"), F.lit("d").alias("dialogue_name"), "states")).alias("json")
    )


KIND_SQL = "CASE WHEN role = 'assistant' THEN CASE WHEN turn % 5 = 3 THEN 'buttons' ELSE 'display_text' END WHEN role = 'user' THEN 'get_text' ELSE 'get_projects' END"
ST_SQL = f"""st AS (SELECT conv_id, turn, text, {KIND_SQL} AS kind, CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN turn + 1 END AS nxt FROM conversations)"""


@query(
    "fsm_states",
    f"""WITH {ST_SQL} SELECT conv_id AS dialogue_id, turn AS state_id, kind AS type, md5(text) AS digest, nxt AS next_state, CASE WHEN kind = 'get_projects' THEN 'rejected' ELSE 'ok' END AS outcome FROM st""",
)
def fsm_states(spark, sf):
    good, bad = dl.states(dl.parse_dialogues(_json(spark, sf)))
    both = good.withColumn("outcome", F.lit("ok")).unionByName(bad.withColumn("outcome", F.lit("rejected")))
    return both.select(
        "dialogue_id", F.col("state_id").cast("long").alias("state_id"), "type", F.md5("text").alias("digest"), F.col("next_state").cast("long").alias("next_state"), "outcome"
    )


@query(
    "fsm_buttons",
    f"""WITH {ST_SQL} SELECT conv_id AS dialogue_id, turn AS state_id, unnest([0, 1])::BIGINT AS pos, unnest(['primary', 'plain']) AS class, unnest([text, 'again']) AS text, unnest([nxt, 0])::BIGINT AS next_state FROM st WHERE kind = 'buttons'""",
)
def fsm_buttons(spark, sf):
    good, _ = dl.states(dl.parse_dialogues(_json(spark, sf)))
    ids = {c: F.col(c).cast("long") for c in ("state_id", "pos", "next_state")}
    return dl.buttons(good).withColumns(ids)


@query(
    "fsm_sentences",
    rf"""WITH {ST_SQL}, x AS (SELECT conv_id, turn, unnest(regexp_split_to_array(text, '\.\s*')) AS s FROM st WHERE kind = 'get_text')
SELECT conv_id AS dialogue_id, turn AS state_id, count(*) AS sentences, CAST(sum(len(s)) AS BIGINT) AS chars FROM x GROUP BY ALL""",
)
def fsm_sentences(spark, sf):
    good, _ = dl.states(dl.parse_dialogues(_json(spark, sf)))
    rows = dl.sentences(good).groupBy("dialogue_id", "state_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.length("sentence")).alias("chars"))
    return rows.withColumn("state_id", F.col("state_id").cast("long"))


@query(
    "fsm_lookup",
    f"""WITH {ST_SQL}, r AS (SELECT event_id, user_id AS dialogue_id, event_id % 7 AS state_id FROM events)
SELECT event_id, CASE WHEN st.conv_id IS NULL THEN 'not found' ELSE kind END AS type FROM r LEFT JOIN st ON st.conv_id = dialogue_id AND st.turn = state_id AND kind != 'get_projects'""",
)
def fsm_lookup(spark, sf):
    requests = load(spark, sf, "events").select("event_id", F.col("user_id").alias("dialogue_id"), (F.col("event_id") % 7).cast("int").alias("state_id"))
    good, _ = dl.states(dl.parse_dialogues(_json(spark, sf)))
    found, lost = dl.find_states(requests, good)
    return found.select("event_id", "type").unionByName(lost.select("event_id", F.lit("not found").alias("type")))


@query(
    "fsm_init",
    f"""WITH {ST_SQL}, u AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'img' || conv_id END AS img, 1 AS img_state, CASE WHEN conv_id % 2 = 0 THEN 'hello' END AS msg, CASE WHEN conv_id % 4 = 0 THEN 99 ELSE 0 END AS msg_state FROM conversations),
s AS (SELECT * FROM st WHERE kind != 'get_projects'),
h AS (SELECT DISTINCT s.conv_id FROM s JOIN u ON u.conv_id = s.conv_id WHERE (img IS NOT NULL AND turn = img_state) OR (msg IS NOT NULL AND turn = msg_state))
SELECT s.conv_id AS dialogue_id, turn AS state_id, md5(CASE WHEN msg IS NOT NULL AND turn = msg_state THEN msg WHEN img IS NOT NULL AND turn = img_state THEN img ELSE text END) AS digest, s.conv_id IN (SELECT conv_id FROM h) AS changed
FROM s JOIN u ON u.conv_id = s.conv_id""",
)
def fsm_init(spark, sf):
    k = F.col("conv_id")
    updates = load(spark, sf, "conversations").select("conv_id").distinct().select(
        k.alias("dialogue_id"), F.when(k % 3 == 0, F.concat(F.lit("img"), k.cast("string"))).alias("image_url"), F.lit(1).alias("image_state"),
        F.when(k % 2 == 0, "hello").alias("message"), F.when(k % 4 == 0, 99).otherwise(0).alias("message_state"),
    )
    good, _ = dl.states(dl.parse_dialogues(_json(spark, sf)))
    out = dl.initialise(good, updates)
    return out.select("dialogue_id", F.col("state_id").cast("long").alias("state_id"), F.md5("text").alias("digest"), "changed")


@query(
    "fsm_chatbot",
    f"""WITH {ST_SQL}, s AS (SELECT * FROM st WHERE kind != 'get_projects'),
h AS (SELECT DISTINCT conv_id FROM s WHERE turn = 1 AND conv_id % 3 = 0)
SELECT conv_id AS dialogue_id, turn AS state_id, CASE WHEN conv_id % 4 = 1 THEN '#00' || conv_id END AS colour, conv_id % 4 = 1 OR conv_id IN (SELECT conv_id FROM h) AS changed FROM s""",
)
def fsm_chatbot(spark, sf):
    """Every fourth project gives its chat window a look of its own, which alone makes its dialogue differ."""
    k = F.col("conv_id")
    colour = F.struct(F.concat(F.lit("#00"), k.cast("string")).alias("colour"))
    updates = load(spark, sf, "conversations").select("conv_id").distinct().select(
        k.alias("dialogue_id"), F.when(k % 3 == 0, "img").alias("image_url"), F.lit(1).alias("image_state"), F.lit(None).cast("string").alias("message"),
        F.lit(0).alias("message_state"), F.when(k % 4 == 1, colour).alias("chatbot"),
    )
    good, _ = dl.states(dl.parse_dialogues(_json(spark, sf)))
    return dl.initialise(good, updates).select("dialogue_id", F.col("state_id").cast("long").alias("state_id"), "chatbot.colour", "changed")
