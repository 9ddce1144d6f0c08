"""Every job as a query over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions.rules import (
    DEFAULT_INTENT,
    INTENT_LABELS,
    INTENT_RULES,
    MODE_RULES,
    NO_FORECAST_TEXT,
    NO_MODE_TEXT,
    NO_POSITION_TEXT,
    HOME_TEXT,
    AWAY_TEXT,
)
from colloquy.functions.text import SAME_LINE, WHITESPACE, escape_markup
from colloquy.operators.admission import admit_sends
from colloquy.operators.chunks import measure
from colloquy.operators.entities import session_snapshot_by_map
from colloquy.operators.payloads import (
    FAILURE_TEXT,
    FALLBACK_TEXT,
    normalise_payloads,
    request_records,
)
from colloquy.operators.rule_table import rule_table, tag_by_table
from colloquy.operators.session import (
    conversation_snapshot,
    session_snapshot,
    session_state,
    stitch_ids,
)
from colloquy.operators.tagging import (
    attach_labels,
    extract_forecast,
    extract_positions,
    mode_signal,
    tag_intent,
    with_lowered,
)
from colloquy.operators.transcript import AGENT, USER, transcript, turns_of_outcomes
from colloquy.operators.turns import clean_turns, number_messages, pair_exchanges, turn_chunks
from colloquy.plans import derived
from colloquy.plans.derived import event_exchanges, event_sends, response_bodies, table
from colloquy.plans.flow import conversation_flow
from colloquy.plans.report import conversation_report
from colloquy.sources.shared import new_folder
from colloquy.sources.turns import (
    known_turns,
    read_turns,
    stream_files,
    stream_turns,
    write_requests,
    write_transcript,
)
from colloquy.streaming.admission import admission_state, admit_stream
from colloquy.streaming.ordered import rocksdb_state
from colloquy.streaming.session import session_state_stream, stitch_ids_stream
from colloquy.streaming.snapshot import keep_snapshots, latest_snapshots
from colloquy.streaming.tags import tag_exchanges
from colloquy.streaming.transcript import transcript_stream
from colloquy.streaming.turns import pair_stream

# Small enough that sessions with a third of all events or turns are cut from sf0.01 on.
CUT_ROWS = 500
CUT_TURNS = 25

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(job):
        QUERIES[job.__name__], SQL[job.__name__] = job, sql
        return job

    return add


def turns_of(spark: SparkSession, folder: str) -> DataFrame:
    return read_turns(spark, f"{folder}/conversations.parquet")


# ---- SQL fragments -------------------------------------------------------------------------------


def _cases(text: str, rules, default: str | None) -> str:
    def hits(rule):
        return " OR ".join(f"contains(lower({text}), '{k}')" for k in rule.keywords)

    whens = " ".join(f"WHEN {hits(rule)} THEN '{rule.label}'" for rule in rules)
    return f"CASE {whens} ELSE {'NULL' if default is None else repr(default)} END"


def _forecast(text: str, entity: str, other: str) -> str:
    def place(name):
        name = name.lower()
        after = f"regexp_extract(lower({text}), '{name}{WHITESPACE}*[p#]?([0-9]+)', 1)"
        before = f"regexp_extract(lower({text}), '[p#]([0-9]+){SAME_LINE}*{name}', 1)"
        return f"coalesce(nullif({after}, ''), nullif({before}, ''))"

    return (
        f"CASE WHEN contains(lower({text}), 'p') AND {place(other)} IS NOT NULL"
        f" THEN 'P' || {place(entity)} END"
    )


def _position(text: str, entity: str) -> str:
    return f"'P' || nullif(regexp_extract({text}, '{entity}{SAME_LINE}*?[Pp]([0-9]+)', 1), '')"


TURNS = """turns AS (
    SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'ai' ELSE role END AS role, text
    FROM conversations WHERE role IN ('user', 'assistant', 'ai'))"""
STRIPPED = f"regexp_replace(text, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')"
CLEANED = f"""cleaned AS (
    SELECT * FROM (
        SELECT conv_id, turn, role, CASE role WHEN 'user' THEN {STRIPPED} ELSE text END AS text
        FROM turns) WHERE role <> 'user' OR text <> '')"""
PAIRED = """paired AS (
    SELECT conv_id, turn, message, reply, reply IS NOT NULL AS answered FROM (
        SELECT conv_id, turn, role, text AS message,
            CASE WHEN lead(role) OVER w = 'ai' THEN lead(text) OVER w END AS reply
        FROM cleaned WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user')"""


def _said(key: str = "user_id") -> str:
    return f"""said AS (
    SELECT *, reply IS NOT NULL AS answered FROM (
        SELECT {key} AS conv_id, event_id AS turn, {derived.MESSAGE} AS message,
            {derived.REPLY} AS reply FROM (SELECT *, {derived.PLACES} FROM events)))"""


def _told(source: str) -> str:
    return f"""told AS (
    SELECT conv_id, turn, answered, {_cases("message", INTENT_RULES, DEFAULT_INTENT)} AS intent,
        {_cases("message", MODE_RULES, None)} AS mode,
        {_forecast("message", "albon", "sainz")} AS forecast_albon,
        {_forecast("message", "sainz", "albon")} AS forecast_sainz,
        {_position("reply", "Albon")} AS position_albon,
        {_position("reply", "Sainz")} AS position_sainz
    FROM {source} WHERE answered
    UNION ALL SELECT conv_id, turn, answered, NULL, NULL, NULL, NULL, NULL, NULL
    FROM {source} WHERE NOT answered)"""


STATE = """SELECT conv_id, turn, first_value(mode IGNORE NULLS) OVER w AS mode,
    first_value(forecast_albon IGNORE NULLS) OVER w AS forecast_albon,
    first_value(forecast_sainz IGNORE NULLS) OVER w AS forecast_sainz,
    last_value(position_albon IGNORE NULLS) OVER w AS position_albon,
    last_value(position_sainz IGNORE NULLS) OVER w AS position_sainz
FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
FOLDED = f"""folded AS (
    SELECT conv_id, arg_min(mode, turn) FILTER (WHERE mode IS NOT NULL) AS mode,
        arg_min(forecast_albon, turn) FILTER (WHERE forecast_albon IS NOT NULL) AS forecast_albon,
        arg_min(forecast_sainz, turn) FILTER (WHERE forecast_sainz IS NOT NULL) AS forecast_sainz,
        coalesce(arg_max(position_albon, turn) FILTER (WHERE position_albon IS NOT NULL),
            '{NO_POSITION_TEXT}') AS position_albon,
        coalesce(arg_max(position_sainz, turn) FILTER (WHERE position_sainz IS NOT NULL),
            '{NO_POSITION_TEXT}') AS position_sainz,
        count(*) + count(*) FILTER (WHERE answered) AS messages
    FROM told GROUP BY conv_id)"""
SHOWN = f"""CASE WHEN mode IS NULL THEN '{NO_MODE_TEXT}' WHEN mode = 'home' THEN '{HOME_TEXT}'
        ELSE '{AWAY_TEXT}' END AS mode_text,
    CASE WHEN forecast_albon IS NULL THEN '{NO_FORECAST_TEXT}' END AS forecast_text"""
SNAPSHOT = f"SELECT *, {SHOWN} FROM folded"
IDS = """SELECT conv_id, turn,
    last_value(nullif(returned, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS request_id,
    last_value(nullif(returned, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_id
FROM (SELECT {key} AS conv_id, event_id AS turn,
    CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN NULL ELSE event_type END AS returned
    FROM events)"""
LABEL = (
    "CASE intent "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in INTENT_LABELS.items() if v)
    + " END"
)


def _escaped(text: str) -> str:
    return (
        f"replace(replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),"
        " chr(10), '<br/>')"
    )


def _transcript(key: str, source: str, order: str, failed: str = "FALSE") -> str:
    return f"""SELECT {key}, number, role, avatar, sender, {LABEL} AS label, html FROM (
    SELECT {key}, role, {_escaped("text")} AS html, row_number() OVER w - 1 AS number,
        CASE role WHEN 'ai' THEN '{AGENT.avatar}' ELSE '{USER.avatar}' END AS avatar,
        CASE role WHEN 'ai' THEN '{AGENT.sender}' ELSE '{USER.sender}' END AS sender,
        CASE WHEN role = 'ai' AND NOT {failed} THEN lag(asked) OVER w END AS intent
    FROM (SELECT *, CASE role WHEN 'user' THEN {_cases("text", INTENT_RULES, DEFAULT_INTENT)} END
        AS asked FROM {source})
    WINDOW w AS (PARTITION BY conv_id ORDER BY {order}))"""


def _admitted(key: str) -> str:
    return f"""WITH RECURSIVE sends AS (
    SELECT event_id AS id, {key} AS key, ts AS start, {derived.SEND_END} AS until,
        row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
walk AS (
    SELECT id, key, n, TRUE AS admitted, until AS free_at FROM sends WHERE n = 1
    UNION ALL
    SELECT s.id, s.key, s.n, s.start >= w.free_at,
        CASE WHEN s.start >= w.free_at THEN s.until ELSE w.free_at END
    FROM walk w JOIN sends s ON s.key = w.key AND s.n = w.n + 1)
SELECT id, key, admitted FROM walk"""


def _admitted_with_forced(key: str) -> str:
    return f"""WITH RECURSIVE sends AS (
    SELECT event_id AS id, {key} AS key, ts AS start, {derived.SEND_END} AS until, {derived.FORCED} AS forced,
        row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events),
walk AS (
    SELECT id, key, n, TRUE AS admitted, TRUE AS busy, [until] AS ends FROM sends WHERE n = 1
    UNION ALL
    SELECT id, key, n, goes, goes OR held, CASE WHEN goes THEN list_append(later, until) ELSE later END
    FROM (SELECT s.id, s.key, s.n, s.until, list_filter(w.ends, lambda e: e > s.start) AS later,
        w.busy AND len(list_filter(w.ends, lambda e: e > s.start)) = len(w.ends) AS held, s.forced OR NOT held AS goes
        FROM walk w JOIN sends s ON s.key = w.key AND s.n = w.n + 1))
SELECT id, key, admitted FROM walk"""


def _counts(field: str) -> str:
    kind, value = f"json_type(doc, '$.{field}')", f"json_extract_string(doc, '$.{field}')"
    return f"""CASE WHEN {kind} IS NULL OR {kind} = 'NULL' THEN FALSE
        WHEN {kind} = 'VARCHAR' THEN {value} <> '' WHEN {kind} = 'BOOLEAN' THEN {value} = 'true'
        WHEN {kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST({value} AS DOUBLE) <> 0
        ELSE TRUE END"""


_FIELD = " ".join(
    f"WHEN {_counts(f)} THEN '{f}'" for f in ("response", "result", "output")
)
OUTCOMES = f"""outcomes AS (
    SELECT conv_id, turn, text, status, CASE status WHEN 'ok' THEN json_extract_string(doc, '$.' || field)
            WHEN 'fallback' THEN '{FALLBACK_TEXT}' ELSE '{FAILURE_TEXT}' END AS reply,
        CASE WHEN {_counts("conversationId")} THEN json_extract_string(doc, '$.conversationId') END
            AS conversation_id
    FROM (SELECT *, CASE WHEN doc IS NULL OR json_type(doc) = 'NULL' THEN 'bad_body'
            WHEN field IS NULL THEN 'fallback'
            WHEN json_type(doc, '$.' || field) = 'VARCHAR' THEN 'ok' ELSE 'bad_type' END AS status
        FROM (SELECT *, CASE {_FIELD} END AS field FROM (
            SELECT *, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS doc FROM (
                SELECT *, {derived.BODY} AS body FROM (
                    SELECT *, CAST(to_json(text) AS VARCHAR) AS quoted FROM turns))))))"""


# ---- sources, filters, projections ---------------------------------------------------------------


@query(f"WITH {TURNS} SELECT * FROM turns")
def turn_scan(spark, folder):
    return turns_of(spark, folder)


PADDED = f"""given AS (SELECT conv_id, turn, role, {derived.PADDED_TEXT} AS text FROM conversations),
{TURNS.replace("FROM conversations", "FROM given")}"""


@query(f"WITH {PADDED}, {CLEANED} SELECT * FROM cleaned")
def cleaned_turns(spark, folder):
    given = table(spark, folder, "conversations")
    return clean_turns(known_turns(given.withColumn("text", F.expr(derived.PADDED_TEXT))))


@query(
    f"WITH {_said()} SELECT conv_id, turn,"
    f" {_cases('message', INTENT_RULES, DEFAULT_INTENT)} AS intent FROM said"
)
def intent_tags(spark, folder):
    tagged = tag_intent(event_exchanges(table(spark, folder, "events")))
    return tagged.select("conv_id", "turn", "intent")


@query(
    f"SELECT doc_id, {_cases('text', INTENT_RULES, DEFAULT_INTENT)} AS intent,"
    f" {_cases('text', MODE_RULES, None)} AS mode FROM documents"
)
def document_tags(spark, folder):
    documents = with_lowered(table(spark, folder, "documents"), "text")
    tagged = mode_signal(tag_intent(documents, text="text"), text="text")
    return tagged.select("doc_id", "intent", "mode")


@query(f"SELECT doc_id, {_cases('text', INTENT_RULES, DEFAULT_INTENT)} AS intent FROM documents")
def document_tags_by_table(spark, folder):
    rules = rule_table(spark, INTENT_RULES)
    return tag_by_table(table(spark, folder, "documents"), rules, text="text").select("doc_id", "intent")


# Long words of the benchmark as keywords, the longer the better.
@query(
    """WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS keyword FROM benchmark),
found AS (
    SELECT doc_id, arg_min(left(keyword, 3), (-length(keyword), left(keyword, 3))) AS tag
    FROM documents JOIN words ON contains(lower(text), keyword) GROUP BY doc_id)
SELECT doc_id, coalesce(tag, 'none') AS tag FROM documents LEFT JOIN found USING (doc_id)"""
)
def document_tags_by_words(spark, folder):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))
    rules = table(spark, folder, "benchmark").select(words.alias("keyword")).select(
        (-F.length("keyword")).alias("priority"), F.left("keyword", F.lit(3)).alias("label"), "keyword"
    )
    documents = table(spark, folder, "documents")
    return tag_by_table(documents, rules, "none", text="text", into="tag", keywords=500).select("doc_id", "tag")


@query(
    f"WITH {TURNS} SELECT conv_id, turn, {_cases('text', derived.VOCABULARY_RULES, 'NONE')} AS intent"
    " FROM turns WHERE role = 'user'"
)
def vocabulary_tags(spark, folder):
    asked = turns_of(spark, folder).where(F.col("role") == "user")
    return tag_intent(asked, derived.VOCABULARY_RULES, "NONE", text="text").select(
        "conv_id", "turn", "intent"
    )


@query(
    f"WITH {_said()} SELECT conv_id, turn, {_cases('message', MODE_RULES, None)} AS mode FROM said"
)
def mode_signals(spark, folder):
    found = mode_signal(event_exchanges(table(spark, folder, "events")))
    return found.select("conv_id", "turn", "mode")


@query(
    f"WITH {_said()} SELECT conv_id, turn, {_forecast('message', 'albon', 'sainz')} AS forecast_albon,"
    f" {_forecast('message', 'sainz', 'albon')} AS forecast_sainz FROM said"
)
def forecasts(spark, folder):
    found = extract_forecast(event_exchanges(table(spark, folder, "events")))
    return found.select("conv_id", "turn", "forecast_albon", "forecast_sainz")


@query(
    f"WITH {_said()} SELECT conv_id, turn, {_position('reply', 'Albon')} AS position_albon,"
    f" {_position('reply', 'Sainz')} AS position_sainz FROM said"
)
def reported_positions(spark, folder):
    found = extract_positions(event_exchanges(table(spark, folder, "events")))
    return found.select("conv_id", "turn", "position_albon", "position_sainz")


@query(
    f"WITH {TURNS}, {OUTCOMES} SELECT conv_id, turn, status, reply, conversation_id FROM outcomes"
)
def payload_outcomes(spark, folder):
    return normalise_payloads(response_bodies(turns_of(spark, folder))).drop("body")


REQUESTS = f"""WITH {TURNS} SELECT conv_id, turn, text AS message,
    nullif({derived.SENT_ID}, '') AS conversation_id, coalesce({derived.SENT_ID}, '') <> '' AS has_id
FROM turns WHERE role = 'user'"""


def _requests(spark, folder):
    asked = turns_of(spark, folder).where(F.col("role") == "user")
    return asked.select(
        "conv_id",
        "turn",
        F.col("text").alias("message"),
        F.expr(derived.SENT_ID).alias("conversation_id"),
    )


@query(REQUESTS)
def request_documents(spark, folder):
    record = F.col("record")
    return request_records(_requests(spark, folder)).select(
        "conv_id",
        "turn",
        F.get_json_object(record, "$.message").alias("message"),
        F.get_json_object(record, "$.conversationId").alias("conversation_id"),
        record.rlike(r'"conversationId":"[^"]*"\}$').alias("has_id"),
    )


@query(f"SELECT message, conversation_id FROM ({REQUESTS})")
def request_export(spark, folder):
    path = new_folder(spark, "requests")
    write_requests(request_records(_requests(spark, folder)), path)
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.message").alias("message"),
        F.get_json_object("value", "$.conversationId").alias("conversation_id"),
    )


@query(f"SELECT page_id, {_escaped('html')} AS html FROM pages")
def escaped_pages(spark, folder):
    pages = table(spark, folder, "pages")
    return pages.select("page_id", escape_markup(F.col("html")).alias("html"))


HOT = f"""given AS (SELECT {derived.HOT_CONVERSATION} AS conv_id, {derived.HOT_TURN} AS turn, role, text
    FROM conversations), {TURNS.replace("FROM conversations", "FROM given")}"""


def _hot_turns(spark, folder):
    return known_turns(
        table(spark, folder, "conversations").select(
            F.expr(derived.HOT_CONVERSATION).alias("conv_id"),
            F.expr(derived.HOT_TURN).alias("turn"),
            "role",
            "text",
        )
    )


# ---- pairing, labels, order ----------------------------------------------------------------------


@query(f"WITH {TURNS}, {CLEANED}, {PAIRED} SELECT * FROM paired")
def exchanges(spark, folder):
    turns = turns_of(spark, folder)
    return pair_exchanges(clean_turns(turns), turn_chunks(turns))


@query(
    f"""WITH {TURNS}, {CLEANED}, {PAIRED}
SELECT *, {LABEL} AS label FROM (
    SELECT *, {_cases("message", INTENT_RULES, DEFAULT_INTENT)} AS intent FROM paired)"""
)
def report(spark, folder):
    return conversation_report(turns_of(spark, folder))


@query(
    f"""WITH {_said()} SELECT conv_id, turn, intent, {LABEL} AS label FROM (
    SELECT *, {_cases("message", INTENT_RULES, DEFAULT_INTENT)} AS intent FROM said)"""
)
def intent_labels(spark, folder):
    tagged = tag_intent(event_exchanges(table(spark, folder, "events")))
    return attach_labels(tagged).select("conv_id", "turn", "intent", "label")


@query(
    f"""WITH {TURNS} SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS number
FROM turns"""
)
def message_numbers(spark, folder):
    return number_messages(turns_of(spark, folder))


@query(
    f"""WITH {HOT} SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS number
FROM turns"""
)
def message_numbers_of_hot_conversation(spark, folder):
    turns = _hot_turns(spark, folder)
    return number_messages(turns, turn_chunks(turns, CUT_TURNS))


@query(f"WITH {TURNS}, {CLEANED} {_transcript('conv_id, turn', 'cleaned', 'turn')}")
def transcripts(spark, folder):
    turns = turns_of(spark, folder)
    return transcript(clean_turns(turns), chunks=turn_chunks(turns))


@query(f"WITH {TURNS}, {CLEANED} {_transcript('conv_id', 'cleaned', 'turn')}")
def transcript_files(spark, folder):
    turns = turns_of(spark, folder)
    path, chunks = new_folder(spark, "transcripts"), turn_chunks(turns)
    shown = transcript(clean_turns(turns), chunks=chunks)
    write_transcript(shown.drop("turn"), path, chunks=chunks)
    return spark.read.parquet(path).drop("bucket")


@query(
    f"""WITH {TURNS}, {OUTCOMES}, spoken AS (
    SELECT conv_id, turn, 0 AS slot, 'user' AS role, text, FALSE AS failed FROM outcomes
    UNION ALL
    SELECT conv_id, turn, 1, 'ai', reply, status IN ('bad_type', 'bad_body') FROM outcomes)
{_transcript("conv_id, turn, slot", "spoken", "turn, slot", "failed")}"""
)
def outcome_transcripts(spark, folder):
    turns = turns_of(spark, folder)
    bodies = response_bodies(turns.withColumn("message", F.col("text")), "message")
    outcomes = normalise_payloads(bodies)
    return transcript(
        turns_of_outcomes(outcomes),
        order=("turn", "slot"),
        chunks=measure(turns.withColumn("slot", F.lit(0)), "conv_id", ("turn", "slot")),
    )


@query(f"WITH {HOT}, {CLEANED}, {PAIRED} SELECT * FROM paired")
def exchanges_of_hot_conversation(spark, folder):
    turns = _hot_turns(spark, folder)
    return pair_exchanges(clean_turns(turns), turn_chunks(turns, CUT_TURNS))


@query(f"WITH {HOT}, {CLEANED} {_transcript('conv_id, turn', 'cleaned', 'turn')}")
def transcripts_of_hot_conversation(spark, folder):
    turns = _hot_turns(spark, folder)
    return transcript(clean_turns(turns), chunks=turn_chunks(turns, CUT_TURNS))


# ---- session state -------------------------------------------------------------------------------


@query(f"WITH {_said()}, {_told('said')} {STATE}")
def running_state(spark, folder):
    return session_state(event_exchanges(table(spark, folder, "events")))


@query(f"WITH {_said(derived.HOT_SESSION)}, {_told('said')} {STATE}")
def running_state_of_hot_session(spark, folder):
    said = event_exchanges(table(spark, folder, "events"), derived.HOT_SESSION)
    return session_state(said, chunks=measure(said, "conv_id", ("turn",), CUT_ROWS))


@query(f"WITH {_said()}, {_told('said')}, {FOLDED} {SNAPSHOT}")
def snapshots(spark, folder):
    return session_snapshot(event_exchanges(table(spark, folder, "events")))


def _entity(name: str) -> str:
    low = name.lower()
    forecast, position = (f"arg_{m}({c}_{low}, turn) FILTER (WHERE {c}_{low} IS NOT NULL)" for m, c in (("min", "forecast"), ("max", "position")))
    return f"""SELECT conv_id, '{name}' AS entity, {forecast} AS forecast, {position} AS position,
    count(*) + count(*) FILTER (WHERE answered) AS messages FROM told GROUP BY conv_id"""


@query(
    f"""WITH {_said()}, {_told('said')}
SELECT * FROM ({_entity('Albon')} UNION ALL {_entity('Sainz')}) WHERE forecast IS NOT NULL OR position IS NOT NULL"""
)
def snapshots_by_map(spark, folder):
    """Two of five thousand entities are ever named."""
    entities = ["Albon", "Sainz", *[f"Nobody {i}" for i in range(4998)]]
    found = session_snapshot_by_map(event_exchanges(table(spark, folder, "events")), entities)
    keys = F.array_union(F.map_keys("positions"), F.coalesce(F.map_keys("forecast"), F.array().cast("array<string>")))
    return found.select("conv_id", "messages", "forecast", "positions", F.explode(keys).alias("entity")).select(
        "conv_id",
        "entity",
        F.try_element_at("forecast", F.col("entity")).alias("forecast"),
        F.try_element_at("positions", F.col("entity")).alias("position"),
        "messages",
    )


@query(
    f"""WITH {TURNS}, {CLEANED}, {PAIRED}, {_told("paired")}, {FOLDED},
counted AS (SELECT conv_id, count(*) AS messages FROM cleaned GROUP BY conv_id)
SELECT counted.conv_id, counted.messages, mode, forecast_albon, forecast_sainz,
    coalesce(position_albon, '{NO_POSITION_TEXT}') AS position_albon,
    coalesce(position_sainz, '{NO_POSITION_TEXT}') AS position_sainz, {SHOWN}
FROM counted LEFT JOIN folded ON counted.conv_id = folded.conv_id"""
)
def conversation_snapshots(spark, folder):
    turns = turns_of(spark, folder)
    return conversation_snapshot(clean_turns(turns), chunks=turn_chunks(turns))


def _returned(events, key):
    returned = "CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN NULL ELSE event_type END"
    return events.select(
        F.expr(key).alias("conv_id"),
        F.col("event_id").alias("turn"),
        F.expr(returned).alias("conversation_id"),
    )


@query(IDS.replace("{key}", "user_id"))
def session_ids(spark, folder):
    return stitch_ids(_returned(table(spark, folder, "events"), "user_id")).drop("conversation_id")


@query(IDS.replace("{key}", derived.HOT_SESSION))
def session_ids_of_hot_session(spark, folder):
    given = _returned(table(spark, folder, "events"), derived.HOT_SESSION)
    cut = measure(given, "conv_id", ("turn",), CUT_ROWS)
    return stitch_ids(given, chunks=cut).drop("conversation_id")


FLOW = f"""WITH {TURNS}, asked AS (SELECT * FROM turns WHERE role = 'user'), {OUTCOMES.replace("FROM turns", "FROM asked")},
sends AS (SELECT conv_id, turn, text AS message, reply, status, status IN ('ok', 'fallback') AS answered,
    nullif(conversation_id, '') AS returned, turn = 0 AS hidden FROM outcomes),
{_told("sends")}, state AS ({STATE}),
numbered AS (SELECT *, sum(CASE WHEN hidden THEN 1 ELSE 2 END) OVER (PARTITION BY conv_id ORDER BY turn) AS total,
    last_value(returned IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS request_id,
    last_value(returned IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_id FROM sends),
labelled AS (SELECT *, {LABEL} AS label FROM (SELECT *, CASE WHEN answered THEN
    {_cases("message", INTENT_RULES, DEFAULT_INTENT)} END AS intent FROM numbered))
SELECT conv_id, turn, status, request_id, session_id, message AS sent_message, request_id AS sent_id,
    CASE WHEN NOT hidden THEN total - 2 END::BIGINT AS number, (total - 1)::BIGINT AS reply_number, label,
    mode, forecast_albon, forecast_sainz, position_albon, position_sainz
FROM labelled JOIN state USING (conv_id, turn)"""


@query(FLOW)
def conversation_pipeline(spark, folder):
    asked = turns_of(spark, folder).where(F.col("role") == "user")
    bodies = response_bodies(asked.withColumn("message", F.col("text")), "message")
    done = conversation_flow(bodies.withColumn("hidden", F.col("turn") == 0))
    return done.withColumns(
        {
            "sent_message": F.get_json_object("record", "$.message"),
            "sent_id": F.get_json_object("record", "$.conversationId"),
        }
    ).drop("record")


# ---- admission -----------------------------------------------------------------------------------


@query(_admitted("user_id"))
def admission(spark, folder):
    return admit_sends(event_sends(table(spark, folder, "events"))).select("id", "key", "admitted")


@query(_admitted(derived.HOT_SESSION))
def admission_of_hot_session(spark, folder):
    sends = event_sends(table(spark, folder, "events"), derived.HOT_SESSION)
    return admit_sends(sends, max_rows=CUT_ROWS).select("id", "key", "admitted")


@query(_admitted(derived.HOT_SESSION))
def admission_of_hot_session_by_doubling(spark, folder):
    sends = event_sends(table(spark, folder, "events"), derived.HOT_SESSION)
    admitted = admit_sends(sends, max_rows=CUT_ROWS, max_links=1)
    return admitted.select("id", "key", "admitted")


@query(_admitted_with_forced("user_id"))
def admission_with_forced(spark, folder):
    sends = event_sends(table(spark, folder, "events"))
    return admit_sends(sends, forced="forced").select("id", "key", "admitted")


@query(_admitted_with_forced(derived.HOT_SESSION))
def admission_with_forced_of_hot_session(spark, folder):
    sends = event_sends(table(spark, folder, "events"), derived.HOT_SESSION)
    return admit_sends(sends, max_rows=CUT_ROWS, forced="forced").select("id", "key", "admitted")


# ---- streams, run until their input is used up ---------------------------------------------------


def _stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    return stream_files(spark, folder, schema, f"{name}.parquet")


def _finished(spark, stream: DataFrame, purpose: str) -> DataFrame:
    path = new_folder(spark, purpose)
    writer = stream.writeStream.option("checkpointLocation", new_folder(spark, "progress"))
    writer.trigger(availableNow=True).start(path, format="parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _all_of(spark, purpose: str, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a job that waits for the watermark gives in the end: all of its input first, then, in a second run that goes on
    from the first, the mark that nothing more will come."""
    marks, path, progress = new_folder(spark, "marks"), new_folder(spark, purpose), new_folder(spark, "progress")
    spark.createDataFrame([], "until TIMESTAMP").write.parquet(marks)
    for last in (False, True):
        if last:
            spark.sql("SELECT TIMESTAMP '9000-01-01 00:00:00' AS until").write.mode("append").parquet(marks)
        stream = job(stream_files(spark, marks, "until TIMESTAMP"))
        with rocksdb_state(spark):
            running = (
                stream.writeStream.option("checkpointLocation", progress)
                .trigger(availableNow=True)
                .start(path, format="parquet")
            )
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path).drop("late")


@query(f"WITH {TURNS} SELECT * FROM turns")
def streamed_turns(spark, folder):
    return _finished(spark, stream_turns(spark, folder, "conversations.parquet"), "turns")


@query(
    f"WITH {_said()}, {_told('said')} SELECT * EXCLUDE (answered) FROM told WHERE answered"
)
def streamed_tags(spark, folder):
    said = event_exchanges(_stream(spark, folder, "events"))
    return _finished(spark, tag_exchanges(said), "tags")


@query(f"WITH {_said()}, {_told('said')}, {FOLDED} {SNAPSHOT}")
def streamed_snapshots(spark, folder):
    path = new_folder(spark, "snapshots")
    said = event_exchanges(_stream(spark, folder, "events"))
    writer = keep_snapshots(said, path, new_folder(spark, "progress"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return latest_snapshots(spark, path)


@query(_admitted("user_id"))
def streamed_admission(spark, folder):
    sends = event_sends(_stream(spark, folder, "events"))
    return _all_of(spark, "admitted", lambda marks: admit_stream(sends, delay="1 hour", marks=marks))


@query(_admitted("user_id"))
def streamed_admission_after_table(spark, folder):
    """The first half of the time is decided as a table, the stream goes on from there."""
    events = table(spark, folder, "events")
    times = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    half = F.lit(times["first"] + (times["last"] - times["first"]) / 2)
    before = admit_sends(event_sends(events.where(F.col("ts") < half)))
    sends = event_sends(_stream(spark, folder, "events").where(F.col("ts") >= half))
    after = _all_of(spark, "admitted", lambda marks: admit_stream(sends, marks=marks, initial=admission_state(before)))
    return before.select("id", "key", "admitted").unionByName(after)


@query(f"WITH {TURNS}, {CLEANED}, {PAIRED} SELECT * FROM paired")
def streamed_exchanges(spark, folder):
    turns = clean_turns(stream_turns(spark, folder, "conversations.parquet"))
    timed = turns.withColumn("said", F.timestamp_seconds(60 * F.col("turn")))
    return _all_of(spark, "exchanges", lambda marks: pair_stream(timed, "said", marks=marks))


@query(f"WITH {TURNS}, {CLEANED} {_transcript('conv_id, turn', 'cleaned', 'turn')}")
def streamed_transcripts(spark, folder):
    turns = clean_turns(stream_turns(spark, folder, "conversations.parquet"))
    timed = turns.withColumn("said", F.timestamp_seconds(60 * F.col("turn")))
    return _all_of(spark, "transcripts", lambda marks: transcript_stream(timed, "said", marks=marks))


def _timed(exchanges: DataFrame) -> DataFrame:
    return exchanges.withColumn("said", F.timestamp_seconds("turn"))


@query(f"WITH {_said()}, {_told('said')} {STATE}")
def streamed_running_state(spark, folder):
    said = _timed(event_exchanges(_stream(spark, folder, "events")))
    return _all_of(spark, "states", lambda marks: session_state_stream(said, "said", marks=marks))


@query(f"WITH {_said()}, {_told('said')} {STATE}")
def streamed_running_state_after_table(spark, folder):
    """The first half of the turns is a table, the stream goes on from the last state of each session."""
    half = table(spark, folder, "events").agg(F.max("event_id")).first()[0] // 2
    before = session_state(event_exchanges(table(spark, folder, "events")).where(F.col("turn") <= half))
    signals = [c for c in before.columns if c not in ("conv_id", "turn")]
    last = before.groupBy("conv_id").agg(F.max_by(F.struct(*signals), "turn").alias("s")).select("conv_id", "s.*")
    said = _timed(event_exchanges(_stream(spark, folder, "events")).where(F.col("turn") > half))
    after = _all_of(spark, "states", lambda marks: session_state_stream(said, "said", marks=marks, initial=last))
    return before.unionByName(after)


@query(IDS.replace("{key}", "user_id"))
def streamed_session_ids(spark, folder):
    returned = _timed(_returned(_stream(spark, folder, "events"), "user_id"))
    return _all_of(spark, "ids", lambda marks: stitch_ids_stream(returned, "said", marks=marks))
