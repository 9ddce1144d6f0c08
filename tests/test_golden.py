"""Expected rows for the rules that are easy to get wrong."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from colloquy.functions.text import escape_markup, strip
from colloquy.operators.payloads import (
    FAILURE_TEXT,
    FALLBACK_TEXT,
    normalise_payloads,
    outcome_exchanges,
    read_again,
    request_records,
)
from colloquy.operators.session import session_snapshot, session_state, stitch_ids
from colloquy.operators.tagging import (
    attach_labels,
    extract_forecast,
    extract_positions,
    mode_signal,
    tag_intent,
    with_lowered,
)
from colloquy.operators.transcript import transcript, turns_of_outcomes
from colloquy.operators.turns import clean_turns, number_messages, pair_exchanges
from colloquy.plans.flow import conversation_flow

INTENTS = {
    "What is an undercut?": "TERM_EXPLAIN",
    "What is DRS?": "TERM_EXPLAIN",
    "Should Williams pit now?": "STRATEGY",
    "Tell me about Williams history": "HISTORY",
    "How is my prediction looking?": "PREDICTION",
    "Hello": "GENERAL",
    "What is the pit strategy?": "TERM_EXPLAIN",
    "How am I doing in history class": "HISTORY",
    "I spent the entire day at the hospital": "STRATEGY",
    "WHAT  IS drag?": "GENERAL",
    "What is": "TERM_EXPLAIN",
    "": "GENERAL",
}
MODES = {
    "Watching from my sofa": "home",
    "At the circuit": "trackside",
    "Is there a race?": "trackside",
    "Watching it there": "home",
    "I am homesick": "home",
    "Hello": None,
}
FORECASTS = {
    "Albon P6, Sainz P8": ("P6", "P8"),
    "Albon\nP6 Sainz P8": ("P6", "P8"),
    "albon 6 sainz 8": (None, None),
    "prediction: albon 6 sainz 8": ("P6", "P8"),
    "albon #4, sainz #9": (None, None),
    "position albon #4, sainz #9": ("P4", "P9"),
    "Albon P6": (None, None),
    "p5 albon p8 sainz": ("P8", "P5"),
    "i pick p3 for albon, p7 for sainz": ("P3", "P3"),
    "albon p007 sainz p99": ("P007", "P99"),
    "p3\nalbon sainz p4": (None, None),
    "albon\u00a0\ufeffp3 sainz\u2003p4": ("P3", "P4"),
    "albon p٣ sainz p4": (None, None),
    "p1\u0085albon p\u0085sainz": ("P1", "P1"),
}
POSITIONS = {
    "Albon is P5": ("P5", None),
    "Sainz P4, Albon P6": ("P6", "P4"),
    "Albon and Sainz both pit, Sainz P4": ("P4", "P4"),
    "Albon P5 then Albon P4": ("P5", None),
    "Albon lap30": ("P30", None),
    "Albon\nP7": (None, None),
    "Albon\rP7": (None, None),
    "Albon\u2028P7": (None, None),
    "Albon\u0085P7": ("P7", None),
    "albon P3": (None, None),
    "Albon\nAlbon p2": ("P2", None),
}
PAYLOADS = {
    '{"response":"hi","conversationId":"c1"}': ("ok", "hi", "c1"),
    '{"response":"","result":"r"}': ("ok", "r", None),
    '{"output":"o"}': ("ok", "o", None),
    '{"response":false,"result":"x"}': ("ok", "x", None),
    '{"response":0,"output":"z"}': ("ok", "z", None),
    '{"response":null,"output":"q"}': ("ok", "q", None),
    "{}": ("fallback", FALLBACK_TEXT, None),
    "[]": ("fallback", FALLBACK_TEXT, None),
    '[{"response":"x","conversationId":"c"}]': ("fallback", FALLBACK_TEXT, None),
    '"str"': ("fallback", FALLBACK_TEXT, None),
    "12": ("fallback", FALLBACK_TEXT, None),
    "false": ("fallback", FALLBACK_TEXT, None),
    '{"response":0.0}': ("fallback", FALLBACK_TEXT, None),
    '{"response":-0.0,"result":1e-400}': ("fallback", FALLBACK_TEXT, None),
    '{"response":5}': ("bad_type", FAILURE_TEXT, None),
    '{"response":{"a":1},"conversationId":"c2"}': ("bad_type", FAILURE_TEXT, "c2"),
    '{"response":[]}': ("bad_type", FAILURE_TEXT, None),
    '{"response":0.5}': ("bad_type", FAILURE_TEXT, None),
    '{"response":true,"result":"x"}': ("bad_type", FAILURE_TEXT, None),
    '{"response":1e999}': ("bad_type", FAILURE_TEXT, None),
    "null": ("bad_body", FAILURE_TEXT, None),
    "not json": ("bad_body", FAILURE_TEXT, None),
    "": ("bad_body", FAILURE_TEXT, None),
    " \n": ("bad_body", FAILURE_TEXT, None),
    '{"response":"x"} y': ("bad_body", FAILURE_TEXT, None),
    '{"response":"x"}] y': ("bad_body", FAILURE_TEXT, None),
    '{"response":"x"}} y': ("bad_body", FAILURE_TEXT, None),
    '{"response":"x"},{}': ("bad_body", FAILURE_TEXT, None),
    '{"response":"x"}, "c":1': ("bad_body", FAILURE_TEXT, None),
    '{"response":"x"},null': ("bad_body", FAILURE_TEXT, None),
    "null] y": ("bad_body", FAILURE_TEXT, None),
    '{"response":"[x]","a":[1]}': ("ok", "[x]", None),
    ' {"response":"x"}\n': ("ok", "x", None),
    '\ufeff{"response":"x"}': ("ok", "x", None),
    '{"response":"a","response":"b"}': ("ok", "b", None),
    '{"response":"a","conversationId":""}': ("ok", "a", None),
    '{"response":"a","conversationId":7}': ("ok", "a", "7"),
    None: ("bad_body", FAILURE_TEXT, None),
}


def frame(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} STRING")


def test_intents(spark):
    got = tag_intent(frame(spark, INTENTS, "message")).collect()
    assert {r["message"]: r["intent"] for r in got} == INTENTS


def test_whole_words_is_an_option(spark):
    asked = frame(spark, ["the hospital", "pit now", "drs?", "what is"], "message")
    got = tag_intent(asked, whole_words=True).collect()
    assert [r["intent"] for r in got] == ["GENERAL", "STRATEGY", "TERM_EXPLAIN", "TERM_EXPLAIN"]


def test_labels(spark):
    tagged = frame(spark, ["TERM_EXPLAIN", "GENERAL", "UNKNOWN", None], "intent")
    shown = {r["intent"]: r["label"] for r in attach_labels(tagged).collect()}
    assert shown == {"TERM_EXPLAIN": "⚙ Terms Engine", "GENERAL": None, "UNKNOWN": None, None: None}
    table = spark.createDataFrame([("GENERAL", "g")], "intent STRING, label STRING")
    shown = {r["intent"]: r["label"] for r in attach_labels(tagged, table).collect()}
    assert shown == {"TERM_EXPLAIN": None, "GENERAL": "g", "UNKNOWN": None, None: None}


def test_modes(spark):
    got = mode_signal(frame(spark, MODES, "message")).collect()
    assert {r["message"]: r["mode"] for r in got} == MODES


def test_forecasts(spark):
    got = extract_forecast(frame(spark, FORECASTS, "message")).collect()
    assert {r["message"]: (r["forecast_albon"], r["forecast_sainz"]) for r in got} == FORECASTS


def test_positions(spark):
    got = extract_positions(frame(spark, POSITIONS, "reply")).collect()
    assert {r["reply"]: (r["position_albon"], r["position_sainz"]) for r in got} == POSITIONS


def test_payloads(spark):
    got = normalise_payloads(frame(spark, PAYLOADS, "body")).collect()
    assert {r["body"]: (r["status"], r["reply"], r["conversation_id"]) for r in got} == PAYLOADS


def test_requests(spark):
    df = spark.createDataFrame(
        [("hi", "c1"), ("hi", ""), ("hi", None), ('a"\n', "é")], "message STRING, conversation_id STRING"
    )
    assert [r["record"] for r in request_records(df).collect()] == [
        '{"message":"hi","conversationId":"c1"}',
        '{"message":"hi"}',
        '{"message":"hi"}',
        '{"message":"a\\"\\n","conversationId":"é"}',
    ]


def test_strip_and_escape(spark):
    texts = [" \t\u00a0\ufeffhi\n ", "\u2003\u3000", "a\u0085", "\x0ba  b\x0c", "a" + " " * 50000 + "b "]
    got = [r[0] for r in frame(spark, texts, "t").select(strip(F.col("t"))).collect()]
    assert got == ["hi", "", "a\u0085", "a  b", "a" + " " * 50000 + "b"]
    escaped = frame(spark, ['a & <b>\n&amp; "q"\r'], "t").select(escape_markup(F.col("t"))).first()[0]
    assert escaped == 'a &amp; &lt;b&gt;<br/>&amp;amp; "q"\r'


def test_clean_and_pair(spark):
    turns = spark.createDataFrame(
        [
            (1, 0, "ai", " greeting "),
            (1, 1, "user", " a "),
            (1, 3, "user", "b"),
            (1, 4, "ai", " r "),
            (1, 6, "user", "\u00a0"),
            (1, 7, "ai", "stray"),
            (1, 9, "user", "last"),
            (2, 0, "user", "only"),
        ],
        "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    )
    got = pair_exchanges(clean_turns(turns)).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in got] == [
        (1, 1, "a", None, False),
        (1, 3, "b", " r ", True),
        (1, 9, "last", None, False),
        (2, 0, "only", None, False),
    ]


@pytest.fixture(scope="module")
def story(spark):
    rows = [
        (1, 0, "Hello", "Home or circuit?", True),
        (1, 2, "watching at home", "Albon P9, Sainz P11", True),
        (1, 4, "Actually I am at the circuit", "Albon P8", True),
        (1, 6, "Albon P6, Sainz P8", "Locked.", True),
        (1, 8, "Albon P1, Sainz P2", None, False),
        (1, 10, "Albon P1, Sainz P2", "Noted", True),
        (2, 0, "there", None, False),
    ]
    return spark.createDataFrame(
        rows, "conv_id BIGINT, turn BIGINT, message STRING, reply STRING, answered BOOLEAN"
    )


def test_session_state(spark, story):
    got = session_state(story).orderBy("conv_id", "turn").collect()
    assert [tuple(r)[1:] for r in got] == [
        (0, None, None, None, None, None),
        (2, "home", None, None, "P9", "P11"),
        (4, "home", None, None, "P8", "P11"),
        (6, "home", "P6", "P8", "P8", "P11"),
        (8, "home", "P6", "P8", "P8", "P11"),
        (10, "home", "P6", "P8", "P8", "P11"),
        (0, None, None, None, None, None),
    ]


def test_session_snapshot(spark, story):
    got = {r["conv_id"]: r.asDict() for r in session_snapshot(story).collect()}
    assert got[1] == {
        "conv_id": 1,
        "mode": "home",
        "mode_text": "🏠 Home Fan",
        "forecast_albon": "P6",
        "forecast_sainz": "P8",
        "forecast_text": None,
        "position_albon": "P8",
        "position_sainz": "P11",
        "messages": 11,
    }
    assert got[2] == {
        "conv_id": 2,
        "mode": None,
        "mode_text": "Awaiting Mode",
        "forecast_albon": None,
        "forecast_sainz": None,
        "forecast_text": "Set during onboarding",
        "position_albon": "—",
        "position_sainz": "—",
        "messages": 1,
    }


def test_session_ids(spark):
    df = spark.createDataFrame(
        [(1, 0, "c1"), (1, 2, None), (1, 4, ""), (1, 6, "c2"), (1, 8, None)],
        "conv_id BIGINT, turn BIGINT, conversation_id STRING",
    )
    got = stitch_ids(df).orderBy("turn").collect()
    assert [(r["request_id"], r["session_id"]) for r in got] == [
        (None, "c1"),
        ("c1", "c1"),
        ("c1", "c1"),
        ("c1", "c2"),
        ("c2", "c2"),
    ]


def test_transcript_with_failures(spark):
    bodies = [
        (1, 0, "What is DRS?", '{"response":"a & b"}'),
        (1, 1, "explain <it>", '{"response":5}'),
        (1, 2, "pit", "oops"),
        (1, 3, "tyre", "{}"),
    ]
    df = spark.createDataFrame(bodies, "conv_id BIGINT, turn BIGINT, message STRING, body STRING")
    outcomes = normalise_payloads(df)
    rows = transcript(turns_of_outcomes(outcomes), order=("turn", "slot")).orderBy("number").collect()
    assert [(r["number"], r["sender"], r["label"], r["html"]) for r in rows] == [
        (0, "You", None, "What is DRS?"),
        (1, "Assistant", "⚙ Terms Engine", "a &amp; b"),
        (2, "You", None, "explain &lt;it&gt;"),
        (3, "Assistant", None, FAILURE_TEXT),
        (4, "You", None, "pit"),
        (5, "Assistant", None, FAILURE_TEXT),
        (6, "You", None, "tyre"),
        (7, "Assistant", "🏁 Strategy Engine", FALLBACK_TEXT),
    ]
    twice = turns_of_outcomes(outcomes, count_failed_twice=True)
    rows = transcript(twice, order=("turn", "slot")).orderBy("number").collect()
    assert [r["number"] for r in rows] == [0, 1, 2, 4, 5, 6, 7, 8]
    assert [r["answered"] for r in outcome_exchanges(outcomes).orderBy("turn").collect()] == [
        True,
        False,
        False,
        True,
    ]


def test_numbers_start_at_zero(spark):
    turns = spark.createDataFrame([(1, 5), (1, 2), (2, 9)], "conv_id BIGINT, turn BIGINT")
    got = {(r["conv_id"], r["turn"]): r["number"] for r in number_messages(turns).collect()}
    assert got == {(1, 2): 0, (1, 5): 1, (2, 9): 0}


OLD_PATTERNS = {
    "before": r"[p#]([0-9]+)[^\n\r\x{2028}\x{2029}]*albon",
    "reply": r"Albon[^\n\r\x{2028}\x{2029}]*?[Pp]([0-9]+)",
}


def test_lines_read_once_find_what_the_patterns_find(spark):
    from colloquy.functions import signals

    dice = random.Random(1)
    parts = ["albon", "Albon", "p", "P", "#", "1", "23", " ", "\n", "\r", " ", "\u0085", "x", "albonp4"]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randrange(14))) for _ in range(4000)]
    rows = frame(spark, texts, "t").select(
        "t",
        signals.number_before(F.col("t"), "Albon").alias("before"),
        F.regexp_extract("t", OLD_PATTERNS["before"], 1).alias("old_before"),
        signals.place_in_reply(F.col("t"), "Albon").alias("reply"),
        F.regexp_extract("t", OLD_PATTERNS["reply"], 1).alias("old_reply"),
    )
    assert rows.where("before <> old_before OR reply <> old_reply").collect() == []
    assert rows.where("before <> '' AND reply <> ''").count() > 50


@pytest.mark.parametrize("text", ["p1 " * 700_000 + "albon sainz", "Albon Sainz " * 170_000, "albon p" * 300_000])
def test_long_lines_take_linear_time(spark, text):
    told = frame(spark, [text], "message").withColumn("reply", F.col("message"))
    began = time.perf_counter()
    extract_positions(extract_forecast(told)).drop("message", "reply").collect()
    assert time.perf_counter() - began < 8


def test_shared_lower_case_is_of_its_own_text(spark):
    rows = spark.createDataFrame([("what is drs", "my prediction")], "message STRING, reply STRING")
    shared = with_lowered(rows, "message")
    assert tag_intent(shared, text="reply").first()["intent"] == "PREDICTION"
    assert tag_intent(with_lowered(shared, "reply"), text="message").first()["intent"] == "TERM_EXPLAIN"
    assert tag_intent(rows, text="reply").columns == ["message", "reply", "intent"]


def test_entities_of_one_name_are_refused(spark):
    for job in (extract_forecast, extract_positions):
        with pytest.raises(ValueError):
            job(spark.createDataFrame([("a", "b")], "message STRING, reply STRING"), ("A B", "A-B"))


def test_no_entities(spark, story):
    got = session_snapshot(story, entities=()).where("conv_id = 1").first().asDict()
    assert got == {"conv_id": 1, "mode": "home", "messages": 11, "mode_text": "🏠 Home Fan", "forecast_text": "Set during onboarding"}


def test_failures_are_shown_and_counted(spark):
    bodies = [(1, 0, "a", '{"response":"b"}'), (1, 1, "c", "oops"), (1, 2, "d", '{"response":5}')]
    df = spark.createDataFrame(bodies, "conv_id BIGINT, turn BIGINT, message STRING, body STRING")
    outcomes = normalise_payloads(df)
    assert session_snapshot(outcome_exchanges(outcomes)).first()["messages"] == 6
    assert turns_of_outcomes(outcomes).count() == 6


def test_bodies_beyond_the_limits_of_the_first_reader(spark):
    long = "x" * 21_000_000
    deep = "[" * 1_500 + "]" * 1_500
    bodies = {
        1: ('{"response":"' + long + '","conversationId":"c"}', ("ok", len(long), "c")),
        2: ('{"a":' + deep + ',"response":"d","conversationId":7}', ("ok", 1, "7")),
        3: ('{"a":' + "1" * 1_500 + ',"result":"n"}', ("ok", 1, None)),
        4: ('{"a":' + deep + ',"response":[]}', ("bad_type", len(FAILURE_TEXT), None)),
        5: ('{"a":' + deep + ',"response":0.0,"result":-0e5,"output":""}', ("fallback", len(FALLBACK_TEXT), None)),
        6: ('{"a":' + deep + ',"response":"x"} y', ("bad_body", len(FAILURE_TEXT), None)),
        7: ('{"a":' + deep + ',"response":NaN}', ("bad_body", len(FAILURE_TEXT), None)),
        8: ("[" * 400_000 + "]" * 400_000, ("unread", len(FAILURE_TEXT), None)),
        9: ('{"response":' + "9" * 5_000 + "}", ("bad_type", len(FAILURE_TEXT), None)),
    }
    df = spark.createDataFrame([(k, b) for k, (b, _) in bodies.items()], "id INT, body STRING")
    got = normalise_payloads(df).select("id", "status", F.length("reply").alias("n"), "conversation_id").collect()
    assert {r["id"]: (r["status"], r["n"], r["conversation_id"]) for r in got} == {k: w for k, (_, w) in bodies.items()}


def test_second_reader_agrees_with_the_first():
    for body, (status, reply, id) in PAYLOADS.items():
        body = body[1:] if body and body[0] == "\ufeff" else body
        got = read_again(body, ("response", "result", "output"))
        assert (got["status"], got["id"]) == (status, id), body
        if status == "ok":
            assert got["reply"] == reply


def test_hidden_turns(spark):
    rows = [
        (1, 0, "What is DRS?", '{"response":"hi, at home?","conversationId":"c1"}', True),
        (1, 1, "pit", '{"response":5,"conversationId":"c2"}', False),
        (1, 2, "tyre", "oops", None),
    ]
    df = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, message STRING, body STRING, hidden BOOLEAN")
    outcomes = normalise_payloads(df)
    shown = transcript(turns_of_outcomes(outcomes), order=("turn", "slot")).orderBy("number").collect()
    assert [(r["number"], r["role"], r["label"]) for r in shown] == [
        (0, "ai", "⚙ Terms Engine"),
        (1, "user", None),
        (2, "ai", None),
        (3, "user", None),
        (4, "ai", None),
    ]
    assert session_snapshot(outcome_exchanges(outcomes)).first()["messages"] == 5
    numbers = number_messages(turns_of_outcomes(outcomes).withColumn("turn", F.col("turn") * 2 + F.col("slot")))
    assert [r["number"] for r in numbers.orderBy("turn").collect()] == [None, 0, 1, 2, 3, 4]
    flow = conversation_flow(df).orderBy("turn").collect()
    assert [(r["status"], r["request_id"], r["session_id"], r["number"], r["reply_number"]) for r in flow] == [
        ("ok", None, "c1", None, 0),
        ("bad_type", "c1", "c2", 1, 2),
        ("bad_body", "c2", "c2", 3, 4),
    ]
    assert [r["record"] for r in flow] == [
        '{"message":"What is DRS?"}',
        '{"message":"pit","conversationId":"c1"}',
        '{"message":"tyre","conversationId":"c2"}',
    ]
    assert [r["label"] for r in flow] == ["⚙ Terms Engine", None, None]


def test_an_unread_body_is_shown_as_a_failure(spark):
    rows = [(1, 0, "What is DRS?", "[" * 400_000 + "]" * 400_000), (1, 1, "What is VSC?", '{"response":"a car"}')]
    outcomes = normalise_payloads(spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, message STRING, body STRING"))
    shown = transcript(turns_of_outcomes(outcomes), order=("turn", "slot")).orderBy("number").collect()
    assert [(r["role"], r["label"]) for r in shown] == [
        ("user", None),
        ("ai", None),
        ("user", None),
        ("ai", "⚙ Terms Engine"),
    ]


def test_ids_are_sent_back_as_they_came(spark):
    deep = "[" * 1_500 + "]" * 1_500
    ids = ["7", '"7"', "1.50", "true", '{"a":[1,null,"é\\"x"]}', '""', "0", "null", '"last"', "123456789012345678901234567890"]
    bodies = [f'{{"response":"r","conversationId":{i}}}' for i in ids]
    # Both readers hand an id on alike.
    for more in ("", f',"deep":{deep}'):
        rows = [(1, i, f"m{i}" if i != 2 else None, b[:-1] + more + "}") for i, b in enumerate(bodies)]
        df = spark.createDataFrame([*rows, (1, 99, "end", "{}")], "conv_id BIGINT, turn BIGINT, message STRING, body STRING")
        records = [json.loads(r["record"]) for r in conversation_flow(df).orderBy("turn").collect()]
        held, want = None, []
        for i in [*ids, None]:
            want.append(held)
            found = json.loads(i) if i else None
            held = found if found or isinstance(found, (dict, list)) else held
        assert [r.get("conversationId") for r in records] == want
        assert [type(r.get("conversationId")) for r in records] == [type(w) for w in want]
        assert "message" not in records[2] and records[3]["message"] == "m3"
