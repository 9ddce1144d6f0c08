"""Rules from a table against the rules of a program, and against a look at every keyword."""

import random

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

from colloquy.functions.rules import INTENT_RULES
from colloquy.operators import rule_table as table_of_rules
from colloquy.operators.rule_table import rule_table, tag_by_table
from colloquy.operators.tagging import tag_intent

RULES = "priority BIGINT, label STRING, keyword STRING"


def plain(text, rules, default):
    hits = [(p, l is not None, l or "") for p, l, k in rules if k is not None and p is not None and k in text.lower()]
    return default if not hits else (min(hits)[2] if min(hits)[1] else None)


def test_a_table_of_the_default_rules_is_their_chain(spark):
    words = [k for r in INTENT_RULES for k in r.keywords] + ["Hospital", "entire", "x", "What  is", ""]
    dice = random.Random(1)
    texts = [" ".join(dice.choices(words, k=dice.randrange(4))).title() for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id INT, message STRING, intent_ STRING")
    got = tag_by_table(rows, rule_table(spark, INTENT_RULES))
    assert got.columns == [*rows.columns, "intent"]
    assert got.exceptAll(tag_intent(rows)).isEmpty() and got.count() == 302


def test_many_keywords(spark):
    dice = random.Random(2)
    word = lambda n: "".join(dice.choices("abcdefgh", k=n))
    rules = [(dice.randrange(5000), f"l{dice.randrange(300)}", word(dice.choice([6, 7, 8, 9]))) for _ in range(100_000)]
    texts = [word(dice.choice([0, 5, 40, 200])).upper() for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "message STRING")
    table = spark.createDataFrame(rules, RULES)
    want = sorted((t, plain(t, rules, "none")) for t in texts)
    assert len({w for _, w in want}) > 20
    assert sorted(map(tuple, tag_by_table(rows, table, "none").collect())) == want
    # In three passes.
    assert sorted(map(tuple, tag_by_table(rows, table, "none", keywords=40_000).collect())) == want


def test_awkward_rules(spark):
    rows = spark.createDataFrame([("Ab",), ("",), (None,), ("é😀",)], "message STRING")
    cases = [
        [],
        [(1, "x", None), (None, "y", "ab")],
        [(5, "every", ""), (1, "ab", "ab"), (1, "aa", "a")],
        [(0, None, "b"), (0, "z", "a"), (2, "face", "😀"), (2, "é", "é")],
        [(3, "same", "ab"), (2, "less", "ab")],
    ]
    for rules in cases:
        got = {r["message"]: r["intent"] for r in tag_by_table(rows, spark.createDataFrame(rules, RULES), "-").collect()}
        want = {t: "-" if t is None else plain(t, rules, "-") for t in ("Ab", "", None, "é😀")}
        assert got == want, rules


def test_only_the_text_goes_to_python(spark):
    rows = spark.range(10).select("id", F.lit("pit").alias("message"))
    plan = tag_by_table(rows, rule_table(spark, INTENT_RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_passes_take_turns_in_a_worker_without_making_automata_anew(spark, monkeypatch):
    monkeypatch.setattr(table_of_rules, "TEXTS", 2)
    rows = spark.createDataFrame([("x",)], "message STRING")
    one = table_of_rules._finder(rows, [("ab", 2, "low"), ("abc", 1, None)]).func
    two = table_of_rules._finder(rows, [("", 5, "always"), ("q", 3, "q")]).func
    texts = pa.array(["xabcx", "ab", None, "", "q"])
    ahocorasick.__dict__.pop("_kept_rules", None)
    first = one(texts).to_pylist()
    assert [tuple(r.values()) for r in first] == [(1, None), (2, "low"), (None, None), (None, None), (None, None)]
    assert [tuple(r.values()) for r in two(texts).to_pylist()] == [(5, "always")] * 2 + [(None, None), (5, "always"), (3, "q")]
    made = {k: v[0] for k, v in ahocorasick._kept_rules.items()}
    assert one(texts).to_pylist() == first
    assert len(made) == 2 and all(ahocorasick._kept_rules[k][0] is v for k, v in made.items())
