"""Maps of entities against the columns of a few, and with thousands."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators.entities import forecast_map, position_map, session_snapshot_by_map
from colloquy.operators.session import session_snapshot
from colloquy.operators.tagging import extract_forecast, extract_positions

PARTS = ["Albon", "albon", "SAINZ", "Sainz", " p{n}", "#{n}", " {n} ", "P{n}", "\n", "\u2028", " lap ", "Albonx", "p", ", "]


def said(spark, n=600):
    dice = random.Random(3)
    text = lambda: "".join(dice.choices(PARTS, k=dice.randrange(9))).format(n=dice.randrange(30))
    rows = [(i % 17 if i % 5 else None, i, text(), text() if i % 7 else None, i % 7 > 0) for i in range(n)]
    return spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, message STRING, reply STRING, answered BOOLEAN")


def test_maps_hold_what_columns_hold(spark):
    rows = said(spark)
    two = ["Albon", "Sainz"]
    columns = extract_positions(extract_forecast(rows, two), two)
    maps = position_map(forecast_map(rows, two), two)
    read = maps.select(
        *rows.columns,
        *[F.try_element_at("forecast", F.lit(e)).alias(f"forecast_{e.lower()}") for e in two],
        *[F.try_element_at("positions", F.lit(e)).alias(f"position_{e.lower()}") for e in two],
    )
    assert columns.where("forecast_albon IS NOT NULL").count() > 10
    assert read.exceptAll(columns).isEmpty() and columns.exceptAll(read).isEmpty()


@pytest.mark.parametrize("more", [0, 4998])
def test_snapshots_by_map(spark, more):
    rows = said(spark)
    entities = ["Albon", *[f"Nobody.{i}" for i in range(more)], "Sainz"]
    want = {}
    for r in session_snapshot(rows).collect():
        forecast = None if r["forecast_albon"] is None else {"Albon": r["forecast_albon"], "Sainz": r["forecast_sainz"]}
        places = {e: r[f"position_{e.lower()}"] for e in ("Albon", "Sainz") if r[f"position_{e.lower()}"] != "—"}
        want[r["conv_id"]] = (r["mode"], forecast, places, r["messages"], r["mode_text"], r["forecast_text"])
    got = {r["conv_id"]: tuple(r)[1:] for r in session_snapshot_by_map(rows, entities).collect()}
    assert got == want


def test_a_forecast_of_three(spark):
    rows = spark.createDataFrame([("a.b p1, c 2 and #3 é",), ("a.b p1 c",), ("axb p1 c 2",)], "message STRING")
    got = [r["forecast"] for r in forecast_map(rows, ["A.b", "C", "É", "zz"], least=2).collect()]
    # A number in front counts from the start of the line, so it is the first one there.
    assert got == [{"A.b": "P1", "C": "P2", "É": "P1"}, {"A.b": "P1", "C": "P1"}, None]


def test_names_must_differ(spark):
    for names in (["a", "a"], [""]):
        with pytest.raises(ValueError):
            position_map(spark.createDataFrame([("x",)], "reply STRING"), names)


def test_names_are_looked_for_together_not_one_by_one(spark):
    rows = spark.createDataFrame([("ABC p1, ab 2", "aBc P3 ab P4 AB P5"), ("", None), (None, "")], "message STRING, reply STRING")
    # Names in one another, names that are equal lower-cased, and more than could be tried for each row.
    entities = ["aB", "AB", "aBc", "ab", *[f"Nobody {i}" for i in range(200_000)]]
    found = position_map(forecast_map(rows, entities), entities).select("forecast", "positions")
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "Nobody 77" not in plan
    got = [tuple(r) for r in found.collect()]
    few = position_map(forecast_map(rows, entities[:4]), entities[:4]).select("forecast", "positions")
    assert got == [tuple(r) for r in few.collect()]
    assert got[0][1] == {"aB": "P3", "aBc": "P3", "ab": "P4", "AB": "P5"}
    assert set(got[0][0]) == {"aB", "AB", "aBc", "ab"}
