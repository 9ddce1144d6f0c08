"""Every registered query against its SQL over the same tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# The given conversations name no entities, every session of events has a forecast, and a user turn that another turn
# follows is answered. State over entities is checked on texts made of events, see `running_state`.
NO_ENTITIES = {"forecast_albon", "forecast_sainz", "position_albon", "position_sainz"}
CONSTANT = {
    "snapshots": {"forecast_text"},
    "streamed_snapshots": {"forecast_text"},
    "conversation_snapshots": NO_ENTITIES | {"forecast_text"},
    "conversation_pipeline": NO_ENTITIES | {"mode"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    result = duck.execute(catalog.SQL[name])
    assert sorted(c[0] for c in result.description) == columns
    places = [[c[0] for c in result.description].index(c) for c in columns]
    expected = Counter(tuple(r[i] for i in places) for r in result.fetchall())
    assert sum(got.values()) > 0
    assert got == expected
    # A column that is the same in all rows would check nothing; those named are constant in the given tables.
    constant = {c for i, c in enumerate(columns) if len({r[i] for r in got}) == 1}
    assert constant <= CONSTANT.get(name, set())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["conv_id", "turn", "message", "reply", "answered", "intent", "label"]
    assert df.count() > 0
