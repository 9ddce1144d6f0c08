"""Every registered query of the training-data operators against its SQL over the same tables."""

import hashlib
import os
from collections import Counter

import duckdb
import pytest

from colloquy.llm import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in os.listdir(FOLDER):
        duck.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{FOLDER}/{table}'")
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(r) for r in df.select(*columns).collect())
    result = duck.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    expected = Counter(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert sum(got.values()) > 0
    assert got == expected
    # A column that is the same in all rows would check nothing; test_planted.py has what the smallest table lacks.
    constant = {c for i, c in enumerate(columns) if len({r[i] for r in got}) == 1}
    assert constant <= {"op1_secrets": {"n_access", "n_assign", "n_hex", "base_sha256", "spans"}}.get(name, set())


# Name and types of what each contract asks for, and the table that a query has a row of each of.
SHAPES = {
    "op1_secrets": ("documents", "doc_id:bigint n_assign:bigint n_access:bigint n_hex:bigint base_sha256:string spans:string"),
    "op2_main_text": ("pages", "page_id:bigint url:string text:string n_chars:bigint"),
    "op3_quality_rules": (
        "documents",
        "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint "
        "base_failed:boolean kept:boolean",
    ),
    "op4_sentencepiece": ("documents", "doc_id:bigint n_tokens:bigint tokens_sha256:string round_trip:boolean"),
    "op5_quality_classifier": ("documents", "doc_id:bigint held_out:boolean score:double predicted:int"),
    "op6_simhash": ("documents", "doc_id:bigint fingerprint:string component_id:bigint"),
    "op7_personal_data": (
        "documents",
        "doc_id:bigint n_email:bigint n_ip:bigint n_card:bigint n_phone:bigint base_sha256:string spans:string",
    ),
    "op8_chat_format": (
        None,
        "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    ),
    "op9_suffix_dedup": (
        "documents",
        "doc_id:bigint n_bytes:bigint n_removed:bigint n_spans:bigint kept_sha256:string",
    ),
    "op12_mix": ("documents", "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint"),
}


@pytest.mark.parametrize("name", list(SHAPES))
def test_query_has_its_columns_and_all_rows(spark, name):
    table, columns = SHAPES[name]
    df = catalog.QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    for column in columns.split():
        field, kind = column.split(":")
        assert kinds[field] == kind
    rows = df.collect()
    assert all(r[c.split(":")[0]] is not None for r in rows for c in columns.split())
    if table:
        assert len(rows) == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_personal_data_query_equals_plain_patterns(spark):
    from test_pii import plain

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    kinds = ("email", "ip", "card", "phone")
    for r in catalog.QUERIES["op7_personal_data"](spark, FOLDER).collect():
        want = plain(texts[r["doc_id"]])
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(w[1] == i for w in want) for i in range(4)]
