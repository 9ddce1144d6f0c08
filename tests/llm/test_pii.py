"""Personal data against the base patterns run plainly, and the added kinds and the mask by example."""

import random
import re
import time

from colloquy.llm import pii
from pyspark.sql import functions as F

TEXTS = [
    "mail a.b+c@x-y.example.com, b@c@d.ef @no a@b a@b.c.d@e.fg é@ü.de x%y@z.1",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3 1..2.3.4 9999.1.2.3.4",
    "4041894974608795 4041 8949 7460 8795 4041-8949-7460-8795 4041  8949 1 2 3 40418949746087954041",
    "+1 (988) 555-2485 +44 20 7946 0958. ++49 30 123456 +1+2345678901 +123 +1234567890123456 5",
    "card 4041894974608795 1.2.3.4 5 mixed 4041894974608795-1",
    "7" * 4_000,
    "1." * 4_000,
    "a@" * 4_000 + "b.c",
]


def plain(text):
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(digits) <= 19:
            doubled = [d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))]
            if sum(doubled) % 10 == 0:
                found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def base(text):
    return [tuple(s) for s in pii.find(text, ANCHORS) if s.rank < 4]


ANCHORS = pii.automaton()


def test_base_equals_plain_patterns(awkward):
    docs = awkward(TEXTS)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.find_personal(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        got = [(f["start"], pii.KINDS.index(f["kind"]), f["end"]) for f in r["findings"] if f["kind"] in pii.BASE_KINDS]
        assert sorted(got) == plain(texts[r["doc_id"]]), r["doc_id"]


def test_base_equals_plain_patterns_on_random_texts():
    dice = random.Random(5)
    for _ in range(20_000):
        text = "".join(dice.choice("aB1+23@.-. ()45%é7890") for _ in range(dice.randrange(40)))
        assert base(text) == plain(text), text
    for _ in range(20_000):
        text = "".join(dice.choice("0123456789.- +") for _ in range(dice.randrange(45)))
        assert base(text) == plain(text), text


def test_added_kinds():
    text = (
        "IBAN DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 not DE89370400440532013001; "
        "ssn 078-05-1120, no 000-12-3456 or 1-078-05-1120; Account number: 123456789 account 12; "
        "ftp://me:secret@host.example/x http://www.apache.org/licenses"
    )
    got = [(pii.KINDS[s.rank], text[s.start : s.end]) for s in pii.find(text, ANCHORS) if s.rank > 3]
    assert got == [
        ("iban", "DE89 3704 0044 0532 0130 00"),
        ("iban", "GB82WEST12345698765432"),
        ("ssn", "078-05-1120"),
        ("account", "123456789"),
        ("login", "me:secret@host.example"),
    ]


def test_mask(spark):
    rows = [(1, "to a@b.cd or 1.2.3.4.", "x", 5), (2, None, "y", 0), (3, "clean", "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, findings STRING, n_chars LONG")
    got = {r["doc_id"]: tuple(r)[1:] for r in pii.mask(docs, length="n_chars").collect()}
    assert got == {1: ("to [EMAIL] or [IP].", "x", 19), 2: (None, "y", None), 3: ("clean", "z", 5)}


def test_mask_leaves_nothing_to_find(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id LONG, text STRING")
    left = pii.find_personal(pii.mask(docs)).where(F.size("findings") > 0).collect()
    assert [r["doc_id"] for r in left] == []


def test_long_runs_take_linear_time():
    began = time.perf_counter()
    for text in ("7" * 500_000, "1." * 250_000, "a@" * 250_000, "+1" * 250_000, "1 " * 250_000):
        pii.find(text, ANCHORS)
    assert time.perf_counter() - began < 30


def test_empty_table(no_documents):
    assert pii.find_personal(no_documents).count() == 0
    assert pii.mask(no_documents).count() == 0
