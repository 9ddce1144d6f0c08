"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, schemes and cue
words. Around each anchor a small parser looks for the boundaries of what it may belong to and validates it. The
parsers of a kind go from left to right and none begins inside what the last one took.

Base kinds are email, ip, card and phone. Added are `iban` (checked by its remainder), `ssn` (the dashed form,
checked by its ranges), `account` (6 to 17 digits after a cue word) and `login` (a name and password in a URL).

Defined results: a null text is empty and has no findings; equal rows get equal findings; an empty table gives an
empty result; only the id and the text are read, and `mask` leaves all other columns as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from colloquy.llm.batches import few_rows

# The base patterns. Repeats that cannot give back are possessive, which changes no match.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Public shapes of the added kinds.
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
ACCOUNT = re.compile(r"(?:\x20(?:number|no\.?|nr\.?))?\x20?[:#]?\x20?([0-9]{6,17})(?![0-9])")
LOGIN = re.compile(r"[A-Za-z0-9._%+-]++:[^\s/@:]++@[A-Za-z0-9.-]++")

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "login")
BASE_KINDS = KINDS[:4]
CUES = ("account", "acct", "konto", "compte", "cuenta")
SCHEMES = ("https", "http", "ftp")


class Span(NamedTuple):
    start: int
    rank: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    turned = code[4:] + code[:4]
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def automaton():
    """Anchors and what each is a sign of."""
    import ahocorasick

    anchors = ahocorasick.Automaton()
    anchors.add_word("@", ("at", 1))
    anchors.add_word("+", ("plus", 1))
    for d in "0123456789":
        anchors.add_word(d, ("digit", 1))
    for scheme in SCHEMES:
        anchors.add_word(f"{scheme}://", ("scheme", len(scheme) + 3))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            anchors.add_word(form, ("cue", len(form)))
    anchors.make_automaton()
    return anchors


def find(text: str, anchors) -> list[Span]:
    """All spans in order of place, then kind; ends are exclusive."""
    found: list[Span] = []
    # Where the next match of a kind may begin, and what has been looked at.
    email = ip = card = phone = iban = ssn = 0
    after_at = after_digits = after_card = 0
    for last, (sign, size) in anchors.iter(text):
        at = last + 1 - size
        if sign == "digit":
            if at >= max(card, after_card):
                m = CARD.match(text, at)
                # A lone digit is no match, and the run of digits that holds it has been seen whole.
                after_card = at + 1
                if m:
                    card = m.end()
                    digits = re.sub("[^0-9]", "", m[0])
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append(Span(at, 2, card))
            if at >= max(ip, after_digits):
                m = IP.match(text, at)
                if m:
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        found.append(Span(at, 1, ip))
                else:
                    after_digits = at + 1
                    while after_digits < len(text) and "0" <= text[after_digits] <= "9":
                        after_digits += 1
            free = at == 0 or not (text[at - 1].isalnum() or text[at - 1] in "-_")
            if free and at >= ssn and (m := SSN.match(text, at)):
                ssn = m.end()
                found.append(Span(at, 5, ssn))
            if at >= 2 and at - 2 >= iban and text[at - 2 : at].isascii() and text[at - 2 : at].isupper():
                if (at == 2 or not text[at - 3].isalnum()) and (m := IBAN.match(text, at - 2)):
                    if iban_valid(m[0].replace(" ", "")):
                        iban = m.end()
                        found.append(Span(at - 2, 4, iban))
        elif sign == "at":
            low = max(email, after_at)
            start = low + len(text[low:at].rstrip(LOCAL))
            after_at = at + 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                found.append(Span(start, 0, email))
        elif sign == "plus":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append(Span(at, 3, phone))
        elif sign == "cue":
            if (at == 0 or not text[at - 1].isalnum()) and (m := ACCOUNT.match(text, last + 1)):
                found.append(Span(m.start(1), 6, m.end(1)))
        elif m := LOGIN.match(text, last + 1):
            found.append(Span(last + 1, 7, m.end()))
    return sorted(found)


FINDINGS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))


def find_personal(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, findings) of every row, one pass without a shuffle."""
    read = texts.select(F.col(id), F.col(text).cast("string").alias("_t"))
    return read.mapInArrow(_finder(1, id), read.select(id).schema.add("findings", FINDINGS))


def _finder(column: int, *kept: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in few_rows(batches):
            found = [
                [{"kind": KINDS[s.rank], "start": s.start, "end": s.end} for s in find(t.as_py() or "", anchors)]
                for t in batch.column(column)
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(kept))], pa.array(found, kind)], [*kept, "findings"]
            )

    return run


def masked_text(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, rank, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1].start < end:
            i += 1
            end = max(end, spans[i].end)
        out += [text[at:start], f"[{KINDS[rank].upper()}]"]
        at, i = end, i + 1
    return "".join(out) + text[at:]


def masked_whole(text: str, anchors) -> str:
    """Masked until nothing is found: what one mask cuts short may be a match by itself."""
    while found := find(text, anchors):
        text = masked_text(text, found)
    return text


def mask(texts: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """All rows and columns, with personal data in `text` replaced; `length` names a column of its length to renew.
    A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in few_rows(batches):
            at = batch.schema.get_field_index(text)
            new = [None if t is None else masked_whole(t, anchors) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    result = texts.mapInArrow(run, texts.schema)
    if length:
        result = result.withColumn(length, F.length(text).cast(texts.schema[length].dataType))
    return result


def spans(findings: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of each finding, joined by commas."""
    kept = F.filter(findings, lambda x: x["kind"].isin(*kinds))
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(kept, one), ",")


def count_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")
