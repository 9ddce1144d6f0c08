"""Response bodies in, request records out."""

from __future__ import annotations

import json
from typing import NamedTuple, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Reply fields in the order they are tried, and the texts shown without a reply.
REPLY_FIELDS = ("response", "result", "output")
ID_FIELD = "conversationId"
FALLBACK_TEXT = "No response received."
# Outcomes that show the text of a failure.
FAILURES = ("bad_body", "bad_type", "unread")
FAILURE_TEXT = "⚠ Connection issue. Check your API configuration in app.js."


def normalise_payloads(
    bodies: DataFrame,
    body_col: str = "body",
    fields: Sequence[str] = REPLY_FIELDS,
    fallback: str = FALLBACK_TEXT,
    failure: str = FAILURE_TEXT,
    typed_ids: bool = False,
) -> DataFrame:
    """Bodies with `conversation_id`, `reply` and `status`.

    ok: the first field that is not empty, zero, false or null is a string. fallback: there is none.
    bad_type: it is not a string. bad_body: the body is no JSON document, or it is null. unread: it may be one, but
    is nested deeper than the second reader goes.

    Bodies are read as VARIANT; one that this reader rejects, as it does by size, depth or length of a number, is read
    once more by a reader without such limits, so that size decides nothing; to that reader in Python a row that was
    read is a null. Ids that are no strings are handed on as text; with `typed_ids` there is `conversation_id_json` as
    well, the id as it stands in the body, for `request_records` to send back. The session is set to let the last of several equal object keys win, as JSON readers commonly do.
    """
    bodies.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    body = F.col(body_col)
    body = F.when(F.startswith(body, F.lit("\ufeff")), F.substring(body, 2, 2147483647)).otherwise(
        body
    )
    # The parser stops after the first value, so a body is parsed inside brackets: more than one whole document
    # does not fit, unless the body closes the bracket itself. Such a body must fit into braces as well.
    parsed = bodies.withColumn("_list", F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))))
    names = [f"_field{i}" for i in range(len(fields))]
    found = {n: F.try_variant_get("_list", f"$[0]['{f}']", "variant") for n, f in zip(names, fields)}
    found["_id"] = F.try_variant_get("_list", f"$[0]['{ID_FIELD}']", "variant")
    document = F.try_variant_get("_list", "$[0]", "variant")
    in_braces = F.try_parse_json(F.concat(F.lit('{"_":'), body, F.lit("}")))
    readable = (
        F.col("_list").isNotNull()
        & document.isNotNull()
        & ~F.is_variant_null(document)
        & F.try_variant_get("_list", "$[1]", "variant").isNull()
        & (~F.contains(body, F.lit("]")) | in_braces.isNotNull())
    )
    read = parsed.withColumns(found | {"_readable": readable})
    typed = read.withColumns(
        {f"{n}_kind": F.schema_of_variant(n) for n in found}
        | {f"{n}_text": F.try_variant_get(n, "$", "string") for n in found}
    )
    kind, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in reversed(names):
        kind = F.when(_counts(name), F.col(f"{name}_kind")).otherwise(kind)
        text = F.when(_counts(name), F.col(f"{name}_text")).otherwise(text)
    # Rows that were read hand a null to the second reader.
    again = _second_reader(tuple(fields))(F.when(~F.coalesce("_readable", F.lit(False)), body))
    judged = typed.withColumns({"_kind": kind, "_text": text, "_again": again}).withColumns(
        {
            "conversation_id": F.when(F.col("_readable") & _counts("_id"), F.col("_id_text")).otherwise(
                F.col("_again.id")
            ),
            "conversation_id_json": F.when(F.col("_readable") & _counts("_id"), F.to_json("_id")).otherwise(
                F.col("_again.id_json")
            ),
            "status": F.when(~F.col("_readable"), F.coalesce("_again.status", F.lit("bad_body")))
            .when(F.col("_kind").isNull(), "fallback")
            .when(F.col("_kind") == "STRING", "ok")
            .otherwise("bad_type"),
            "_text": F.when(F.col("_readable"), F.col("_text")).otherwise(F.col("_again.reply")),
        }
    )
    reply = (
        F.when(F.col("status") == "ok", F.col("_text"))
        .when(F.col("status") == "fallback", fallback)
        .otherwise(failure)
    )
    ids = ["conversation_id", "conversation_id_json"] if typed_ids else ["conversation_id"]
    return judged.withColumn("reply", reply).select(*bodies.columns, *ids, "reply", "status")


def _counts(name: str) -> Column:
    """Whether a JSON value is present and neither null, "", 0 nor false."""
    kind, text = F.col(f"{name}_kind"), F.col(f"{name}_text")
    empty = (
        F.when(kind == "STRING", text == "")
        .when(kind == "BOOLEAN", text == "false")
        .otherwise((kind == "VOID") | F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    )
    return F.col(name).isNotNull() & ~empty


class _Number(NamedTuple):
    """A number as it is written, which may be longer than numbers get."""

    text: str

    def __bool__(self) -> bool:
        return any(c in "123456789" for c in self.text.lower().partition("e")[0]) and float(self.text) != 0


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def read_again(body: str | None, fields: Sequence[str]) -> dict:
    """status, reply and id of one body, by the rules of `normalise_payloads`."""
    if body is None:
        return {"status": "bad_body", "reply": None, "id": None, "id_json": None}
    try:
        document = json.loads(body, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)
    except ValueError:
        return {"status": "bad_body", "reply": None, "id": None, "id_json": None}
    except RecursionError:
        return {"status": "unread", "reply": None, "id": None, "id_json": None}
    if document is None:
        return {"status": "bad_body", "reply": None, "id": None, "id_json": None}
    known = document if isinstance(document, dict) else {}
    given = known.get(ID_FIELD)
    value = next((known[f] for f in fields if _present(known.get(f))), None)
    return {
        "status": "fallback" if value is None else "ok" if isinstance(value, str) else "bad_type",
        "reply": _sendable(value) if isinstance(value, str) else None,
        "id": _as_text(given) if _present(given) else None,
        "id_json": _as_json(given) if _present(given) else None,
    }


def _present(value) -> bool:
    return bool(value) or isinstance(value, (list, dict))


def _as_text(value) -> str:
    return _sendable(value) if isinstance(value, str) else _as_json(value)


def _as_json(value) -> str:
    """A value as it stood in the body, numbers as they were written."""
    if isinstance(value, _Number):
        return value.text
    if isinstance(value, list):
        return "[" + ",".join(map(_as_json, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{_as_json(k)}:{_as_json(v)}" for k, v in value.items()) + "}"
    return json.dumps(_sendable(value) if isinstance(value, str) else value, ensure_ascii=False)


def _sendable(text: str) -> str:
    """Half of a character pair by itself becomes a question mark."""
    return text.encode("utf-8", "replace").decode()


def _second_reader(fields: tuple[str, ...]):
    def read(bodies: pd.Series) -> pd.DataFrame:
        names = ["status", "reply", "id", "id_json"]
        out = pd.DataFrame(None, index=bodies.index, columns=names, dtype=object)
        rejected = bodies[bodies.notna()]
        if len(rejected):
            out.loc[rejected.index] = pd.DataFrame([read_again(b, fields) for b in rejected], rejected.index, names, object)
        return out

    return F.pandas_udf(read, "status STRING, reply STRING, id STRING, id_json STRING")


def outcome_exchanges(outcomes: DataFrame) -> DataFrame:
    """Normalised payloads as exchanges: a fallback answers, a failure does not, though it is `shown` as well."""
    usable = F.coalesce(F.col("status").isin("ok", "fallback"), F.lit(False))
    return outcomes.withColumns(
        {
            "reply": F.when(usable, F.col("reply")),
            "answered": usable,
            "shown": F.col("status").isNotNull(),
        }
    )


def request_records(
    requests: DataFrame,
    message: str = "message",
    conversation_id: str = "conversation_id",
    into: str = "record",
    typed: bool = False,
) -> DataFrame:
    """Requests with their JSON record, which leaves out a missing or empty session id. With `typed` the id column holds
    JSON, as `conversation_id_json` does, and an id that came as a number is sent back as one."""
    if not typed:
        id = F.nullif(F.col(conversation_id), F.lit(""))
        return requests.withColumn(into, F.to_json(F.struct(F.col(message).alias("message"), id.alias(ID_FIELD))))
    said = F.to_json(F.struct(F.col(message).alias("message")))
    id = F.concat(F.lit(f'"{ID_FIELD}":'), F.nullif(F.nullif(F.col(conversation_id), F.lit("")), F.lit('""')))
    inside = F.concat_ws(",", F.nullif(F.substr(said, F.lit(2), F.length(said) - 2), F.lit("")), id)
    return requests.withColumn(into, F.concat(F.lit("{"), inside, F.lit("}")))
