"""Keyword rules of any number, from a table.

Rules written in a program become one CASE WHEN, which looks for one keyword after the other. A table of rules becomes
an automaton that finds all keywords in one reading of a text, so time does not grow with the number of rules. The
automaton is made once per worker from keywords that are broadcast, a counted part of the table at a time.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.functions.rules import DEFAULT_INTENT, Rule
from colloquy.operators.tagging import lowered_name, with_lowered

# Keywords of one pass over the texts.
KEYWORDS = 1_000_000
# Texts that are Python strings at a time; a batch has as many rows as Spark gives it.
TEXTS = 500
BEST = "struct<priority: bigint, label: string>"


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """(priority, label, keyword) of rules in a program, the first one first."""
    rows = [(i, r.label, k) for i, r in enumerate(rules) for k in r.keywords]
    return spark.createDataFrame(rows, "priority BIGINT, label STRING, keyword STRING")


def tag_by_table(
    messages: DataFrame,
    rules: DataFrame,
    default: str | None = DEFAULT_INTENT,
    text: str = "message",
    into: str = "intent",
    keywords: int = KEYWORDS,
) -> DataFrame:
    """Messages with the label of the rule of least priority that has a keyword in the lower-cased text, else `default`;
    of equal priorities the lesser label counts. `rules` has (priority, label, keyword).

    Keywords are plain substrings, as in `tag_intent`; an empty one is in every text, and a null text has none. Rules are
    counted and collected, up to `keywords` of them for a pass; more take as many passes as it needs. Only the text
    crosses to Python, no shuffle of messages.
    """
    best = rules.where(F.col("keyword").isNotNull() & F.col("priority").isNotNull()).groupBy("keyword").agg(
        F.min(F.struct(F.col("priority").cast("long").alias("priority"), F.col("label").alias("label"))).alias("best")
    )
    parts = max(1, -(-best.count() // keywords))
    dealt = best.withColumn("_part", F.pmod(F.xxhash64("keyword"), F.lit(parts)))
    given = with_lowered(messages, text)
    lowered, found = F.col(lowered_name(text)), None
    for part in range(parts):
        rows = dealt.where(F.col("_part") == part).select("keyword", "best.priority", "best.label").collect()
        one = _finder(messages, [tuple(r) for r in rows])(lowered)
        found = one if found is None else F.array_min(F.filter(F.array(found, one), lambda b: b["priority"].isNotNull()))
    tagged = given.withColumn("_best", found)
    hit = F.col("_best.priority").isNotNull()
    result = tagged.withColumn(into, F.when(hit, F.col("_best.label")).otherwise(F.lit(default).cast("string"))).drop("_best")
    return result if lowered_name(text) in messages.columns else result.drop(lowered_name(text))


def _finder(messages: DataFrame, rows: list[tuple[str, int, str]]):
    """Function that gives the best rule of each text."""
    # In the order of their rank, so that a smaller number is a better rule.
    ranked = sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or ""))
    shared, name = messages.sparkSession.sparkContext.broadcast(ranked), uuid.uuid4().hex

    def automaton():
        import ahocorasick

        # Kept at the library, which stays loaded in a worker; the function travels anew with each task. A worker takes turns
        # between the passes, so those stay that have `KEYWORDS` keywords together.
        kept = ahocorasick.__dict__.setdefault("_kept_rules", {})
        if name not in kept:
            made = ahocorasick.Automaton()
            for rank, (keyword, _, _) in enumerate(shared.value):
                if keyword:
                    made.add_word(keyword, rank)
            if len(made):
                made.make_automaton()
            always = next((i for i, r in enumerate(shared.value) if r[0] == ""), None)
            while kept and sum(len(k[0]) for k in kept.values()) + len(made) > most:
                kept.pop(next(iter(kept)))
            kept[name] = (made, always)
        return kept[name]

    def find(texts: pa.Array) -> pa.Array:
        made, always = automaton()
        rules, priorities, labels = shared.value, [], []
        for at in range(0, len(texts), rows_at_once):
            for text in texts.slice(at, rows_at_once).to_pylist():
                rank = None
                if text is not None:
                    rank = min((r for _, r in made.iter(text)), default=None) if len(made) else None
                    if always is not None and (rank is None or always < rank):
                        rank = always
                priorities.append(None if rank is None else rules[rank][1])
                labels.append(None if rank is None else rules[rank][2])
        return pa.StructArray.from_arrays([pa.array(priorities, pa.int64()), pa.array(labels, pa.string())], ["priority", "label"])

    most, rows_at_once = KEYWORDS, TEXTS
    return F.arrow_udf(find, BEST)
