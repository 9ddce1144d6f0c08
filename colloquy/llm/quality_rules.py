"""Rules on the surface of a text, from a table of thresholds.

Each rule is a row (metric, least, most). `quality_rules` compiles the table into one projection: the metrics that
some rule or the caller asks for, a flag per rule, and the verdict. There are no user functions and no shuffles.

Defined results: a null text is empty; an empty text has no words and fails; rows are judged one by one, so
repeated rows get equal results; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

# The white space that parts words, and the characters counted as symbols.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

# Very common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was on are with as be by this from or an "
    "le la les de des et un une du en que qui est pour dans par sur pas au avec "
    "der die das und in zu den von mit ist des im für nicht ein eine als auch es sich "
    "el la los las de y que en un una del se por con no para su al lo"
).split()


class Rule(NamedTuple):
    """A text passes while least <= metric <= most; a missing bound is open."""

    metric: str
    least: float | None = None
    most: float | None = None


# The first two are the base of the verdict; n_repeat_words and n_words are whole numbers, so nothing is rounded.
BASE_RULES = (Rule("n_words", least=10), Rule("repeat_percent", most=20))
RULES = (
    Rule("mean_word_chars", least=2, most=12),
    Rule("symbol_ratio", most=0.2),
    Rule("upper_ratio", most=0.5),
    Rule("alpha_ratio", least=0.6),
    Rule("dup_line_ratio", most=0.4),
    Rule("bullet_line_ratio", most=0.9),
    Rule("ellipsis_line_ratio", most=0.3),
    Rule("stop_words", least=1),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def _same(a: Column, b: Column) -> Column:
    same = F.lit(True)
    for i in range(WINDOW):
        same = same & (a[str(i)] == b[str(i)])
    return same


def with_repeats(texts: DataFrame, words: str, into: str) -> DataFrame:
    """Adds the number of words inside windows of five words that the text has twice or more.

    Hashes of the windows are sorted as plain numbers; only a text with equal hashes goes on to have its windows
    themselves sorted and compared, so the count is exact.
    """
    w = F.col(words)
    n = F.size(w)
    places = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    many = n >= WINDOW + 1
    hashed = texts.withColumn("_hashes", F.when(many, F.sort_array(hashes)))
    h = F.col("_hashes")
    hit = F.exists(F.sequence(F.lit(1), F.size(h) - 1), lambda i: F.get(h, i) == F.get(h, i - 1))
    # A text has equal windows or not; few do, and only they are taken apart.
    marked = hashed.withColumn("_hit", F.coalesce(F.when(many, hit), F.lit(False)))
    shifted = [F.slice(w, k + 1, n - WINDOW + 1) for k in range(WINDOW)]
    windows = F.arrays_zip(*[s.alias(str(k)) for k, s in enumerate(shifted)], places.alias("at"))
    names = [*map(str, range(WINDOW)), "at"]
    kind = "array<struct<" + ",".join(f"`{c}`:{'int' if c == 'at' else 'string'}" for c in names) + ">>"
    ordered = marked.withColumn("_windows", F.when(F.col("_hit"), F.sort_array(windows.cast(kind))))
    s = F.col("_windows")

    def equal(x: Column, i: Column) -> Column:
        near = [F.coalesce(_same(x, F.get(s, i + d)), F.lit(False)) for d in (-1, 1)]
        return near[0] | near[1]

    repeated = ordered.withColumn(
        "_at", F.sort_array(F.transform(F.filter(s, equal), lambda x: x["at"]))
    )
    at = F.col("_at")
    # Each window adds what it has before the next one starts.
    steps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
    count = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return repeated.withColumn(into, F.coalesce(count, F.lit(0).cast("long"))).drop(
        "_hashes", "_hit", "_windows", "_at"
    )


def metrics(texts: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, every metric that a rule may name)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = texts.select(F.col(id).alias("_id"), whole.alias("_text"))
    split = read.withColumn("_words", F.filter(F.split("_text", GAP), lambda x: x != "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    counted = with_repeats(split, "_words", "n_repeat_words")
    words, lines = F.col("_words"), F.col("_lines")
    n_words, n_lines = F.size(words).cast("long"), F.size(lines).cast("long")
    within = lambda test: F.size(F.filter(words, test)).cast("long")
    lines_with = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("long")
    stops = F.array(*[F.lit(x) for x in sorted(set(STOP_WORDS))])
    parts = counted.select(
        F.col("_id").alias(id),
        n_words.alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (n_lines - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        n_lines.alias("_n_lines"),
        within(lambda x: x.rlike(r"\p{Lu}.*\p{Lu}") & ~x.rlike(r"\p{Ll}")).alias("_n_upper"),
        within(lambda x: x.rlike(r"\p{L}")).alias("_n_alpha"),
        F.size(F.array_intersect(F.transform(words, F.lower), stops)).alias("stop_words"),
        lines_with(r"^\s*(?:[-*•]\s|[0-9]+[.)]\s)").alias("_n_bullets"),
        lines_with(r"(?:\.\.\.|…)\s*$").alias("_n_ellipses"),
    )
    c = F.col
    return parts.select(
        id,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "stop_words",
        _ratio(100 * c("n_repeat_words"), c("n_words")).alias("repeat_percent"),
        _ratio(c("word_chars"), c("n_words")).alias("mean_word_chars"),
        _ratio(c("n_symbols"), c("word_chars")).alias("symbol_ratio"),
        _ratio(c("_n_upper"), c("n_words")).alias("upper_ratio"),
        _ratio(c("_n_alpha"), c("n_words")).alias("alpha_ratio"),
        _ratio(c("n_dup_lines"), c("_n_lines")).alias("dup_line_ratio"),
        _ratio(c("_n_bullets"), c("_n_lines")).alias("bullet_line_ratio"),
        _ratio(c("_n_ellipses"), c("_n_lines")).alias("ellipsis_line_ratio"),
    )


def passes(rules: Sequence[Rule]) -> Column:
    """The table of thresholds as one condition."""
    whole = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            whole = whole & (F.col(rule.metric) >= rule.least)
        if rule.most is not None:
            whole = whole & (F.col(rule.metric) <= rule.most)
    return whole


def quality_rules(
    texts: DataFrame,
    base: Sequence[Rule] = BASE_RULES,
    rules: Sequence[Rule] = RULES,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, metrics, `failed` names of the broken rules, base_failed, kept)."""
    measured = metrics(texts, id, text)
    broken = [F.when(~passes([rule]), F.lit(rule.metric)) for rule in (*base, *rules)]
    return measured.withColumns(
        {
            "base_failed": ~passes(base),
            "kept": passes(base) & passes(rules),
            "failed": F.array_compact(F.array(*broken)),
        }
    )
