"""Secrets in every version of a file, each text scanned once per rule version.

A text is addressed by the SHA-256 of its content. The ledger holds a row per scan: the address, the rule versions
that were run, and what they found. A scan joins the addresses it is given with the ledger, runs on each text only
the rule versions that the ledger lacks, appends a row, and joins all findings back to every path and version
that holds the text.

Everything is DataFrame operations. Places of matches come from the lengths of the text between them, which
`split` gives, and of the matches, summed along the text.

Defined results: a null text is empty and has no findings; equal versions share one scan and each get the findings;
a null path or version is kept as it is; an empty table gives an empty result and adds nothing to the ledger;
columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F


class Rule(NamedTuple):
    """Leftmost matches of `pattern` that do not overlap; one counts if `group` has `least` characters.

    A new version of a rule is run again on all texts. `cue` is a cheap pattern that every text with a match has.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    cue: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds in their order.
BASE_RULES = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))" r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        cue=r"(?i:password|passwd|secret|token|api_?key)",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, cue=r"AKIA[A-Z0-9]{16}"),
    # A run below 24 characters is no match anyway, so asking for 24 leaves the same ones.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", least=24),
)
# Public shapes of further credentials.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", cue=r"PRIVATE KEY-----"),
    Rule("forge", r"\bgh[pousr]_[A-Za-z0-9]{36,}+", version=2, cue=r"gh[pousr]_[A-Za-z0-9]"),
    Rule("chat", r"\bxox[abprs]-[A-Za-z0-9-]{10,}+", version=2, cue=r"xox[abprs]-"),
    Rule(
        "jwt",
        r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}",
        cue=r"eyJ[A-Za-z0-9_-]{8}",
    ),
)
RULES = BASE_RULES + MORE_RULES

LEDGER = (
    "blob STRING, rules ARRAY<STRING>, "
    "findings ARRAY<STRUCT<rule: STRING, rank: INT, kind: STRING, start: BIGINT, end: BIGINT>>"
)


def address(text: Column) -> Column:
    return F.sha2(text, 256)


def _pieces(text: Column, rule: Rule, rank: int) -> Column:
    """Per match the length of the text before it since the last one, its own, and whether it counts."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    group = whole if not rule.group else F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length
    )
    zipped = F.filter(F.arrays_zip(gaps.alias("gap"), whole.alias("size"), group.alias("part")), lambda x: x["size"].isNotNull())
    shaped = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(rule.name).alias("rule"),
            F.lit(rank).alias("rank"),
            F.lit(rule.kind).alias("kind"),
            i.alias("nth"),
            x["gap"].alias("gap"),
            x["size"].alias("size"),
            (x["part"] >= rule.least).alias("counts"),
        ),
    )
    return F.when(text.rlike(rule.cue or rule.pattern), shaped).otherwise(F.array().cast(PIECES))


PIECES = (
    "array<struct<rule:string,rank:int,kind:string,nth:int,gap:int,size:int,counts:boolean>>"
)


def scan_blobs(blobs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """New ledger rows for (blob, text, seen), one row per blob; `seen` lists rule versions already run on it."""
    text, seen = F.col("text"), F.col("seen")
    due = lambda rule: ~F.array_contains(seen, rule.name)
    pieces = F.concat(
        *[F.when(due(r), _pieces(text, r, i)).otherwise(F.array().cast(PIECES)) for i, r in enumerate(rules)]
    )
    run = F.array_compact(F.array(*[F.when(due(r), F.lit(r.name)) for r in rules]))
    found = blobs.select("blob", run.alias("rules"), pieces.alias("pieces")).select(
        "blob", "rules", F.explode_outer("pieces").alias("p")
    )
    along = Window.partitionBy("blob", "p.rule").orderBy("p.nth")
    size = F.col("p.size").cast("long")
    end = F.sum(F.col("p.gap") + size).over(along)
    placed = found.select("blob", "rules", "p", end.alias("end"))
    finding = F.struct("p.rule", "p.rank", "p.kind", (F.col("end") - size).alias("start"), "end")
    return placed.groupBy("blob").agg(
        F.first("rules").alias("rules"),
        F.collect_list(F.when(F.col("p.counts"), finding)).alias("findings"),
    )


def pending(versions: DataFrame, ledger: DataFrame | None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, text, seen) of the texts on which some rule version has not been run, one row each.

    `versions` has (blob, text). Copies are put together before the shuffle, so a text that fills a third of the
    table crosses it a few times only.
    """
    unique = versions.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is None:
        return unique.withColumn("seen", F.array().cast("array<string>"))
    done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    known = unique.join(done, "blob", "left").withColumn(
        "seen", F.coalesce("seen", F.array().cast("array<string>"))
    )
    return known.where(F.size(F.array_except(F.array(*[F.lit(r.name) for r in rules]), "seen")) > 0)


def scan_versions(
    versions: DataFrame,
    ledger_path: str,
    rules: Sequence[Rule] = RULES,
    path: str = "path",
    version: str | None = "version",
    text: str = "text",
) -> DataFrame:
    """Findings of every version: (path, [version,] findings), after the ledger at `ledger_path` has been brought
    up to date.

    A ledger row tells by itself what was run on which text, so rows of an append that broke off are right as far
    as they go, and the next call runs what is missing.
    """
    spark = versions.sparkSession
    names = [path, *([version] if version else [])]
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(names)]
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    addressed = versions.select(*keys, content.alias("text")).withColumn("blob", address(F.col("text")))
    before = read_ledger(spark, ledger_path)
    fresh = pending(addressed.select("blob", "text"), before, rules)
    scan_blobs(fresh, rules).write.mode("append").parquet(ledger_path)
    return findings_of(addressed.drop("text"), read_ledger(spark, ledger_path), rules).select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)], "findings"
    )


def read_ledger(spark, ledger_path: str) -> DataFrame | None:
    """The ledger, or None where there is none yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger_path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(LEDGER).parquet(ledger_path)


def findings_of(addressed: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`addressed` rows with `findings` of the given rule versions, in order of place, then rule.

    Only texts with findings go into the join, and its skew is left to the engine: a text that fills a third of the
    table is one row on the other side.
    """
    wanted = F.array(*[F.lit(r.name) for r in rules])
    kinds = {r.name: i for i, r in enumerate(rules)}
    rank = F.coalesce(*[F.when(F.col("f.rule") == n, F.lit(i)) for n, i in kinds.items()])
    found = (
        ledger.where(F.size("findings") > 0)
        .select("blob", F.explode("findings").alias("f"))
        .where(F.array_contains(wanted, F.col("f.rule")))
        .select("blob", F.struct("f.start", rank.alias("rank"), "f.kind", "f.end").alias("f"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_set("f")).alias("findings"))
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return addressed.join(found, "blob", "left").withColumn("findings", F.coalesce("findings", none))


def spans(findings: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end of each finding, joined by commas."""
    kept = findings if kinds is None else F.filter(findings, lambda x: x["kind"].isin(*kinds))
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(kept, one), ",")


def count_of(findings: Column, kind: str) -> Column:
    return F.size(F.filter(findings, lambda x: x["kind"] == kind)).cast("long")
