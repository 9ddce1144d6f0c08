"""From raw documents to tokens: poor texts go, then near-duplicates, then benchmark passages, personal data is
masked, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`. All stages but the last return the columns
of `docs`; between stages rows are written as Parquet in the shared folder, so that a lost executor costs
no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.llm import decontaminate, near_copies, pii, quality_model, sentencepiece_codec
from colloquy.llm.batches import send_few_rows
from colloquy.llm.catalog import GOOD, model_bytes
from colloquy.sources.shared import new_folder


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels outside the held-out rows, gives label 1."""
    send_few_rows(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels, allowed=~quality_model.held_out(F.col("id")))
    into = "quality"
    while into.lower() in [c.lower() for c in docs.columns]:
        into += "_"
    return quality_model.score(docs, model, *docs.columns, into=into).where(F.col(into) >= GOOD).drop(into)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8 or more.
    Candidates are found by SimHash and, as that does not reach all, by rare shingles."""
    send_few_rows(spark)
    return near_copies.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    send_few_rows(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text."""
    send_few_rows(spark)
    return pii.mask(docs, length="n_chars" if "n_chars" in docs.columns else None)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, tokens, n_differing, round_trip) of all documents: how many words the
    sentencepiece library encodes otherwise, and whether the tokens decode to the text."""
    send_few_rows(spark)
    tokens = sentencepiece_codec.encode(docs, model_bytes(), "doc_id", "lang", "source", verify=True)
    return tokens.select(
        "doc_id", "lang", "source", F.size("tokens").alias("n_tokens"), "tokens", "n_differing", "round_trip"
    )


STAGES = [
    ("quality_classifier", good_texts),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", without_benchmarks),
    ("pii", masked),
    ("sentencepiece", encoded),
]

# The classifier is learned and the stages after it work on what it keeps: tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{number}-{name}")
            docs = spark.read.parquet(f"{folder}/{number}-{name}")
    return docs
