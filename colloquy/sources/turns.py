"""Reading conversation logs, writing transcripts and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colloquy.operators.chunks import Chunks

TURN_SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
# Role names of the log and the role they stand for; other roles are not part of a conversation.
ROLES = {"user": "user", "assistant": "ai", "ai": "ai"}


def known_turns(turns: DataFrame) -> DataFrame:
    """Turns of known roles, under the names user and ai."""
    role = F.col("role")
    named = role
    for found, name in ROLES.items():
        if found != name:
            named = F.when(role == found, name).otherwise(named)
    return turns.where(role.isin(*ROLES)).select("conv_id", "turn", named.alias("role"), "text")


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    return known_turns(spark.read.schema(TURN_SCHEMA).parquet(path))


def stream_files(
    spark: SparkSession, folder: str, schema, files: str = "*.parquet", per_batch: int = 1000
) -> DataFrame:
    """Parquet files of a folder as they arrive; `per_batch` bounds what one micro-batch takes on. `files` is a pattern
    of file names, or the name of one table of the folder, be it a file or a folder of files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch)
    if any(c in files for c in "*?[{"):
        return reader.option("pathGlobFilter", files).parquet(folder)
    # A source takes a single file only where its path is a pattern, which this one is by its first letter.
    return reader.parquet(f"{folder}/[{files[0]}]{files[1:]}")


def stream_turns(
    spark: SparkSession, folder: str, files: str = "*.parquet", per_batch: int = 1000
) -> DataFrame:
    return known_turns(stream_files(spark, folder, TURN_SCHEMA, files, per_batch))


def write_by_conversation(turns: DataFrame, table: str, path: str, buckets: int = 200) -> DataFrame:
    """Turns as a table of files by conversation, each in reading order, and the table read back.

    Jobs over it that work per conversation find their rows together and shuffle nothing, however many there are of
    them: the one shuffle is here. A conversation is in one file, so one that is too large for a task is better left
    to `turn_chunks` and the plain layout.
    """
    placed = turns.repartition(buckets, "conv_id")
    files = placed.write.bucketBy(buckets, "conv_id").sortBy("conv_id", "turn").option("path", path)
    files.saveAsTable(table, format="parquet")
    return turns.sparkSession.table(table)


def write_transcript(
    transcript: DataFrame, path: str, buckets: int | None = None, chunks: Chunks | None = None
) -> None:
    """Transcript by conversation bucket, each file in reading order.

    By default there are as many buckets as shuffle partitions, and they agree with the partitioning by
    conversation that the transcript comes with: rows are sorted where they are, and a task writes its
    bucket. Where `chunks` says that conversations were cut, or with another number of buckets, rows are
    range partitioned down to the message, and a long conversation fills several files.
    """
    partitions = int(transcript.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = buckets or partitions
    order = ["bucket", "conv_id", "number"]
    bucketed = transcript.withColumn("bucket", F.pmod(F.hash("conv_id"), F.lit(count)))
    if partitions % count or (chunks is not None and chunks.bounds is not None):
        bucketed = bucketed.repartitionByRange(*order)
    bucketed.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)


def write_requests(requests: DataFrame, path: str, record: str = "record") -> None:
    """One JSON document per line."""
    requests.select(record).write.text(path)
