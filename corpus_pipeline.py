"""A corpus pipeline: from raw documents to token ids, in five stages.

Each stage takes all that its predecessor kept, and its decisions take effect: toxic documents go;
later copies of line runs are deleted from texts; one document of each near-duplicate class stays;
sources are mixed to their target weights, repetitions included; the rest is encoded.

Nulls, empty and long texts, ties and repeated rows are treated as the operators say; an empty table
of documents gives an empty result, and other columns pass through up to the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import lines, mixing, neardup, pieces, toxicity
from tidewright.llm.common import removed, shared_folder, table
from tidewright.llm.queries import piece_model

#: Rows of an Arrow batch: documents may be long, and executors hold several batches at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Has the session hand documents to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of ``labels`` does not call toxic."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs; those left without a word go."""
    small_batches(spark)
    return lines.without_repeats(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    small_batches(spark)
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus mixed to source targets, a row per repetition."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (little-endian unsigned 32-bit) of every row."""
    small_batches(spark)
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    ids = pieces.encode_documents(rows, piece_model(), id_column="row")
    return ids.select("row.*", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", keep_one_of_each),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Near-duplicate classes and piece encoding are not SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage gives is written to the shared folder and read again.

    What a stage has read is deleted once its successor's input stands; the result stays, for it is read
    when the caller uses it.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if read:
            removed(spark, read)
        read = f"{base}/{name}"
        docs = spark.read.parquet(read)
    return docs
