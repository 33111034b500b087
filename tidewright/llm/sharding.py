"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order and numbered; row k of a source with n rows
gets the fractional rank (2k - 1) / 2n. Sorting all rows by fractional rank interleaves the sources
in proportion, so that any run of neighbouring rows has the mixture of the whole; cutting the order
into equal runs gives shards that match it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, checkpointed, key_bucket, running_total, seeded_key

#: Ranges of the whole order; beyond so many, ranges grow and are sorted with spilling.
MOST_RANGES = 8_192


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, source) with its shard and slot.

    Returns doc_id, source, size, text_crc32, frac (fractional rank), position, shard, slot. Shard
    counts differ by one at most and, per source, by two at most. Both numberings are two-level
    scans, over buckets of the keys of a source and over ranges of the whole order, so that neither a
    hot source, nor very many small ones, nor the whole table meets in one task, and texts are never
    shuffled. A null text has size 1 and checksum 0, as an empty one; null sources are one source
    of their own; repeated rows are all kept, in adjacent order (they are interchangeable); an
    empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    check = F.crc32(body.cast("binary")).cast("long")
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.col("source"), F.lit("")).alias("src"),
        F.col("source").isNull().cast("int").alias("no_src"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        check.alias("text_crc32"),
        seeded_key(seed, F.col("doc_id"), check).alias("key"),  # rows without an id are spread by their texts
        F.lit(1).cast("long").alias("one"),
    )
    total = docs.count()
    n = buckets_for(total)
    rows = rows.withColumn("bucket", key_bucket(F.col("key"), n))
    ties = ["key", "text_crc32", "size"]
    ranked = running_total(rows, ["src", "no_src"], "bucket", ties, "one", "rank", "of")
    ranked = ranked.withColumn("frac", (2 * F.col("rank") + 1) / (2 * F.col("of"))).drop("bucket")
    # sources of few rows share fractions, so buckets of the whole order are ranges of (fraction, source)
    ranges = ranked.repartitionByRange(min(n, MOST_RANGES), "frac", "no_src", "src").withColumn("bucket", F.spark_partition_id().cast("long"))
    placed = running_total(checkpointed(ranges), [], "bucket", ["frac", "no_src", "src", *ties], "one", "position")
    shard = F.floor(F.col("position") * shards / F.lit(max(1, total))).cast("int")
    start = F.ceil(F.col("shard").cast("long") * F.lit(total) / shards).cast("long")
    return (
        placed.withColumn("shard", F.least(F.greatest(shard, F.lit(0)), F.lit(shards - 1)))
        .withColumn("slot", (F.col("position") - start).cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "frac", "position", "shard", "slot")
    )
