"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one bucket of a two-level scan holds on average.
BUCKET_ROWS = 50_000

#: What separates words in every operator on words: the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the one the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is taken only where none is set on a local master, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewright-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables of the rounds of a loop, in a shared folder of their own that ``close`` deletes.

    Unlike a checkpoint, a table that is read back has sizes of its own: estimates that multiply in
    each join would double their digits in every round.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/rounds-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        removed(self.spark, self.folder)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over Arrow batches after each of which the memory pool gives back what it no longer uses.

    Python workers stay for later tasks; without this, each holds on to several hundred MB.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return wrapped


def buckets_for(rows: int) -> int:
    """Number of buckets of a two-level scan over ``rows`` rows."""
    return max(1, -(-rows // BUCKET_ROWS))


def seeded_key(seed: int, *columns: Column) -> Column:
    """32 hex digits that put rows in a seeded random order; null parts count as the empty text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def key_bucket(key: Column, buckets: int) -> Column:
    """The bucket of a hex key: buckets follow the order of keys and are of about equal size."""
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.floor(head * F.lit(buckets) / F.lit(float(2**32))).cast("long")


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: str, before: str, total: str | None = None) -> DataFrame:
    """Adds ``before``, the sum of ``value`` over the earlier rows of the same group.

    Rows of a group are ordered by ``bucket`` and then ``order``. The scan has two levels: sums per
    (group, bucket), a running sum over these few, and a running sum inside each bucket; so a group
    of any size is spread over its buckets. ``total`` names a column for the sum of the whole group.
    Group columns must not be null.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_tw_sum"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys,
        F.coalesce(F.sum("_tw_sum").over(earlier), F.lit(0)).alias("_tw_offset"),
        *([F.sum("_tw_sum").over(whole).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(offsets, keys)
    return out.withColumn(before, F.col("_tw_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_tw_offset")


def word_count(text: Column) -> Column:
    """Number of words of a text; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a text."""
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("h1"), F.xxhash64(F.lit("second"), body).alias("h2")]


def fields(df: DataFrame, columns: list[str], more: list[tuple[str, T.DataType]]) -> T.StructType:
    """Output schema of a map over Arrow batches: ``columns`` of ``df`` and then ``more``."""
    return T.StructType([df.schema[c] for c in columns] + [T.StructField(n, t) for n, t in more])


#: Ids that may be broadcast; more of them are shuffled.
BROADCAST_IDS = 500_000


def texts_of(texts: DataFrame, needed: DataFrame) -> DataFrame:
    """One row (h1, text) for each needed h1.

    A bounded number of ids is broadcast, so that only needed texts are shuffled; a larger number is
    joined by a shuffle of both sides.
    """
    few = needed.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(needed) if few else needed, "h1", "left_semi").dropDuplicates(["h1"])
