"""What the operators on vectors share: usable vectors, shards of rows, and the merge of shards.

Every row goes to one shard of bounded size, by a hash of what it holds, and every query to all shards.
A task prepares a shard once and then answers the queries, block by block, as they stream in; it gives
its best k for each. The merge keeps the best k of those; Spark's window limit drops most of them before
the shuffle. Where there are fewer shards than cores, each shard is prepared a few times, for a part of
the queries each. Rows that repeat whole are one row with a number of copies, so that no shard is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, lean


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> Column:
    """True for rows with an id and a non-empty vector of finite components."""

    def finite(x: Column) -> Column:
        d = x.cast("double")
        return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))

    v = F.col(vector_column)
    return F.col(id_column).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite)


def gathered(rows: DataFrame, most_copies: int) -> DataFrame:
    """Distinct rows with ``copies``, a number ``rid``, and ``held``: the copies that a search of most_copies - 1 can need."""
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    return checkpointed(alike.select("*", F.least("copies", F.lit(most_copies)).cast("int").alias("held"), F.monotonically_increasing_id().alias("rid")))


def past_shards(kept: DataFrame, asked: DataFrame, more: list[str], shard_rows: int, block_queries: int, dtype, prepare: Callable, answer: Callable, schema: str) -> DataFrame:
    """Streams the queries ``asked`` past shards of the rows ``kept``.

    Both have vec_id, vector, rid and the columns ``more``; ``kept`` has ``held`` (see ``gathered``) and
    decides the shards. ``prepare(matrix, columns, most)`` gives the state of a shard, where columns are
    Arrow arrays by name and ``most`` is the largest absolute component of all rows; ``answer(state,
    matrix, columns)`` gives the lists of ``schema`` for a block of queries.
    """
    spark = kept.sparkSession
    sizes = kept.agg(F.sum("held").alias("n"), F.max(F.size("vector")).alias("width"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most")).first()
    shards = max(1, -(-(sizes["n"] or 0) // shard_rows))
    parts = max(1, -(-spark.sparkContext.defaultParallelism // shards))
    width, most = sizes["width"] or 0, float(sizes["most"] or 0)
    place = F.xxhash64("vec_id", "vector")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["vec_id", "rid", *more]
    copies = kept.select(*columns, "vector", place.alias("place"), F.explode(F.sequence(F.lit(1), "held")).alias("copy")).drop("copy")
    shard = copies.select(*columns, "vector", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks")).select("*", numbers(parts).alias("part"))
    queries = asked.select(*columns, "vector", numbers(shards).alias("shard"), F.lit(True).alias("asks"), F.pmod(place, F.lit(parts)).cast("int").alias("part"))
    dealt = shard.union(queries).repartition("shard", "part").sortWithinPartitions("shard", "part", "asks")
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, state = None, [], None
        for batch in batches:
            at_name = lambda b, n: b.column(b.schema.get_field_index(n))
            shard, part, asks = (at_name(batch, n).to_numpy(zero_copy_only=False) for n in ("shard", "part", "asks"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(part) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)], strict=True):
                if to == at:
                    continue
                if cell != (shard[at], part[at]):
                    cell, held, state = (shard[at], part[at]), [], None
                if not asks[at]:
                    held.append(batch.slice(at, to - at))
                    continue
                if state is None and held:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    vectors = np.concatenate([matrix(at_name(b, "vector"), width, dtype) for b in held])
                    state, held = prepare(vectors, {n: whole.column(n).chunk(0) for n in columns}, most), []
                for first in range(at, to if state is not None else at, block_queries):
                    piece = batch.slice(first, min(to, first + block_queries) - first)
                    found = answer(state, matrix(at_name(piece, "vector"), width, dtype), {n: at_name(piece, n) for n in columns})
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64() if f.split()[1] == "double" else pa.int64()) for x, f in zip(found, schema.split(","), strict=True)], names)

    return dealt.mapInArrow(lean(run), schema)


def search(rows: DataFrame, vector: str, every: int, k: int, shard_rows: int, block_queries: int, prepare: Callable, answer: Callable, score_type: str) -> DataFrame:
    """Top k of every query row (vec_id divisible by ``every``) among all other rows.

    ``rows`` has vec_id and the lists ``vector``. ``prepare(matrix, ids, rids, most)`` gives the state of
    a shard, where rids number the rows and ``most`` is the largest absolute component of the table;
    ``answer(state, matrix, ids, rids, k)`` gives lists of (query rid, query vec_id, candidate vec_id,
    score) for a block of queries. Rows that share a vec_id are separate candidates and separate queries.
    """
    kept = gathered(rows.select("vec_id", F.col(vector).alias("vector")), k + 1)
    asked = kept.where(F.col("vec_id") % every == 0)
    numpy = lambda c: (c["vec_id"].to_numpy(), c["rid"].to_numpy())
    found = past_shards(
        kept, asked, [], shard_rows, block_queries, {"long": np.int64, "double": np.float64}[score_type],
        lambda x, c, most: prepare(x, *numpy(c), most), lambda state, q, c: answer(state, q, *numpy(c), k), f"qrid long, query_id long, vec_id long, score {score_type}",
    )
    best = Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return every_copy(top, asked, "qrid").select("query_id", "rank", "vec_id", "score")


def every_copy(found: DataFrame, asked: DataFrame, rid: str) -> DataFrame:
    """``found`` once for each copy of its query row."""
    repeated = asked.where("copies > 1").select(F.col("rid").alias(rid), "copies")
    return found.join(repeated, rid, "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("copies", F.lit(1))))).drop("copies", "_copy")


def matrix(lists: pa.ListArray, width: int, dtype) -> np.ndarray:
    """A column of lists as rows of one matrix; shorter vectors are filled up with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out
