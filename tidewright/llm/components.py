"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpointed


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node in ``links`` (a, b).

    Large stars and small stars in turn, until the links no longer change: every step aggregates
    minima per node, so that a node with very many links is no burden, and long chains halve in
    each round. Each round is written; nothing is collected but a fingerprint of two numbers.
    """
    rounds = Scratch(links.sparkSession)
    edges = rounds(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = rounds(small.union(down.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == (now["n"], now["s"]):
            break
        mark = (now["n"], now["s"])
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out = checkpointed(roots)
    rounds.close()
    return out
