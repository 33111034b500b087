"""Hard-negative mining by disjoint slots of scores.

An anchor's positives are the best rows of its own label. For each positive, negatives are the best
rows of other labels whose scores lie in a window below the positive's score. The windows of one
anchor overlap; their upper limits, in descending order, split all scores into disjoint slots: slot i
holds scores up to limit i and above limit i + 1. Every shard keeps the best k rows of each slot, and
so does the merge of shards. A window holds the slots from its own limit downwards, so that its best
k are the first k of the slots of that suffix, merged in descending order, as far as they reach its
lower limit: what is below comes after all that is not.

Both passes stream the anchors past shards of rows; nothing is joined by label, so no label is hot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .maxscore import BLOCK_QUERIES, SHARD_ROWS, best, exact_type
from .vectors import every_copy, gathered, past_shards, usable

#: A negative's score is between these percents of the positive's.
LOW, HIGH = 50, 95


class Shard:
    """The rows of a shard: vectors in an exact number type, ids, labels, and the places of numbers."""

    def __init__(self, x: np.ndarray, columns: dict, most: float):
        self.kind = exact_type(most, x.shape[1])
        self.x = np.ascontiguousarray(x.astype(self.kind).T)
        self.ids, self.labels = columns["vec_id"].to_numpy(), columns["label"].to_numpy()
        self.own = {r: i for i, r in enumerate(columns["rid"].to_numpy().tolist())}

    def scores(self, q: np.ndarray) -> np.ndarray:
        return q.astype(self.kind) @ self.x


def best_alike(shard: Shard, q: np.ndarray, columns: dict, k: int):
    """(anchor rid, row id, score): the best k rows of the anchor's label, itself aside."""
    out: tuple[list, list, list] = ([], [], [])
    for rid, label, score in zip(columns["rid"].to_pylist(), columns["label"].to_pylist(), shard.scores(q), strict=True):
        at = np.flatnonzero(shard.labels == label)
        at = at[at != shard.own.get(rid, -1)]
        top = at[best(score[at], shard.ids[at], k)]
        out[0].extend([rid] * len(top))
        out[1].extend(shard.ids[top].tolist())
        out[2].extend(score[top].astype(np.int64).tolist())
    return out


def best_of_slots(shard: Shard, q: np.ndarray, columns: dict, k: int):
    """(anchor rid, slot, row id, score): the best k rows of other labels in each slot of the anchor.

    ``limits`` are the anchor's distinct upper limits in descending order, and its lowest lower limit.
    """
    out: tuple[list, list, list, list] = ([], [], [], [])
    for rid, label, limits, score in zip(columns["rid"].to_pylist(), columns["label"].to_pylist(), columns["limits"].to_pylist(), shard.scores(q), strict=True):
        *upper, least = limits
        at = np.flatnonzero((score <= upper[0]) & (score >= least) & (shard.labels != label))
        at = at[np.lexsort((shard.ids[at], -score[at]))]
        ends = [*np.searchsorted(-score[at], [-u for u in upper]).tolist(), len(at)]
        for slot, (first, end) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            top = at[first : min(end, first + k)]
            out[0].extend([rid] * len(top))
            out[1].extend([slot] * len(top))
            out[2].extend(shard.ids[top].tolist())
            out[3].extend(score[top].astype(np.int64).tolist())
    return out


def first_of(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The best k rows of each key, with their place among them."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, k: int = 3, scale: int = 256, low: int = LOW, high: int = HIGH, label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all long but the int rank.

    ``vectors`` has vec_id, embedding and label (``label`` gives another expression for it). Scores are
    inner products of floor(scale * component); higher ones come first, ties by the smaller vec_id.
    Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives are its first
    ``positives`` other rows of its label. For each of them, the first ``k`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, fewer where there are fewer.
    Rows without an id or label, and vectors that are null, empty or hold a null or non-finite component
    take no part; a shorter vector counts as filled up with zeros. Rows that share a vec_id stay separate.
    An empty table, or one with a single label, gives no rows. Other columns play no part.
    """
    mark = F.col("label") if label is None else label
    good = vectors.where(usable(vectors, "vec_id", "embedding") & mark.isNotNull())
    terms = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    kept = gathered(good.select(F.col("vec_id").cast("long"), mark.cast("long").alias("label"), terms.alias("vector")), max(positives, k) + 1)
    anchors = kept.where(F.col("vec_id") % every == 0)
    near = past_shards(kept, anchors, ["label"], SHARD_ROWS, BLOCK_QUERIES, np.int64, Shard, lambda s, q, c: best_alike(s, q, c, positives), "rid long, vec_id long, score long")
    alike = first_of(near, ["rid"], positives, "place")
    # limits in whole scores: 100 n <= high p, and low p <= 100 n; a window that is empty (p < 0) has no slot
    windows = alike.select(
        "rid", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        F.floor(F.col("score") * high / 100.0).cast("long").alias("upper"), F.ceil(F.col("score") * low / 100.0).cast("long").alias("lower"),
    ).where("lower <= upper")
    wanted = windows.groupBy("rid").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("least"),
        F.collect_list(F.struct("place", "positive_id", "positive_score", "upper", "lower")).alias("windows"),
    )
    asked = anchors.join(wanted, "rid").withColumn("limits", F.concat("uppers", F.array("least")))
    none = F.lit(None).cast("array<bigint>")
    slots = past_shards(
        kept.withColumn("limits", none), asked, ["label", "limits"], SHARD_ROWS, BLOCK_QUERIES, np.int64, Shard, lambda s, q, c: best_of_slots(s, q, c, k), "rid long, slot long, vec_id long, score long"
    )
    # at most ``positives`` slots of k rows per anchor, in descending order: the suffix of a window starts at its upper limit
    rows = first_of(slots, ["rid", "slot"], k, "_place").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id"))).alias("rows"))
    each = every_copy(asked.select("rid", F.col("vec_id").alias("anchor_id"), "windows").join(rows, "rid"), anchors, "rid").select("anchor_id", F.explode("windows").alias("w"), "rows")
    suffix = F.slice(F.filter("rows", lambda r: -r["down"] <= F.col("w.upper")), 1, k)
    out = each.select("anchor_id", "w.*", F.posexplode(suffix).alias("at", "n")).where(-F.col("n.down") >= F.col("lower"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", (-F.col("n.down")).alias("negative_score"))
