"""Exact top-k search by MaxScore over integer vectors.

Components are terms; a term's posting list holds the component of every row, in blocks of rows. For
each query and block, terms are put in the order of the most that they can add to a score there. Once k
scores are known, their least is the threshold; terms whose bounds together stay below it are
non-essential. The postings of essential terms are traversed, term by term, adding to the scores of
all rows; the postings of the others are never touched: their components are probed only for rows
that can still reach the threshold, a few terms at a time. The threshold rises from block to block.
Shards are merged at the end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import search, usable

#: Rows of a shard and queries of a block: what one task holds.
SHARD_ROWS = 16_384
BLOCK_QUERIES = 1_024
#: Rows of a block of postings, each with bounds of its own; terms that are probed at once.
POSTINGS = 4_096
PROBE = 8


def exact_type(most: float, width: int):
    """The fastest number type in which every sum of products of components up to ``most`` is exact."""
    bound = most * most * max(1, width)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


class Postings:
    """The posting lists of a shard in blocks of rows, with the bounds of every term in a block."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rids: np.ndarray, most: float):
        self.kind = exact_type(most, x.shape[1])
        x = x.astype(self.kind)
        self.ids, self.own = ids, {r: i for i, r in enumerate(rids.tolist())}
        self.blocks = []
        for first in range(0, len(x), POSTINGS):
            rows = x[first : first + POSTINGS]
            self.blocks.append((first, rows, np.ascontiguousarray(rows.T), rows.max(axis=0), rows.min(axis=0)))
        #: multiplications done, and those that scoring every row in full takes
        self.done = self.whole = 0

    def best(self, weights: np.ndarray, mine: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the k best rows for one query, which is the row ``mine`` itself (-1: none)."""
        places, scores, threshold = np.empty(0, np.int64), np.empty(0, self.kind), None
        for first, rows, postings, most, least in self.blocks:
            n, width = rows.shape
            self.whole += n * width
            bounds = np.maximum(weights * most, weights * least)
            order = np.argsort(-bounds)
            left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)  # what the terms from a place of the order on can add at most
            # essential terms: the bounds of all others together stay below the threshold
            done = width if threshold is None else int(np.argmax(left < threshold)) if left[-1] < threshold else width
            part, term = np.zeros(n, self.kind), np.empty(n, self.kind)
            for t in order[:done].tolist():
                np.multiply(postings[t], weights[t], out=term)
                part += term
            self.done += done * n
            at = np.arange(n)
            if 0 <= mine - first < n:
                at, part = np.delete(at, mine - first), np.delete(part, mine - first)
            while True:  # probe the other terms while a row is competitive
                if threshold is not None:
                    alive = part + left[done] >= threshold
                    at, part = at[alive], part[alive]
                if done >= width or not len(at):
                    break
                terms = order[done : done + PROBE]
                part = part + rows[np.ix_(at, terms)] @ weights[terms]
                self.done += len(at) * len(terms)
                done = min(width, done + PROBE)
            places, scores = np.append(places, at + first), np.append(scores, part)
            top = best(scores, self.ids[places], k)
            places, scores = places[top], scores[top]
            if len(scores) == k:
                threshold = scores[-1]
        return places, scores


def best_of_shard(shard: Postings, q: np.ndarray, qids: np.ndarray, qrids: np.ndarray, k: int):
    """The k best rows of a shard for each query of a block."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for weights, qid, qrid in zip(q.astype(shard.kind), qids.tolist(), qrids.tolist(), strict=True):
        places, scores = shard.best(weights, shard.own.get(qrid, -1), k)
        out[0].extend([qrid] * len(places))
        out[1].extend([qid] * len(places))
        out[2].extend(shard.ids[places].tolist())
        out[3].extend(scores.astype(np.int64).tolist())
    return out


def search_exact(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * component).

    ``vectors`` has vec_id and embedding; queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows but the query's own. Rows without an id, and vectors that are
    null, empty or hold a null or non-finite component take no part. A shorter vector counts as
    filled up with zeros. Ties go to the smaller vec_id. Rows that share a vec_id stay separate:
    each is a query of its own and a candidate for the others. An empty table gives no rows.
    """
    good = vectors.where(usable(vectors, "vec_id", "embedding"))
    terms = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return search(good.select(F.col("vec_id").cast("long"), terms.alias("terms")), "terms", every, k, SHARD_ROWS, BLOCK_QUERIES, Postings, best_of_shard, "long")
