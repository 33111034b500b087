"""Approximate nearest neighbours by a forest of hash prefixes.

Every vector has one long hash string per tree: the signs of its products with seeded random
directions. A tree of a shard is its strings in sorted order, so that a prefix is a run of the
array. A query descends in each tree to its longest prefix match, and then ascends in all trees at
once, one bit at a time; each step lengthens the runs, and what is new in them is scored.

The ascent ends by a rule on probabilities, not at a number of candidates: with the k-th best
product found so far, the chance that a row at least as near shares the current prefix in some tree
is known from the angle; the query is done when it reaches RECALL. For inner products, rows get one
more component that fills their length up to the longest of the shard, which turns the largest
product into the smallest angle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import search, usable

TREES = 40
BITS = 32
#: Chance to meet a row as near as the k-th best found, at which a query stops.
RECALL = 0.9
SEED = 41
#: Rows of all trees, times k, that the first prefixes hold at least; bits of one ascent.
FIRST = 50
STEP = 3
#: Rows of a shard and queries of a block: what one task holds.
SHARD_ROWS = 65_536
BLOCK_QUERIES = 320


def strings(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Hash strings of the rows of ``x``, one column per tree, as unsigned integers of BITS bits."""
    planes = np.random.default_rng(seed).standard_normal((TREES, BITS, x.shape[1])).astype(np.float32)
    weights = (np.uint32(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint32)).astype(np.uint32)
    out = np.empty((len(x), TREES), np.uint32)
    for t in range(TREES):
        out[:, t] = ((x @ planes[t].T) > 0) @ weights
    return out


class Forest:
    """The trees of a shard: sorted hash strings, and the rows in their order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rids: np.ndarray, most: float):
        square = (x * x).sum(axis=1)
        self.x, self.small, self.ids = x, x.astype(np.float32), ids
        self.reach = float(np.sqrt(square.max()))
        fill = np.sqrt(np.maximum(0, self.reach * self.reach - square))[:, None]
        codes = strings(np.hstack([x, fill]).astype(np.float32) / np.float32(self.reach))
        self.order = np.argsort(codes, axis=0).T.astype(np.int32)
        self.trees = [codes[self.order[t], t] for t in range(TREES)]
        self.own = {r: i for i, r in enumerate(rids.tolist())}


def near_in_shard(shard: Forest, q: np.ndarray, qids: np.ndarray, qrids: np.ndarray, k: int):
    """The k nearest rows found in a shard for each query of a block."""
    x, small, ids, reach, order, trees, own = shard.x, shard.small, shard.ids, shard.reach, shard.order, shard.trees, shard.own
    n = len(ids)
    length = np.sqrt((q * q).sum(axis=1))
    own_codes = strings(np.hstack([q / length[:, None], np.zeros((len(q), 1))]).astype(np.float32))
    margin = 1e-5 * reach
    # low[d], high[d]: where the queries' prefixes of d bits begin and end in each tree
    low, high = np.zeros((BITS + 1, len(q), TREES), np.int32), np.full((BITS + 1, len(q), TREES), n, np.int32)
    for d in range(1, BITS + 1):
        prefix = own_codes >> np.uint32(BITS - d) << np.uint32(BITS - d)
        last = prefix | np.uint32((1 << (BITS - d)) - 1)
        for t in range(TREES):
            low[d, :, t] = np.searchsorted(trees[t], prefix[:, t], "left")
            high[d, :, t] = np.searchsorted(trees[t], last[:, t], "right")
    reached = (high - low).sum(axis=2, dtype=np.int64)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for j, (qrid, qid) in enumerate(zip(qrids.tolist(), qids.tolist(), strict=True)):
        mine = own.get(qrid, -1)
        weights = q[j].astype(np.float32)
        seen = np.zeros(n, bool)
        rows, score = np.empty(0, np.int64), np.empty(0, np.float32)
        # descend to the longest prefixes that are met often enough to know k rows
        d = int(np.max(np.flatnonzero(reached[:, j] >= min(FIRST * k, reached[0, j]))))
        while True:
            before = seen.copy()
            if d:
                for t, (a, b) in enumerate(zip(low[d, j].tolist(), high[d, j].tolist(), strict=True)):
                    seen[order[t, a:b]] = True
            else:
                seen[:] = True
            new = seen & ~before
            if mine >= 0:
                new[mine] = False
            at = np.flatnonzero(new)
            rows, score = np.append(rows, at), np.append(score, small[at] @ weights)
            if len(rows) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                near = score >= least - margin * length[j]
                rows, score = rows[near], score[near]
            if not d:
                break
            end = 0
            if len(rows) >= k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                agree = 1 - np.arccos(np.clip(least / (length[j] * reach), -1, 1)) / np.pi
                met = 1 - (1 - agree ** np.arange(BITS + 1)) ** TREES
                end = int(np.max(np.flatnonzero(met >= RECALL)))
            if end >= d:
                break
            d = max(end, d - STEP)  # ascend in all trees at once
        exact = (x[rows] * q[j]).sum(axis=1)
        top = np.lexsort((ids[rows], -exact))[:k]
        out[0].extend([qrid] * len(top))
        out[1].extend([qid] * len(top))
        out[2].extend(ids[rows[top]].tolist())
        out[3].extend(exact[top].tolist())
    return out


def search_near(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner products that are found.

    ``vectors`` has vec_id and embedding; queries are the rows whose vec_id is divisible by
    ``every``, candidates all rows but the query's own. Every row is indexed; scores are inner
    products of the original vectors in double precision. Rows without an id, and vectors that are
    null, empty, all zero or hold a null or non-finite component take no part. A shorter vector
    counts as filled up with zeros. Ties go to the smaller vec_id. Rows that share a vec_id stay
    separate: each is a query of its own and a candidate for the others. An empty table gives no rows.
    """
    good = vectors.where(usable(vectors, "vec_id", "embedding") & F.exists("embedding", lambda v: v.cast("double") != 0))
    wide = F.transform("embedding", lambda v: v.cast("double"))
    return search(good.select(F.col("vec_id").cast("long"), wide.alias("vector")), "vector", every, k, SHARD_ROWS, BLOCK_QUERIES, Forest, near_in_shard, "double")
