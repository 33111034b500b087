"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of shingles of five words: occurrences times inverse document frequency.
Improved consistent weighted sampling draws one (shingle, level) per hash such that two texts draw
the same with the probability of their weighted Jaccard similarity. Draws are banded; texts that
agree in a band are candidates, compared with one leader per band; every candidate pair is verified
by the weighted Jaccard similarity of the whole texts. Those that are not like the leader are
compared with their neighbours in the order of their signatures. Links make classes as connected
components. After that, every pair of a band key whose texts are not in one component yet is decided:
by an upper bound of the similarity from sums of weights, or by the whole texts.

Document frequencies are exact where they matter: below a share FLOOR of all documents, every
shingle has the same, largest, weight, so only the few above it must be known (at most the mean
number of shingles of a text divided by FLOOR). They are found by counting hash buckets first and
then the shingles of full buckets; their table has that bound at every size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, content_key, fields, lean, texts_of
from .components import components
from .shingles import mixed, shingles, slices

#: Weighted Jaccard similarity of near-duplicates.
SIMILARITY = 0.8
#: Bands of a signature and draws of a band: a pair at SIMILARITY meets with a chance of 0.998.
BANDS, ROWS = 12, 4
#: Texts, and bytes of them, of a block in which texts are compared.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Share of documents below which document frequency does not lower a weight any further.
FLOOR = 1 / 200
#: Buckets of the first count.
BUCKETS = 1 << 18


def rows_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column of a batch."""
    return batch.column(batch.schema.get_field_index(name))


def common_shingles(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(documents, shingles in more than FLOOR of them, their exact document frequencies).

    The shingles come in order. Two passes over all texts, without a shuffle of shingles.
    """

    def bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts = rows_of(batch, "text")
            for at, to in slices(texts):
                counts += np.bincount((shingles(texts, at, to)[0] >> np.uint64(46)).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], ["bucket", "n"])

    text = docs.select("text")
    n = docs.count()
    least = FLOOR * n
    if n < 2:
        return n, np.empty(0, np.uint64), np.empty(0, np.float64)
    full = text.mapInArrow(lean(bucket_counts), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    buckets = np.zeros(BUCKETS, bool)
    buckets[[r["bucket"] for r in full.select("bucket").collect()]] = True  # at most BUCKETS numbers

    def exact_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = rows_of(batch, "text")
            found = []
            for at, to in slices(texts):
                s = shingles(texts, at, to)[0]
                found.append(s[buckets[(s >> np.uint64(46)).astype(np.int64)]])
            values, counts = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts, pa.int64())], ["shingle", "n"])

    often = text.mapInArrow(lean(exact_counts), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > least).toPandas()
    values = often["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return n, values[order], often["n"].to_numpy(np.float64)[order]


class Weights:
    """Inverse document frequency of shingles, 1 for those in at most FLOOR of the documents."""

    def __init__(self, documents: int, common: np.ndarray, frequency: np.ndarray):
        self.common = common
        self.idf = (np.log1p(documents / np.maximum(frequency, 1)) / np.log1p(1 / FLOOR)).astype(np.float32)

    def __call__(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = counts.astype(np.float64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, values), len(self.common) - 1)
            known = self.common[at] == values
            out[known] *= self.idf[at[known]]
        return out


def gamma_table(size: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        less = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(less, x, low), np.where(less, high, x)
    return low.astype(np.float32)


_GAMMA = gamma_table(2048)
_SEEDS = np.random.default_rng(11).integers(1, 2**63, (BANDS * ROWS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def draws(values: np.ndarray, weights: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Signature of each row with shingles: its least hash per draw, which stands for (shingle, level).

    Of a 64-bit hash per shingle and draw, 11 bits give r ~ Gamma(2, 1), 11 bits beta ~ U(0, 1) and
    42 bits c ~ Gamma(2, 1); with t = floor(ln w / r + beta) and ln y = r (t - beta), the draw is
    the shingle with the least c / (y exp r).
    """
    starts = (np.cumsum(runs) - runs)[runs > 0]
    out = np.empty((len(starts), BANDS * ROWS), np.float32)
    log = np.log(weights)
    for k, (a, b) in enumerate(_SEEDS):
        z = mixed(values * a + b)
        r = _GAMMA[(z & np.uint64(2047)).astype(np.int32)]
        beta = ((z >> np.uint64(11)) & np.uint64(2047)).astype(np.float32) * np.float32(1 / 2048) + np.float32(1 / 4096)
        v = ((z >> np.uint64(22)) & np.uint64(0x1FFFFF)).astype(np.float32) * np.float32(2**-21) + np.float32(2**-22)
        w = (z >> np.uint64(43)).astype(np.float32) * np.float32(2**-21) + np.float32(2**-22)
        with np.errstate(divide="ignore"):  # both near 1: infinity, which never is the least
            c = -np.log1p(v * w - v - w)
        t = np.floor(log / r + beta)
        out[:, k] = np.minimum.reduceat(c * np.exp(-r * (t - beta + 1)), starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    bits = signature.view(np.uint32).reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = np.zeros(bits.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return keys.view(np.int64)


def keyed(docs: DataFrame, weigh: Weights) -> DataFrame:
    """(doc_id, h1, h2, bytes, keys) of every row; keys is empty for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = rows_of(batch, "text")
            lists, sizes = [], []
            for at, to in slices(texts):
                values, counts, runs = shingles(texts, at, to)
                sizes.append(np.where(runs > 0, BANDS, 0))
                if len(values):
                    lists.append(band_keys(draws(values, weigh(values, counts).astype(np.float32), runs)).ravel())
            sizes = np.concatenate(sizes or [np.empty(0, np.int64)])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists or [np.empty(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(rows_of(batch, c) for c in ("doc_id", "h1", "h2", "bytes")), keys], ["doc_id", "h1", "h2", "bytes", "keys"])

    rows = docs.select("doc_id", *content_key(F.col("text")), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("bytes"), "text")
    return rows.mapInArrow(lean(run), fields(rows, ["doc_id", "h1", "h2", "bytes"], [("keys", T.ArrayType(T.LongType()))]))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (ordered distinct shingles, weights)."""
    (x, u), (y, v) = a, b
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    both = float(np.minimum(u[at[same]], v[same]).sum(dtype=np.float64))
    return both / (float(u.sum(dtype=np.float64)) + float(v.sum(dtype=np.float64)) - both)


def verified(pairs: DataFrame, texts: DataFrame, weigh: Weights) -> DataFrame:
    """(a, b, similar) of candidate pairs of a text and a leader (h1 each)."""

    def weighted(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for at, to in slices(texts):
            values, counts, runs = shingles(texts, at, to)
            ends = np.cumsum(runs)[:-1]
            out.extend(zip(np.split(values, ends), np.split(weigh(values, counts), ends), strict=True))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, right = weighted(rows_of(part, "ta")), weighted(rows_of(part, "tb"))
                like = [similarity(x, y) for x, y in zip(left, right, strict=True)]
                yield pa.RecordBatch.from_arrays([rows_of(part, "a"), rows_of(part, "b"), pa.array(np.array(like) >= SIMILARITY)], ["a", "b", "similar"])

    needed = pairs.select(F.col("a").alias("h1")).union(pairs.select(F.col("b").alias("h1"))).distinct()
    some = texts_of(texts, needed)
    # a leader of many texts is copied to as many tasks as they fill blocks
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    left = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int")).join(some.select(F.col("h1").alias("a"), F.col("text").alias("ta")), "a")
    heads = parts.join(some.select(F.col("h1").alias("b"), F.col("text").alias("tb")), "b").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = left.drop("parts").join(heads.drop("parts"), ["b", "part"])
    return both.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long, similar boolean")


def levels(values: np.ndarray, counts: np.ndarray, runs: np.ndarray, weigh: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, weight) of every occurrence of a shingle, and the sum of weights per row.

    The k-th occurrence of a shingle is a token of its own, so that the weighted Jaccard similarity of
    texts is that of sets of tokens, whose weights no longer depend on the text.
    """
    row = np.repeat(np.arange(len(runs)), runs)
    weight = weigh(values, np.ones(len(values)))
    total = np.bincount(row, weight * counts, len(runs))
    level = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(row, counts), mixed(np.repeat(values, counts) + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), np.repeat(weight, counts), total


def linked(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray], weigh: Weights) -> np.ndarray:
    """Similarity of every text of x with every text of y; each side is (shingles, counts, runs).

    Tokens are columns, so that the sum of least weights is a product of matrices. Columns of one
    side only are left out, the others come in parts.
    """

    (ri, ci, wi, ti), (rj, cj, _, tj) = levels(*x, weigh), levels(*y, weigh)
    columns = np.intersect1d(ci, cj)
    both = np.zeros((len(ti), len(tj)))
    if len(columns):
        pi, pj = (np.minimum(np.searchsorted(columns, c), len(columns) - 1) for c in (ci, cj))
        known_i, known_j = columns[pi] == ci, columns[pj] == cj
        ri, pi, wi, rj, pj = ri[known_i], pi[known_i], wi[known_i], rj[known_j], pj[known_j]
        for at in range(0, len(columns), 2_048):
            own_i, own_j = (pi >= at) & (pi < at + 2_048), (pj >= at) & (pj < at + 2_048)
            left, right = np.zeros((len(ti), 2_048)), np.zeros((len(tj), 2_048))
            left[ri[own_i], pi[own_i] - at] = wi[own_i]
            right[rj[own_j], pj[own_j] - at] = 1
            both += left @ right.T
    return both / np.maximum(ti[:, None] + tj[None, :] - both, 1e-300)


def spanning(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a forest that joins what the links (row, column) of ``near`` join."""
    i: list[int] = []
    j: list[int] = []
    rows, columns = near.any(1), near.any(0)  # still to be met
    while rows.any():
        front = np.array([int(rows.argmax())])
        rows[front] = False
        while len(front):
            new = np.flatnonzero(near[front].any(0) & columns)
            columns[new] = False
            i.extend(front[near[np.ix_(front, new)].argmax(0)].tolist() if len(new) else [])
            j.extend(new.tolist())
            front = np.flatnonzero(near[:, new].any(1) & rows)
            rows[front] = False
            i.extend(front.tolist())
            j.extend(new[near[np.ix_(front, new)].argmax(1)].tolist() if len(front) else [])
    return i, j


def blocks(n, size):
    """Blocks of at most about BLOCK texts and BLOCK_BYTES bytes for ``n`` texts of ``size`` bytes."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def paired_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, a, root, rest, i, j): every block i of ``left`` meets every block j of ``right`` of its key.

    Both have key, a, root, lefts and rights, the numbers of blocks of the two sides of their key.
    """
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = left.select("key", "a", "root", F.lit(True).alias("rest"), F.pmod(F.xxhash64("a", "key"), "lefts").cast("int").alias("i"), numbers("rights").alias("j"))
    others = right.select("key", "a", "root", F.lit(False).alias("rest"), numbers("lefts").alias("i"), F.pmod(F.xxhash64("a", "key"), "rights").cast("int").alias("j"))
    return rest.union(others)


def rarest_tokens(crowded: DataFrame, texts: DataFrame, weigh: Weights) -> DataFrame:
    """(a, token, short): the rarest tokens of texts, by which all similar pairs of them meet.

    Tokens are ordered by the number of ``crowded`` texts that have them. Two texts at SIMILARITY t
    share t times the weight of the longer one at least, and 2t / (1 + t) times that of the shorter
    one. So they share a token among the first of the longer one, up to 1 - t of its weight, that is
    also among the first of the shorter one, up to 1 - 2t / (1 + t) of its weight (``short``). What
    the texts of a family have in common comes last in this order, and is not among the short ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids = rows_of(batch, "text"), rows_of(batch, "h1").to_numpy()
            for at, to in slices(held):
                row, token, weight, _ = levels(*shingles(held, at, to), weigh)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at:to][row]), pa.array(token.view(np.int64)), pa.array(weight)], ["a", "token", "weight"])

    held = texts_of(texts, crowded.select(F.col("a").alias("h1"))).select("h1", "text")
    tokens = checkpointed(held.mapInArrow(lean(run), "a long, token long, weight double"))
    often = checkpointed(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"))
    whole = Window.partitionBy("a")
    rare_first = whole.orderBy(F.coalesce("n", F.lit(1)), "token").rowsBetween(Window.unboundedPreceding, -1)
    placed = tokens.join(often, "token", "left").select("a", "token", "n", F.coalesce(F.sum("weight").over(rare_first), F.lit(0.0)).alias("before"), F.sum("weight").over(whole).alias("total"))
    upto = lambda share: F.col("before") <= (share + 1e-9) * F.col("total")
    return placed.where(F.col("n").isNotNull() & upto(1 - SIMILARITY)).select("a", "token", upto(1 - 2 * SIMILARITY / (1 + SIMILARITY)).alias("short"))


def split_blocks(crowded: DataFrame, texts: DataFrame, weigh: Weights) -> DataFrame:
    """Blocks, as of ``paired_blocks``, in which all similar texts of ``crowded`` (a, bytes, root) with other roots meet.

    The key is a token here. Texts that have it among their short ones meet all that have it; two
    texts of the largest component of a token do not meet.
    """
    rows = checkpointed(rarest_tokens(crowded, texts, weigh).join(crowded, "a"))
    by_root = rows.groupBy("token", "root").agg(F.count("*").alias("n"), F.max("short").alias("short"))
    tokens = by_root.groupBy("token").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.max("short").alias("short")).where("roots > 1 and short")
    known = rows.join(checkpointed(tokens.select("token", F.col("main.root").alias("main"))), "token").withColumn("rest", F.col("root") != F.col("main"))
    # short texts of the rest with all, and those of the largest component with the rest
    sides = F.array(F.struct(F.lit(0).alias("turn"), (F.col("short") & F.col("rest")).alias("left"), F.lit(True).alias("right")), F.struct(F.lit(1).alias("turn"), (F.col("short") & ~F.col("rest")).alias("left"), F.col("rest").alias("right")))
    dealt = checkpointed(known.select("token", "a", "bytes", "root", F.explode(sides).alias("s")).select(F.xxhash64("token", "s.turn").alias("key"), "a", "bytes", "root", "s.left", "s.right").where("left or right"))
    of = lambda side, what: F.sum(F.when(F.col(side), what).otherwise(0))
    sizes = dealt.groupBy("key").agg(*(of(side, what).alias(f"{side}_{name}") for side in ("left", "right") for name, what in (("n", F.lit(1)), ("bytes", F.col("bytes")))))
    several = sizes.where("left_n > 0 and right_n > 0").select("key", blocks(F.col("left_n"), F.col("left_bytes")).alias("lefts"), blocks(F.col("right_n"), F.col("right_bytes")).alias("rights"))
    held = dealt.join(checkpointed(several), "key")
    return paired_blocks(held.where("left"), held.where("right"))


def blocks_across(members: DataFrame, links: DataFrame, texts: DataFrame, weigh: Weights) -> DataFrame:
    """(key, a, root, rest, i, j): the blocks of texts that ``links_across`` compares."""
    known = members.select("key", "a", "bytes").join(components(links).withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    known = checkpointed(known)
    by_root = known.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    sizes = by_root.groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("main")).where("n > 2 and n > main.n")
    lefts, rights = blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")), blocks(F.col("n"), F.col("bytes"))
    several = checkpointed(sizes.select("key", F.col("main.root").alias("main"), lefts.alias("lefts"), rights.alias("rights")))
    rows = known.join(several.where("lefts = 1"), "key")
    out = paired_blocks(rows.where("root <> main"), rows)
    crowded = several.where("lefts > 1")
    if crowded.isEmpty():
        return out
    return out.union(split_blocks(checkpointed(known.join(crowded.select("key"), "key", "left_semi").select("a", "bytes", "root").distinct()), texts, weigh))


def links_across(members: DataFrame, links: DataFrame, texts: DataFrame, weigh: Weights) -> DataFrame:
    """(a, b): links that join the components of ``links`` as all similar pairs that share a band do.

    In each band key, the texts outside of its largest component (the rest) are compared with all
    texts of the key, whole and exactly. Both sides are dealt into blocks of BLOCK texts and
    BLOCK_BYTES bytes, so that a key of any size is spread and a task is bounded; of the links of
    two blocks, a forest is returned. Keys of two texts were decided before.

    A rest of several blocks would be compared with a square of work. The texts of such keys meet by
    their rarest tokens instead, all similar pairs of them in other components: template texts, whose
    common words are no rare ones, do not meet at all.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rest = group["rest"].to_numpy()
        sides = []
        for side in (np.flatnonzero(rest), np.flatnonzero(~rest)):
            part = group.take(pa.array(side))
            rows = part["text"].combine_chunks()
            rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
            found = [shingles(rows, at, to) for at, to in slices(rows)] or [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))]
            sides.append((part["a"].to_numpy(), part["root"].to_numpy(), tuple(np.concatenate(x) for x in zip(*found, strict=True))))
        (a, one, x), (b, two, y) = sides
        i, j = spanning((linked(x, y, weigh) >= SIMILARITY) & (one[:, None] != two[None, :])) if len(a) and len(b) else ([], [])
        out = pa.table({"a": pa.array(a[i], pa.int64()), "b": pa.array(b[j], pa.int64())})
        pa.default_memory_pool().release_unused()
        return out

    dealt = checkpointed(blocks_across(members, links, texts, weigh))
    held = dealt.join(texts_of(texts, dealt.select(F.col("a").alias("h1")).distinct()).withColumnRenamed("h1", "a"), "a")
    return held.select("key", "i", "j", "a", "root", "rest", "text").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_links(docs: DataFrame, nodes: DataFrame, weigh: Weights) -> DataFrame:
    """(a, b): verified links between different texts (h1 each) that share a band.

    First, all texts of a band key are compared with one leader, the text that shares the most band
    keys with others: the likely origin of its copies. This joins most texts by a number of pairs
    that is linear in the texts of a key. Then, in every key that still holds several components, the
    texts outside of the largest one are compared with all others. So each pair of a key is either
    decided or inside one component, and the components are exactly those of all pairs.
    """
    texts = docs.select(content_key(F.col("text"))[0], "text")
    members = nodes.where(F.col("keys").isNotNull()).select(F.col("h1").alias("a"), "bytes", F.explode("keys").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = checkpointed(members.join(sizes, "key"))
    members = checkpointed(shared.join(shared.groupBy("a").agg(F.sum("n").alias("weight")), "a").select("key", "a", "bytes", "weight"))
    heads = members.groupBy("key").agg(F.max_by("a", F.struct("weight", "a")).alias("b"))
    pairs = checkpointed(members.join(heads, "key").where("a <> b").select("a", "b").distinct())
    links = checkpointed(verified(pairs, texts, weigh).where("similar").select("a", "b"))
    return links.union(links_across(members, links, texts, weigh))


def class_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, n, class_id, leads): ids and texts, the rows that have both, and their class."""
    weigh = Weights(*common_shingles(docs))
    rows = checkpointed(keyed(docs, weigh))
    nodes = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("did"), F.first("bytes").alias("bytes"), F.first("keys").alias("keys"))
    links = checkpointed(near_links(docs, nodes, weigh))
    labelled = nodes.select("h1", "h2", "did").join(components(links).withColumnRenamed("node", "h1"), "h1", "left").withColumn("root", F.coalesce("root", "h1"))
    labelled = checkpointed(labelled)
    best = labelled.groupBy("root").agg(F.min("did").alias("class_id"), F.min_by("h1", F.struct(F.col("did").isNull(), "did", "h1")).alias("head"))
    known = labelled.join(best, "root").select("h1", "h2", "did", "class_id", (F.col("h1") == F.col("head")).alias("leads"))
    distinct = rows.groupBy("doc_id", "h1", "h2").agg(F.count("*").alias("n")).join(known, ["h1", "h2"])
    return distinct.select("doc_id", "h1", "h2", "n", "class_id", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("did"))).alias("leads"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, class_id, first): the near-duplicate class of every row of ``docs``.

    ``docs`` has doc_id and text; other columns are ignored. ``class_id`` is the least doc_id of the
    class, ``first`` true for the one row that stands for it. Equal texts are one class without being
    compared; texts without words are near-duplicates of equal texts only. Null texts count as
    empty ones. Rows that repeat whole each get a row, and one of them at most is the first. A class
    whose ids are all null has a null class_id. An empty table gives no rows.
    """
    each = class_rows(docs).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select("doc_id", "h1", "h2", "class_id", (F.col("leads") & (F.col("copy") == 1)).alias("first"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first row of every near-duplicate class, with the columns of ``docs``.

    Classes are those of ``classes``, with its rules for nulls, empty texts and ties; of rows that
    repeat whole, one stays. All columns pass through, whatever their names. An empty table gives no
    rows.
    """
    keys = checkpointed(class_rows(docs).where("leads").select("doc_id", "h1", "h2", "n"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_tw_row"), "doc_id", *content_key(F.col("text")))
    same = held["doc_id"].eqNullSafe(keys["doc_id"]) & (held["h1"] == keys["h1"]) & (held["h2"] == keys["h2"])
    kept = held.join(keys, same).select("_tw_row", held["doc_id"], held["h1"], held["h2"], "n")
    # rows that repeat whole: one of them
    repeated = kept.where("n > 1").dropDuplicates(["doc_id", "h1", "h2"])
    return kept.where("n = 1").union(repeated).select(*(F.col(f"_tw_row.`{c}`").alias(c) for c in docs.columns))
