"""Benchmark decontamination: item windows that stand in documents, by a prefix-filtered set join.

A window is WINDOW consecutive words of an item (all its words, if it has fewer), seen as the set of
its shingles. Shingles are put in an order of rarity: how often they occur in all documents. A
document window that contains at least ``c`` of the ``s`` shingles of an item window contains one of
its ``s - c + 1`` rarest ones; exact containment (c = s) makes the rarest shingle alone the necessary
prefix. So only places of such shingles are joined with item windows, on the shingle. The place of
the shingle in both gives the place of the whole window, which must lie inside the document (length
and positional bounds), and then the words of the document there must be the words of the item.

Documents are read twice, once to count the shingles that items have and once to find the prefixes.
Both reads drop other shingles by a bitmap of bounded size: what it lets through by chance falls out
of the joins. Documents and items meet in joins on keys; a key that very many places share is cut
by the skew join of adaptive execution. Neither texts nor items are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, lean
from .shingles import SHINGLE, prefix_sums, runs_at, slices, word_spans

#: Words of a window.
WINDOW = 10
#: Bits of the bitmap: so many per key, between two limits (4 KB and 16 MB).
KEY_BITS, LEAST_BITS, MOST_BITS = 32, 1 << 15, 1 << 27
#: Bytes of a bitmap that Spark's ``bitmap_construct_agg`` gives.
PART = 4_096
#: Places of one output batch.
BATCH = 4_096

_FOLD = np.full(256, 32, np.uint8)
for _first, _last, _to in ((0x30, 0x39, 0x30), (0x41, 0x5A, 0x61), (0x61, 0x7A, 0x61), (0x80, 0xFF, 0x80)):
    _FOLD[_first : _last + 1] = np.arange(_last - _first + 1) + _to


def folded(texts: pa.Array) -> pa.Array:
    """Texts with A-Z in lower case and a space for every ASCII character that is no letter or digit."""
    valid, offsets, data = texts.buffers()
    if data is None:
        return texts
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    own = _FOLD[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    plain = pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(own)])
    if texts.null_count:
        null = texts.is_null()
        plain = pa.compute.if_else(null, pa.scalar(None, texts.type), plain)
    return plain


def spans_of(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(first row, folded texts, word hashes, words per row) of slices of a column."""
    for at, to in slices(texts):
        some = folded(texts.slice(at, to - at))
        yield at, some, *word_spans(some, 0, to - at)


def placed(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, place in the row) of every run of ``size`` words inside one row."""
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(np.arange(len(hashes)) + size <= ends[row])
    return runs_at(*prefix_sums(hashes), at, size), row[at], at - (ends - counts)[row[at]]


class Bitmap:
    """Which keys may be wanted: two bits of each are looked up."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.mask = np.uint64(len(bits) * 8 - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        found = np.arange(len(keys))
        for shift in (0, 32):
            at = (keys[found] >> np.uint64(shift)) & self.mask
            found = found[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        return found


def bitmap(keys: DataFrame):
    """The bitmap of the column ``key`` as a broadcast of MOST_BITS bits at most, whatever the number of keys."""
    spark = keys.sparkSession
    wanted = keys.count() * KEY_BITS
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length() if wanted else 0))
    at = F.explode(F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(F.lit(bits - 1)) + 1 for s in (0, 32)))).alias("bit")
    parts = keys.select(at).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray(bits // 8)
    for part, some in parts.collect():  # one row per PART bytes
        out[(part - 1) * PART : part * PART] = some
    return spark.sparkContext.broadcast(bytes(out))


def item_windows(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(item_id, window, length, keys): every window of every item; keys are its shingles in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts, hashes, counts in spans_of(batch.column(1)):
                ends = np.cumsum(counts)
                sums, inverse = prefix_sums(hashes)
                for i, n in enumerate(counts.tolist()):
                    if not n:
                        continue
                    words = texts[i].as_buffer().to_pybytes().split()
                    length = min(WINDOW, n)
                    size = min(SHINGLE, length)
                    keys = runs_at(sums, inverse, np.arange(ends[i] - n, ends[i] - size + 1), size).view(np.int64)
                    starts = range(n - length + 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(batch.column(0).slice(at + i, 1).to_pylist() * len(starts), batch.schema.field(0).type),
                            pa.array([b" ".join(words[s : s + length]).decode() for s in starts], pa.string()),
                            pa.array([length] * len(starts), pa.int32()),
                            pa.array([keys[s : s + length - size + 1] for s in starts], pa.list_(pa.int64())),
                        ],
                        ["item_id", "window", "length", "keys"],
                    )

    rows = items.select(F.col(id_column).alias("item_id"), F.col(text_column).cast("string").alias("text"))
    schema = T.StructType([rows.schema["item_id"], T.StructField("window", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(lean(run), schema)


def frequencies(docs: DataFrame, text_column: str, wanted, sizes: list[int]) -> DataFrame:
    """(key, n): how often the wanted shingles, and some others, occur in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = Bitmap(wanted.value)
        for batch in batches:
            for _, _, hashes, counts in spans_of(batch.column(0)):
                for size in sizes:
                    keys = placed(hashes, counts, size)[0]
                    keys, n = np.unique(keys[pick(keys)], return_counts=True)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    return docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(lean(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, id_column: str, text_column: str, wanted, sizes: list[int]) -> DataFrame:
    """One row per document (rid, id, n_words), and one (rid, n_words, key, place, back, words) per place of a wanted shingle.

    ``words`` are the words around the place, from ``back`` words before it on; it is null in rows of documents.
    """

    def batch_of(ids, rid, n_words, key=None, place=None, back=None, words=None) -> pa.RecordBatch:
        none = lambda x, kind: pa.nulls(len(rid), kind) if x is None else pa.array(x, kind)
        columns = [ids, pa.array(rid, pa.int64()), pa.array(n_words, pa.int64()), none(key, pa.int64()), none(place, pa.int64()), none(back, pa.int32()), none(words, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [id_column, "rid", "n_words", "key", "place", "back", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = Bitmap(wanted.value)
        for batch in batches:
            rids = batch.column(1).to_numpy()
            for at, texts, hashes, counts in spans_of(batch.column(2)):
                yield batch_of(batch.column(0).slice(at, len(counts)), rids[at : at + len(counts)], counts)
                for size in sizes:
                    keys, row, place = placed(hashes, counts, size)
                    hit = pick(keys)
                    split, of = [], -1
                    for some in np.split(hit, range(BATCH, len(hit), BATCH)):
                        around = []
                        for i, p in zip(row[some].tolist(), place[some].tolist(), strict=True):
                            if i != of:
                                split, of = texts[i].as_buffer().to_pybytes().split(), i
                            around.append(b" ".join(split[max(0, p - WINDOW + size) : p + WINDOW]).decode())
                        if around:
                            back = np.minimum(place[some], WINDOW - size)
                            yield batch_of(pa.nulls(len(some), batch.schema.field(0).type), rids[at + row[some]], counts[row[some]], keys[some].view(np.int64), place[some], back, around)

    rows = docs.select(F.col(id_column), F.monotonically_increasing_id().alias("rid"), F.col(text_column).cast("string").alias("text"))
    more = [("rid", T.LongType()), ("n_words", T.LongType()), ("key", T.LongType()), ("place", T.LongType()), ("back", T.IntegerType()), ("words", T.StringType())]
    return rows.mapInArrow(lean(run), T.StructType([rows.schema[id_column], *(T.StructField(n, t) for n, t in more)]))


def union_of(spans: DataFrame) -> DataFrame:
    """(rid, spans): the spans (begin, end) of each document, those that meet or overlap as one, in order."""
    order = Window.partitionBy("rid").orderBy("begin", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("begin") <= far, 0).otherwise(1))
    parts = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return parts.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def rarest(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, length, key, offset): the rarest shingle of each window, ties to the first; windows with one that never occurs fall out."""
    each = windows.select("window", "length", F.posexplode("keys").alias("offset", "key"))
    known = each.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = known.groupBy("window", "length").agg(F.min(F.struct("n", "offset", "key")).alias("p")).where("p.n > 0")
    return least.select("window", "length", F.col("p.key").alias("key"), F.col("p.offset").alias("offset"))


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, spans, items): the words of every document that stand in an occurring window, and the items.

    ``spans`` are (begin, end) in words, end exclusive, in order, those that meet as one; ``items`` are
    the distinct ids of items with occurring windows, sorted as strings. Both are empty, not null, where
    nothing occurs. Null, empty and wordless texts have no words; rows that repeat are documents of
    their own; texts are whole, whatever their length. An item without an id hits words, but is not
    listed. Other columns play no part, whatever their names. Without items nothing is hit; without
    documents there are no rows.
    """
    windows = checkpointed(item_windows(items, item_column, item_text))
    sizes = sorted(r["size"] for r in windows.select(F.least("length", F.lit(SHINGLE)).alias("size")).distinct().collect())  # SHINGLE numbers at most
    distinct = windows.dropDuplicates(["window"]).select("window", "length", "keys")
    first = bitmap(distinct.select(F.explode("keys").alias("key")).distinct())
    prefixes = checkpointed(rarest(distinct, frequencies(docs, text_column, first, sizes)))
    second = bitmap(prefixes.select("key").distinct())
    found = checkpointed(places(docs, id_column, text_column, second, sizes))
    near = found.where("words is not null").select("rid", "n_words", "key", "place", "back", "words")
    begin = F.col("place") - F.col("offset")
    there = F.array_join(F.slice(F.split("words", " "), F.col("back") - F.col("offset") + 1, F.col("length")), " ")
    # places of a prefix meet its few offsets first and whole windows then, so that many windows of one prefix are no burden
    fits = near.join(prefixes.select("key", "offset", "length").distinct(), "key").where((begin >= 0) & (begin + F.col("length") <= F.col("n_words")))
    hits = fits.select("rid", begin.alias("begin"), "key", "offset", "length", there.alias("window")).join(prefixes, ["window", "key", "offset", "length"])
    spans = union_of(hits.select("rid", "begin", (F.col("begin") + F.col("length")).alias("end")).distinct())
    owners = windows.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item")).distinct()
    listed = hits.select("rid", "window").distinct().join(owners, "window").groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = found.where("words is null").select("rid", F.col(id_column), "n_words")
    both = rows.join(spans, "rid", "left").join(listed, "rid", "left")
    return both.select(F.col(id_column), "n_words", or_empty("spans", spans), or_empty("items", listed))


def or_empty(name: str, df: DataFrame) -> Column:
    """A list column, empty where it is null."""
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)).alias(name)
