"""Suffix-array dedup: passages that stand in an earlier document, by sparse suffix arrays.

Of all suffixes (from a word to the end of its text), only those are kept that begin at a minimiser:
the place of the least hash of GRAM words among WINDOW neighbouring places. Two copies of a passage
keep the same suffixes, and of PASSAGE words the first kept one begins within the first WINDOW
words, so that the copies agree in the next PREFIX words at least. Suffixes that agree in these are
neighbours in suffix order; each is compared with the one from the earliest document, and the match
is extended to the right and to the left as far as the texts agree.

Where that match does not hold all runs of PASSAGE words around the suffix, the other neighbours may
still share one: then the runs outside of it are keyed themselves. Two neighbours that share a run
which the earliest one does not have both give it, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, checkpointed, content_key, lean, texts_of, word_count
from .shingles import prefix_sums, runs_at, slices, word_spans

#: Words of the shortest passage that is reported.
PASSAGE = 50
#: Words of the hash that selects places, places of a window, and words in which neighbours agree.
GRAM, WINDOW = 8, 26
PREFIX = PASSAGE - WINDOW + 1


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or largest of every ``width`` neighbouring values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def minimisers(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) of the kept suffixes that have PREFIX words."""
    none = np.empty(0, np.int64)
    n = len(hashes)
    if n < GRAM + WINDOW - 1:
        return none, none
    sums, inverse = prefix_sums(hashes)
    grams = runs_at(sums, inverse, np.arange(n - GRAM + 1), GRAM)
    least = sliding(grams, WINDOW, np.minimum)
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(least))
    least = np.where(at + WINDOW + GRAM - 1 <= ends[row[at]], least, np.uint64(0))  # windows inside one text only
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    kept = np.flatnonzero(sliding(padded, WINDOW, np.maximum)[: len(grams)] == grams)
    kept = kept[kept + PREFIX <= ends[row[kept]]]
    return row[kept], kept


def suffixes(docs: DataFrame) -> DataFrame:
    """(key, did, h1, place): the kept suffixes of every text; key is a hash of their first PREFIX words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            ids, h1 = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for at, to in slices(texts):
                hashes, counts = word_spans(texts, at, to)
                row, kept = minimisers(hashes, counts)
                if len(kept):
                    keys = runs_at(*prefix_sums(hashes), kept, PREFIX).view(np.int64)
                    place = kept - (np.cumsum(counts) - counts)[row]
                    columns = [pa.array(keys), pa.array(ids[at + row], pa.int64()), pa.array(h1[at + row], pa.int64()), pa.array(place, pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "did", "h1", "place"])

    rows = docs.select(id_order(), content_key(F.col("text"))[0], "text")
    return rows.mapInArrow(lean(run), "key long, did long, h1 long, place int")


def id_order():
    """Ids as an order of documents, null last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("did")


def reach(x: np.ndarray, y: np.ndarray) -> int:
    """Number of leading words in which two runs of words agree."""
    n, done, step = min(len(x), len(y)), 0, 64
    while done < n:
        to = min(n, done + step)
        differ = np.flatnonzero(x[done:to] != y[done:to])
        if len(differ):
            return done + int(differ[0])
        done, step = to, step * 4
    return n


def matches(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Extends pairs (a, b, anchors of (pa, pb, more)) of texts.

    Returns (a, begin, end, b, key, start): words begin..end of a stand in b, with a null key; and,
    where an anchor has more than two neighbours, one row for each run of PASSAGE words around it
    that its match does not hold, with the run's hash and its start. A text that is its own earliest
    neighbour (a = b, at another place) gives runs only.
    """

    def hashed(texts: pa.Array) -> list[np.ndarray]:
        out = []
        for at, to in slices(texts):
            hashes, counts = word_spans(texts, at, to)
            out.extend(np.split(hashes, np.cumsum(counts)[:-1]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                spans: list[tuple[int, int, int, int]] = []
                keyed: list[tuple[int, np.ndarray, np.ndarray]] = []
                for a, b, anchors, x, y in zip(*(part.column(i).to_pylist() for i in range(3)), hashed(part.column(3)), hashed(part.column(4)), strict=True):
                    done: dict[int, tuple[int, int]] = {}
                    outside = []
                    for i, j, more in sorted((p["pa"], p["pb"], p["more"]) for p in anchors):
                        begin, end = done.get(i - j, (0, -1))
                        if i >= end:
                            begin, end = i - reach(x[:i][::-1], y[:j][::-1]), i + reach(x[i:], y[j:])
                            done[i - j] = begin, end
                            if end - begin >= PASSAGE and a != b:
                                spans.append((a, begin, end, b))
                        if more:
                            starts = np.arange(max(0, i + PREFIX - PASSAGE), min(i, len(x) - PASSAGE) + 1)
                            outside.append(starts[(starts < begin) | (starts + PASSAGE > end)])
                    starts = np.unique(np.concatenate(outside)) if outside else np.empty(0, np.int64)
                    if len(starts):
                        keyed.append((a, starts, runs_at(*prefix_sums(x), starts, PASSAGE)))
                n = sum(len(s) for _, s, _ in keyed)
                starts = np.concatenate([s for _, s, _ in keyed] or [np.empty(0, np.int64)]).astype(np.int32)
                keys = np.concatenate([k for _, _, k in keyed] or [np.empty(0, np.uint64)]).view(np.int64)
                a, begin, end, b = zip(*spans, strict=True) if spans else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*a, *(a for a, s, _ in keyed for _ in range(len(s)))], pa.int64()),
                        pa.array([*begin, *[None] * n], pa.int32()),
                        pa.array([*end, *[None] * n], pa.int32()),
                        pa.array([*b, *[None] * n], pa.int64()),
                        pa.array([*[None] * len(a), *keys.tolist()], pa.int64()),
                        pa.array([*[None] * len(a), *starts.tolist()], pa.int32()),
                    ],
                    ["a", "begin", "end", "b", "key", "start"],
                )

    needed = pairs.select(F.col("a").alias("h1")).union(pairs.select(F.col("b").alias("h1"))).distinct()
    some = texts_of(texts, needed)
    left = pairs.join(some.select(F.col("h1").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(some.select(F.col("h1").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "anchors", "ta", "tb").mapInArrow(lean(run), "a long, begin int, end int, b long, key long, start int")


def text_spans(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(h1, begin, end, source): words of a text that stand in a text of the earlier document ``source``."""
    kept = suffixes(docs)
    first = kept.groupBy("key").agg(
        F.count("*").alias("n"), F.min(F.struct("did", "h1", "place")).alias("e"), F.min("h1").alias("low"), F.max("h1").alias("high"),
    ).where("low <> high").select("key", F.col("e.h1").alias("b"), F.col("e.place").alias("pb"), (F.col("n") > 2).alias("more"))
    first = checkpointed(first)  # as a table of its own, so that the skew join can cut a very common key
    anchors = kept.join(first, "key").where("h1 <> b or place <> pb").groupBy(F.col("h1").alias("a"), "b", F.col("place").alias("pa"), "pb").agg(F.max("more").alias("more"))
    pairs = checkpointed(anchors.groupBy("a", "b").agg(F.collect_list(F.struct("pa", "pb", "more")).alias("anchors")))
    found = checkpointed(matches(pairs, docs.select(content_key(F.col("text"))[0], "text")))
    order = nodes.select("h1", "did").groupBy("h1").agg(F.min("did").alias("did"))
    by_source = found.where("key is null").join(order.select(F.col("h1").alias("b"), F.col("did").alias("source")), "b")
    spans = by_source.select(F.col("a").alias("h1"), "begin", "end", "source")
    # runs around suffixes that the earliest neighbour does not share
    runs = found.where("key is not null").select(F.col("a").alias("h1"), "key", "start").distinct().join(order, "h1")
    earliest = runs.groupBy("key").agg(F.min(F.struct("did", "h1")).alias("e"), F.min("h1").alias("low"), F.max("h1").alias("high"))
    known = checkpointed(earliest.where("low <> high").select("key", F.col("e.did").alias("source"), F.col("e.h1").alias("b")))
    exact = runs.join(known, "key").where("h1 <> b")
    return spans.union(exact.select("h1", F.col("start").alias("begin"), (F.col("start") + PASSAGE).cast("int").alias("end"), "source"))


def merged(spans: DataFrame) -> DataFrame:
    """Spans of a text that meet or overlap as one, from the earliest source among them."""
    order = Window.partitionBy("h1").orderBy("begin", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("new", F.when(F.col("begin") <= far, 0).otherwise(1))
    numbered = marked.withColumn("part", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("h1", "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("source").alias("source")).drop("part")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, start_word, n_words, source_id): passages of rows that stand in an earlier document.

    ``docs`` has doc_id and text; documents are in the order of doc_id, null last, and those that share
    an id in the order of a hash of their texts, so that no result depends on how rows are dealt. An
    empty table gives no rows. A row whose text
    an earlier row has is one passage, from the first to the last word. Passages have PASSAGE words
    at least; those of one row that meet are one, and source_id is the earliest document that any
    part of it was matched with. Repeats inside one document are left alone. Rows that repeat whole
    are one document. Null and empty texts have no passages; texts are whole, whatever their length.
    """
    rows = docs.select("doc_id", id_order(), *content_key(F.col("text")), word_count(F.col("text")).alias("words"))
    nodes = checkpointed(rows.groupBy("h1", "h2").agg(F.min("did").alias("did"), F.max("words").alias("words"), F.count("*").alias("copies")))
    spans = merged(text_spans(docs, nodes)).select("h1", F.struct("begin", "end", "source").alias("span"))
    by_text = spans.groupBy("h1").agg(F.collect_list("span").alias("spans"))
    known = nodes.join(by_text, "h1", "left").where((F.col("copies") > 1) & (F.col("words") >= PASSAGE) | F.col("spans").isNotNull())
    own = rows.select("doc_id", F.col("did").alias("own"), "h1", "h2").distinct().join(known, ["h1", "h2"])
    copy = (F.col("own") > F.col("did")) & (F.col("words") >= PASSAGE)
    whole = F.array(F.struct(F.lit(0).alias("begin"), F.col("words").cast("int").alias("end"), F.col("did").alias("source")))
    each = own.select("doc_id", "h1", "h2", F.explode(F.when(copy, whole).otherwise(F.col("spans"))).alias("s"))
    return each.select("doc_id", "h1", "h2", F.col("s.begin").alias("start_word"), (F.col("s.end") - F.col("s.begin")).alias("n_words"), F.col("s.source").alias("source_id"))


def without_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of later passages deleted from ``text``; the columns of ``docs``."""
    spans = repeated_passages(docs).groupBy("doc_id", "h1", "h2").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_tw_row"), "doc_id", *content_key(F.col("text")))
    same = held["doc_id"].eqNullSafe(spans["doc_id"]) & (held["h1"] == spans["h1"]) & (held["h2"] == spans["h2"])
    words = F.regexp_extract_all(F.col("_tw_row.text"), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    left = F.array_join(F.filter(words, lambda w, i: ~F.exists("spans", lambda s: (i >= s["start_word"]) & (i < s["start_word"] + s["n_words"]))), "")
    text = F.when(F.col("spans").isNull(), F.col("_tw_row.text")).otherwise(left)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("_tw_row.n_chars")).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType)
    return held.join(spans, same, "left").select(*(new.get(c, F.col(f"_tw_row.`{c}`")).alias(c) for c in docs.columns))
