"""Line dedup: repeated runs of lines, by the suffix array of line ids.

All distinct texts stand one after the other in corpus order, a line id at each place and a gap
behind each text. Prefix doubling ranks the suffixes: in round k, those that agree in their first
2^k lines share a rank, and ranks follow the order of the suffix array. The next rank comes from
the pair of ranks at a place and 2^k on. A suffix whose prefix nobody shares drops out, so that
rounds get smaller, and they end when no prefix is shared: every rank is unique then.

Suffixes that share a prefix are an interval of the suffix array. For each suffix, the interval of
the longest common prefix in which an earlier suffix of the corpus stands gives the maximal repeated
run that begins there. The last round in which its rank has an earlier place gives the length to a
power of two; then the ranks of the earlier rounds, from the largest down, lengthen the common prefix
as long as somebody shares it. A group of suffixes that share a prefix is known by its first place and
its length; of each subgroup that agrees further, the first suffix also stays in the larger group, where
it is compared with the first ones of others. All steps are aggregates by rank, so no interval, however
large, meets in one task.

A run that holds MIN_WORDS words and stands earlier is a later copy and is deleted: a long line alone,
or many short ones; a chance pair of short lines is left alone. A text that an earlier document has
whole is one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, WORD, Scratch, checkpointed, content_key, fields, lean, running_total

#: Words of the shortest run that is deleted.
MIN_WORDS = 10
#: White space at the ends of lines.
BLANK = " \t\n\v\f\r"


def document_key(docs: DataFrame) -> list[Column]:
    """Columns that tell documents apart and order them: id (null last) and two hashes of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("did"), *content_key(F.col("text"))]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(h1, h2, did, last, x): the distinct texts with a non-blank line, and their first and last ids.

    ``x`` has, for each non-blank line, two hashes of it without white space at its ends, and its words.
    """
    split = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    stripped = F.filter(F.transform(split, lambda s: F.regexp_replace(s, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")), lambda s: s != "")
    # hashes leave the projection, not the texts of lines
    hashed = F.transform(stripped, lambda s: F.struct(F.xxhash64(s).alias("a"), F.xxhash64(F.lit("name"), s).alias("b"), F.regexp_count(s, F.lit(WORD)).cast("int").alias("w")))
    rows = docs.select(*document_key(docs), hashed.alias("x")).where(F.size("x") > 0)
    return rows.groupBy("h1", "h2").agg(F.min("did").alias("did"), F.max("did").alias("last"), F.first("x").alias("x"))


def ranked(named: DataFrame, by: list[str]) -> DataFrame:
    """``named`` (place, columns ``by``, others) with rank and src, where another row has the same name ``by``.

    Names in order give the ranks; ``src`` is the first place of a name. Only the counted names are
    sorted, so that a very common one is a single row of the sort.
    """
    often = named.groupBy(*by).agg(F.count("*").alias("n"), F.min("place").alias("src")).where("n > 1")
    ranks = often.orderBy(*by).select(*by, "src", F.monotonically_increasing_id().alias("_rank"))
    return named.join(ranks, by).drop(*by).withColumnRenamed("_rank", "rank")


def line_ranks(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(starts of the texts, first ranks): (h1, h2, start, words) and (place, start, before, w, src, rank).

    ``before`` counts the words of a text before a line, ``w`` those of the line.
    """
    sized = texts.select("h1", "h2", "did", (F.size("x") + 1).cast("long").alias("size"), F.aggregate("x", F.lit(0).cast("long"), lambda t, x: t + x["w"]).alias("words"))
    order = checkpointed(sized.orderBy("did", "h1", "h2").withColumn("part", F.spark_partition_id()))
    starts = checkpointed(running_total(order, [], "part", ["did", "h1", "h2"], "size", "start").select("h1", "h2", "did", "start", "words"))
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            items, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            a, b, w = (pa.array(items.field(n)) for n in ("a", "b", "w"))
            start, head = np.repeat(batch.column(0).to_numpy(), np.diff(offsets)), np.repeat(offsets[:-1], np.diff(offsets))
            total = np.append(0, np.cumsum(w.to_numpy(), dtype=np.int64))
            columns = [pa.array(start + np.arange(len(w)) - head), pa.array(start), pa.array(total[:-1] - total[head]), w.cast(pa.int64()), a, b]
            yield pa.RecordBatch.from_arrays(columns, ["place", "start", "before", "w", "a", "b"])

    lines = texts.join(starts, ["h1", "h2"]).select("start", "x").mapInArrow(lean(placed), "place long, start long, before long, w long, a long, b long")
    return starts, checkpointed(ranked(lines, ["a", "b"]))


def longest_runs(first: DataFrame) -> DataFrame:
    """(place, length, src): for each place, the longest run of lines from there that also begins at an earlier place.

    ``first`` has place, rank and src of every line that stands twice at least.
    """
    keep = Scratch(first.sparkSession)
    rounds = [first.select("place", "rank", "src")]
    while not rounds[-1].isEmpty():
        now, by = rounds[-1].select("place", "rank"), 2 ** (len(rounds) - 1)
        ahead = now.select((F.col("place") - by).alias("place"), F.col("rank").alias("after"))
        rounds.append(keep(ranked(now.join(ahead, "place"), ["rank", "after"])))
    groups = rounds[0].select("place", "src", F.lit(0).cast("long").alias("length")).where("false")
    for k in range(len(rounds) - 2, -1, -1):
        if k < len(rounds) - 2:  # lengthen the common prefixes of groups by 2^k lines where they go on alike
            ranks = rounds[k].select(F.col("place").alias("end"), "rank")
            reached = groups.withColumn("end", F.col("place") + F.col("length")).join(ranks, "end", "left").drop("end")
            shared = reached.where("rank is not null").groupBy("src", "length", "rank").agg(F.count("*").alias("n"), F.min("place").alias("head")).where("n > 1").drop("n")
            met = reached.join(shared, ["src", "length", "rank"], "left")
            stays = F.struct("place", "src", "length")
            goes = F.struct("place", F.col("head").alias("src"), (F.col("length") + 2**k).alias("length"))
            parts = F.when(F.col("head").isNull(), F.array(stays)).when(F.col("head") == F.col("place"), F.array(stays, goes)).otherwise(F.array(goes))
            groups = met.select(F.explode(parts).alias("g")).select("g.*")
        # suffixes whose common prefix with an earlier one is shorter than 2^(k + 1): alone or first in the next round
        later = rounds[k + 1].where("src < place").select("place")
        own = rounds[k].join(later, "place", "left_anti").select("place", "src", F.lit(2**k).cast("long").alias("length"))
        groups = keep(groups.union(own))
    out = checkpointed(groups.where("src < place").select("place", "length", "src"))
    keep.close()
    return out


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2, did, last, words, runs): texts with later copies; runs of (at, length) in non-blank lines of their first document.

    A run is the longest one from its line on that begins at an earlier place too, with ``min_words``
    words at least, and not inside of another; runs may overlap. ``did`` is the id of the first document with the text; a larger
    ``last`` says that others have it too.
    """
    texts = checkpointed(distinct_texts(docs))
    starts, first = line_ranks(texts)
    runs = longest_runs(first)
    ends = first.select(F.col("place").alias("end"), (F.col("before") + F.col("w")).alias("upto"))
    begun = runs.withColumn("end", F.col("place") + F.col("length") - 1).join(ends, "end").join(first.select("place", "start", "before"), "place")
    begun = begun.where(F.col("upto") - F.col("before") >= min_words)
    # a run inside of one that begins before it adds nothing: what stays are the maximal ones
    before = Window.partitionBy("start").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    maximal = begun.withColumn("reached", F.max(F.col("place") + F.col("length")).over(before)).where("reached is null or place + length > reached")
    held = maximal.groupBy("start").agg(F.collect_list(F.struct((F.col("place") - F.col("start")).cast("int").alias("at"), F.col("length").cast("int").alias("length"))).alias("runs"))
    known = texts.select("h1", "h2", "last").join(starts, ["h1", "h2"]).join(held, "start", "left")
    return known.where(F.col("runs").isNotNull() | (F.col("last") > F.col("did")) & (F.col("words") >= min_words)).select("h1", "h2", "did", "last", "words", "runs")


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``kept`` (the text without later copies), n_lines and n_deleted.

    Lines are split at line feeds and compared without white space at their ends; blank lines belong
    to no run and stay. The corpus is read in the order of doc_id (null last); the first copy of a
    run stays. A run may overlap its own earlier copy, as in a line that stands three times in a row.
    A null text stays null; rows that repeat whole are one document and get the same result; an empty
    table gives no rows; all columns of ``docs`` pass through in ``row``.

    A bounded number of texts with runs is broadcast, so that no text is shuffled; a larger number is
    joined by a shuffle.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    runs = checkpointed(repeated_runs(docs, min_words))
    sizes = runs.agg(F.count("*").alias("texts"), F.coalesce(F.sum(F.size("runs")), F.lit(0)).alias("runs")).first()
    few = sizes["texts"] <= BROADCAST_IDS and sizes["runs"] <= 4 * BROADCAST_IDS
    held = docs.select(row, "text", *document_key(docs)).join((F.broadcast(runs) if few else runs).withColumnRenamed("did", "first"), ["h1", "h2"], "left")
    copy = (F.col("did") > F.col("first")) & (F.col("words") >= min_words)
    held = held.select("row", "text", F.when(copy, F.array(F.struct(F.lit(0).alias("at"), F.lit(2**31 - 1).alias("length")))).when(F.col("did") == F.col("first"), F.col("runs")).alias("runs"))

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [without_runs(t, r) for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            kept, n_lines, n_deleted = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_deleted, pa.int64())], ["row", "kept", "n_lines", "n_deleted"])

    return held.mapInArrow(lean(edit), fields(held, ["row"], [("kept", T.StringType()), ("n_lines", T.LongType()), ("n_deleted", T.LongType())]))


def without_runs(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
    """(text without runs of its non-blank lines, number of its lines, number of deleted ones)."""
    if text is None:
        return None, 0, 0
    if not runs:
        return text, text.count("\n") + 1, 0
    every = text.split("\n")
    full = [i for i, line in enumerate(every) if line.strip(BLANK)]
    gone: set[int] = set()
    upto = 0
    for at, length in sorted((r["at"], r["length"]) for r in runs):
        gone.update(full[max(at, upto) : at + length])
        upto = max(upto, at + length)
    return "\n".join(line for i, line in enumerate(every) if i not in gone), len(every), len(gone)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later copies of line runs deleted from ``text``; rows left without a word go.

    A row without a word before stays as it is, a null text too. The result has the columns of
    ``docs``; ``n_chars`` is counted anew where a text changed. Ties, repeated rows and empty tables
    are as in ``deduplicated``.
    """
    done = deduplicated(docs, min_words).where((F.col("n_deleted") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_deleted") == 0, F.col("row.n_chars")).otherwise(F.char_length("kept")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
